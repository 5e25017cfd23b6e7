"""Queries over the given tables, each with the SQL that checks it.

``QUERIES[name]`` takes (spark, folder) and returns a DataFrame; ``ORACLE[name]``
is SQL over the same tables.  Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom import markup
from pageloom.functions import text as fx
from pageloom.functions.urls import resolve_url
from pageloom.operators.match import (
    distinct_ordered, first_per, frontier, in_domain, lookup, pending, prefix_semi, zip_rows,
)
from pageloom.operators.order import after_heading, children, take_while, until, with_section
from pageloom.operators.select import (
    ad_counts, attr_is, class_attr_starts, drop_ads, drop_boilerplate, drop_hidden, drop_subtrees,
    first_in, has_attr, has_class, has_id, href_starts, innermost, outermost, scope, style_has, tag, within,
)
from pageloom.operators import selector
from pageloom.operators.text import subtree_text, with_clean
from pageloom.plans import cards as cd
from pageloom.plans import chat, conform, documents, infobox, records, tables
from pageloom.plans.catalog import link_texts, shop_catalog, tier_catalog, titles_to_fetch, topic_catalog
from pageloom.schema import ATTRIBUTES, ENTITY_NAMES, STAT_TYPES
from pageloom.sources import stores
from pageloom.sources.htmltree import html_nodes, html_pages
from pageloom.sources.pages import newest, read_pages, read_table
from pageloom.streaming import messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def article() -> Column:
    return tag("article")


def chrome() -> Column:
    return tag("nav", "footer") | has_class("ad")


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


# Pages of one task: their nodes are sorted together, so this bounds its memory whatever the table holds.
PAGES_PER_TASK = 1500


def spread(spark: SparkSession, path: str) -> int:
    """Tasks of a parse: the session's shuffle partitions, and more where a task would get too many pages."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read_table(spark, path).count() // PAGES_PER_TASK))


def page_nodes(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/pages.parquet"
    tasks = spread(spark, path)
    return html_nodes(read_pages(spark, path, tasks), tasks)


def built_nodes(spark: SparkSession, folder: str, name: str, key: str, page: Column) -> DataFrame:
    """Nodes of the pages that Spark builds from the rows of a table."""
    path = f"{folder}/{name}.parquet"
    tasks = spread(spark, path)
    return html_nodes(markup.pages_from(read_table(spark, path, key, tasks), key, page), tasks)


def part_pages(spark: SparkSession, folder: str, page: Column) -> DataFrame:
    """The pages that Spark builds from ``part``, their nodes in one array each: parsed where the rows were dealt, so nodes are not exchanged."""
    path = f"{folder}/part.parquet"
    return html_pages(markup.pages_from(read_table(spark, path, "p_partkey", spread(spark, path)), "p_partkey", page))


def plain(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it lies; only tables that feed the parse are worth spreading."""
    return read_table(spark, f"{folder}/{name}.parquet")


def part_nodes(spark: SparkSession, folder: str, page) -> DataFrame:
    return built_nodes(spark, folder, "part", "p_partkey", page)


def supplier_nodes(spark: SparkSession, folder: str, page) -> DataFrame:
    return built_nodes(spark, folder, "supplier", "s_suppkey", page)


def kept(df: DataFrame) -> DataFrame:
    """Nodes that a plan reads three times or more: parsed once, spilled to disk when large.

    Kept nodes hold every column.  A plan that reads large pages twice parses them twice instead, and each reading takes its columns only.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


# ---- SQL pieces --------------------------------------------------------------

WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def sql_entities(x: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def sql_no_tags(x: str, by: str = "") -> str:
    return f"regexp_replace({x}, '<[^>]*>', '{by}', 'g')"


SQL_ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
SQL_TITLE = sql_strip(sql_entities("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"))


# ---- The given pages ----------------------------------------------------------

@query(f"""
    SELECT page_id, i - 1 AS pos, hrefs[i] AS href, {sql_entities('texts[i]')} AS text,
           regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || hrefs[i] AS target
    FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs,
                 regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1) AS texts,
                 unnest(range(1, len(regexp_extract_all(html, '<li><a href="')) + 1)) AS i
          FROM pages)
""")
def page_links(spark, folder):
    pages = read_pages(spark, f"{folder}/pages.parquet")
    links = link_texts(html_nodes(pages), tag("nav"))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1
    return links.withColumn("pos", pos.cast("long")).join(pages.select("page_id", "url"), "page_id").select(
        "page_id", "pos", "href", "text", resolve_url("url", "href").alias("target")
    )


@query(r"""
    SELECT url AS base, ref, CASE
        WHEN ref = '' THEN url
        WHEN ref LIKE 'https:%' THEN ref
        WHEN ref LIKE '//%' THEN regexp_extract(url, '^([a-z]+:)', 1) || ref
        WHEN ref = '/a/../b?x=/../y' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/b?x=/../y'
        WHEN ref LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || ref
        WHEN ref LIKE '?%' THEN regexp_extract(url, '^([^?#]*)', 1) || ref
        WHEN ref LIKE '#%' THEN regexp_extract(url, '^([^#]*)', 1) || ref
        WHEN ref = '../up' THEN regexp_replace(regexp_extract(url, '^([a-z]+://[^?#]*/)', 1), '([^/:]/)[^/]+/$', '\1') || 'up'
        ELSE regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || ref END AS target
    FROM pages, (SELECT unnest(['', 'https://e.org/x', '//h.org/p', '/a/../b?x=/../y', '/p/q.', '?q=1', '#f', '../up',
                                'Shadow_Fiend', 'a/b?c#d']) AS ref)
""")
def resolved_urls(spark, folder):
    refs = ["", "https://e.org/x", "//h.org/p", "/a/../b?x=/../y", "/p/q.", "?q=1", "#f", "../up", "Shadow_Fiend", "a/b?c#d"]
    return read_pages(spark, f"{folder}/pages.parquet").select(
        F.col("url").alias("base"), F.explode(F.array(*map(F.lit, refs))).alias("ref")
    ).withColumn("target", resolve_url("base", "ref"))


@query(r"""
    SELECT page_id, tag, count(*) AS n
    FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html,
        '<(script|style)>.*?</', '<\1></', 'gs'), '<!--.*?-->', '', 'gs'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)
    GROUP BY ALL
""")
def page_tag_counts(spark, folder):
    nodes = page_nodes(spark, folder).where(~tag("#text", "#document"))
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, {SQL_TITLE} AS title, '# ' || {SQL_TITLE} AS heading FROM pages")
def page_titles(spark, folder):
    nodes = scope(page_nodes(spark, folder), article())
    titles = first_in(
        subtree_text(nodes, tag("h1"), title="spaced"), F.lit(True), ["page_id"], "title"
    )
    heading = fx.strip(documents.heading_markdown(F.lit(1), F.col("title")))
    return titles.select("page_id", "title", heading.alias("heading"))


@query("""
    SELECT page_id, 'class ad' AS kind, len(regexp_extract_all(html, '<div class="ad"')) AS n FROM pages
    WHERE html LIKE '%<div class="ad"%'
""")
def page_ads(spark, folder):
    return ad_counts(page_nodes(spark, folder), classes=("ad",), ids=())


@query(f"""
    SELECT page_id, {sql_collapse(sql_entities(sql_no_tags(f"replace({SQL_ARTICLE}, '<br>', ' · ')", ' ')))} AS text FROM pages
""")
def clean_text(spark, folder):
    nodes = with_clean(drop_subtrees(page_nodes(spark, folder), chrome()))
    return subtree_text(nodes, article(), text="spaced:clean").select("page_id", fx.collapse("text").alias("text"))


@query(f"""
    SELECT page_id, i - 1 AS pos, section, {sql_strip(sql_entities(sql_no_tags('paras[i + 1]')))} AS text
    FROM (SELECT page_id, {SQL_TITLE} AS section, string_split(regexp_replace({SQL_ARTICLE}, '<h1>.*</h1>', '', 's'), '<p>') AS paras,
                 unnest(range(1, len(string_split({SQL_ARTICLE}, '<p>')))) AS i FROM pages)
""")
def page_sections(spark, folder):
    nodes = scope(page_nodes(spark, folder), article())
    rows = with_section(
        subtree_text(nodes, tag("h1", "p"), "tag", text="raw").withColumn("text", fx.strip("text")),
        F.col("tag") == "h1", F.col("text"),
    ).where(F.col("tag") == "p")
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1
    return rows.select("page_id", pos.cast("long").alias("pos"), "section", "text")


@query(f"""
    SELECT page_id, {SQL_TITLE} AS heading,
           {sql_strip(sql_entities(sql_no_tags(f"string_split({SQL_ARTICLE}, '<p>')[2]")))} AS first_text,
           {sql_strip(sql_entities(sql_no_tags(f"string_split({SQL_ARTICLE}, '<p>')[3]")))} AS second_text
    FROM pages
""")
def after_headings(spark, folder):
    rows = children(page_nodes(spark, folder), article(), form="raw").withColumn("text", fx.strip("text"))
    first = after_heading(rows, F.col("tag") == "h1", 1, keep="last", fields=("text",))
    second = after_heading(rows, F.col("tag") == "h1", 2, keep="first", fields=("text",))
    return first.select("page_id", F.col("text").alias("heading"), F.col("next.text").alias("first_text")).join(
        second.select("page_id", F.col("next.text").alias("second_text")), "page_id"
    )


@query(f"""
    SELECT page_id, pos, '- ' || {sql_collapse(sql_entities('x'))} AS line
    FROM (SELECT page_id, unnest(range(len(t))) AS pos, unnest(t) AS x
          FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a>', 1) AS t FROM pages))
""")
def nav_bullets(spark, folder):
    lines = cd.bullets(page_nodes(spark, folder), tag("nav"))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("start")) - 1
    return lines.select("page_id", pos.cast("long").alias("pos"), "line")


@query(f"""
    SELECT page_id, '# ' || url || chr(10) || chr(10) || chr(10) || chr(10) || '# ' || {SQL_TITLE} || chr(10) || chr(10)
        || {sql_entities(sql_no_tags(f"regexp_replace({SQL_ARTICLE}, '<h1>.*</h1>', '', 's')"))} AS markdown
    FROM pages
""")
def page_markdown(spark, folder):
    pages = read_pages(spark, f"{folder}/pages.parquet")
    nodes = drop_subtrees(scope(html_nodes(pages), article(), keep_root=True, keep_document=True), chrome())
    docs = documents.page_text(nodes, headings=("h1", *documents.HEADINGS))
    return stores.filled(docs.join(pages.select("page_id", "url"), "page_id")).select(
        "page_id", documents.with_title("url", "markdown").alias("markdown")
    )


@query("""
    SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)
""")
def pending_pages(spark, folder):
    done = plain(spark, folder, "labels").select(F.col("doc_id").alias("page_id"))
    return pending(read_pages(spark, f"{folder}/pages.parquet").select("page_id", "url"), done, "page_id")


@query("""
    SELECT page_id, count(*) AS n, string_agg(x, ' ' ORDER BY pos) AS hrefs
    FROM (SELECT page_id, x, min(pos) AS pos
          FROM (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS x
                FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS h FROM pages))
          GROUP BY page_id, x)
    GROUP BY page_id
""")
def distinct_links(spark, folder):
    links = link_texts(page_nodes(spark, folder), tag("nav"))
    return links.groupBy("page_id").agg(distinct_ordered("href").alias("h")).select(
        "page_id", F.size("h").cast("long").alias("n"), F.array_join("h", " ").alias("hrefs")
    )


SQL_BODY = "regexp_extract(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<body>(.*)', 1, 's')"
SQL_MARKS = sql_collapse(SQL_BODY)
for _tag, _mark in (
    ("</?ul>", "\n\n"), ("<li>", "\n- "), ("<h1>", "\n\n# "), ("</h1>", "\n\n"), ("</?p>", "\n\n"), ("</article>", "\n\n"),
    # A bold run that is left open ends with its paragraph, right after the break.
    ("<b>([^<]*)<br>", r"**\1  " + "\n**"),
):
    SQL_MARKS = f"regexp_replace({SQL_MARKS}, '{_tag}', '{_mark}', 'g')"
SQL_BLANKS = r"\n{3,}"


@query(f"""
    SELECT page_id, {sql_strip(f"regexp_replace({sql_entities(sql_no_tags(SQL_MARKS))}, '{SQL_BLANKS}', chr(10) || chr(10), 'g')")} AS markdown
    FROM pages
""")
def page_to_markdown(spark, folder):
    docs = documents.html_to_markdown(drop_subtrees(page_nodes(spark, folder), tag("head")))
    return docs.select("page_id", "markdown")


# ---- Catalogues ----------------------------------------------------------------

@query("""
    SELECT p_partkey AS page_id, CASE p_type WHEN 'ECONOMY' THEN 'consumables' ELSE 'secret shop' END AS category, pos,
           CASE pos WHEN 0 THEN p_name ELSE p_type END AS name
    FROM part, (SELECT unnest([0, 2]) AS pos) WHERE p_type IN ('ECONOMY', 'SMALL')
""")
def price_names(spark, folder):
    return shop_catalog(part_nodes(spark, folder, markup.shop_page())).select("page_id", "category", "pos", "name")


@query("""
    SELECT p_partkey AS page_id, 'neutral_items' AS category, 'tier ' || p_size % 7 AS tier, pos,
           CASE pos WHEN 0 THEN p_name ELSE p_brand END AS name
    FROM part, (SELECT unnest([0, 1]) AS pos) WHERE p_size % 7 BETWEEN 1 AND 5
    UNION ALL SELECT p_partkey, 'enchantments', 'tier 2-3', 0, p_type FROM part WHERE p_size % 2 = 0
""")
def tier_lists(spark, folder):
    return tier_catalog(part_nodes(spark, folder, markup.tier_page())).select("page_id", "category", "tier", "pos", "name")


SQL_TOPICS = """
    SELECT c_custkey AS page_id, c_mktsegment AS category, t.title, t.parent_title, t.pos
    FROM (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN 'HUD' ELSE 'Plain' END AS hud FROM customer), LATERAL (VALUES
        (c_name, NULL, 1), ('Sub ' || c_nationkey, c_name, 2), ('Alt ' || c_nationkey, NULL, 3),
        ('Sub ' || c_nationkey, 'Alt ' || c_nationkey, 4), (hud, NULL, 5)) t(title, parent_title, pos)
"""


def _topics(spark, folder):
    return topic_catalog(built_nodes(spark, folder, "customer", "c_custkey", markup.topic_page()))


@query(SQL_TOPICS)
def topics(spark, folder):
    return _topics(spark, folder)


@query(f"""
    SELECT title, max_by(page_id, page_id * 10 + pos) AS page_id, max_by(pos, page_id * 10 + pos) AS pos FROM ({SQL_TOPICS}) GROUP BY title
""")
def topic_titles(spark, folder):
    return titles_to_fetch(_topics(spark, folder)).select("title", "page_id", "pos")


@query("""
    SELECT 'shop_items' AS category, p_name AS name, count(*) AS n FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY ALL
    UNION ALL SELECT 'shop_items', p_type, count(*) FROM part WHERE p_type IN ('ECONOMY', 'SMALL') GROUP BY ALL
    UNION ALL SELECT 'enchantments', p_type, count(*) FROM part WHERE p_size % 2 = 0 GROUP BY ALL
    UNION ALL SELECT 'neutral_items', name, count(*) FROM (SELECT unnest([p_name, p_brand]) AS name FROM part WHERE p_size % 7 BETWEEN 1 AND 5) GROUP BY ALL
""")
def work_list(spark, folder):
    shop = shop_catalog(part_nodes(spark, folder, markup.shop_page())).select("name")
    tiers = tier_catalog(part_nodes(spark, folder, markup.tier_page()))
    both = frontier(
        shop_items=shop,
        neutral_items=tiers.where("category = 'neutral_items'").select("name"),
        enchantments=tiers.where("category = 'enchantments'").select("name"),
    )
    return both.groupBy("category", "name").agg(F.count("*").alias("n"))


@query("""
    SELECT p_partkey AS page_id, CASE WHEN p_size % 3 = 0 THEN 'late ' || p_brand WHEN p_size % 2 = 0 THEN 'second ' || p_size ELSE 'first ' || p_name END AS title
    FROM part
""")
def page_versions(spark, folder):
    path = f"{folder}/part.parquet"
    rows = read_table(spark, path, "p_partkey", spread(spark, path))
    version = lambda at, only, *said: rows.where(only).select(
        F.col("p_partkey").cast("long").alias("page_id"), F.lit("u").alias("url"), markup.html("<h1>", *said, "</h1>").alias("html"),
        F.lit(at).cast("timestamp").alias("fetched_at"))
    size = F.col("p_size")
    every = [
        version("2024-01-02", size % 2 == 0, "second ", size), version(None, F.lit(True), "undated"), version("2024-01-03", size % 3 == 0, "late ", F.col("p_brand")),
        version("2024-01-01", F.lit(True), "first ", F.col("p_name")), version("2024-01-03", size % 3 == 0, "late ", F.col("p_brand")),
    ]
    nodes = html_nodes(newest(reduce(DataFrame.unionByName, every)))
    return subtree_text(nodes, tag("h1"), title="raw").select("page_id", "title")


# ---- Choosing and removing -----------------------------------------------------

@query("""
    SELECT p_partkey AS page_id, 'keep ' || p_name || 'tabs ' || p_brand || 'panel ' || p_size || 'shown ' || p_partkey AS text FROM part
""")
def noise_removed(spark, folder):
    nodes = drop_boilerplate(part_nodes(spark, folder, markup.noisy_page()), keep_tabs=True)
    return subtree_text(drop_ads(drop_hidden(nodes)), has_class("mw-parser-output"), text="raw").select("page_id", "text")


@query("""
    SELECT p_partkey AS page_id, kind, n::BIGINT AS n
    FROM part, LATERAL (VALUES ('iframe', p_size % 3), ('class sponsored', p_partkey % 4), ('id top-ad', 1), ('class ad-wrapper', p_size % 2)) t(kind, n)
    WHERE n > 0
""")
def part_ads(spark, folder):
    return ad_counts(part_nodes(spark, folder, markup.ad_page()))


@query("""
    SELECT p_partkey AS page_id, (p_partkey % 3 + p_size % 2 + 1)::INT AS by_class_and_tag, (p_size % 3 = 1)::INT AS by_id,
           (p_size % 4 + 1)::INT AS by_attribute, (p_size % 2)::INT AS by_value, 1 AS by_style, 1 AS by_prefix, (p_partkey % 2 + 1)::INT AS by_href,
           'On ' || p_name AS first_heading
    FROM part
""")
def selectors(spark, folder):
    nodes = part_nodes(spark, folder, markup.selector_page())
    counts = nodes.groupBy("page_id").agg(
        F.count_if((tag("div") & has_class("card")) | (tag("table") & has_class("wikitable"))).cast("int").alias("by_class_and_tag"),
        F.count_if(has_id("t1")).cast("int").alias("by_id"),
        F.count_if(has_attr("colspan")).cast("int").alias("by_attribute"),
        F.count_if(attr_is("title", "Other")).cast("int").alias("by_value"),
        F.count_if(style_has("float:right;", "border:1px solid grey;")).cast("int").alias("by_style"),
        F.count_if(class_attr_starts("table-t")).cast("int").alias("by_prefix"),
        F.count_if(href_starts("#") & has_attr("title")).cast("int").alias("by_href"),
    )
    heads = first_in(subtree_text(nodes, tag("h2", "h3"), text="raw"), F.lit(True), ["page_id"], "text")
    return counts.join(heads.select("page_id", F.col("text").alias("first_heading")), "page_id")


# Selectors, and in SQL how many elements of a part's page each picks.
SELECTED = {
    "ul.menu > li.it": "p_size % 5", "ul.menu li.it": "p_size % 5 + 1", "nav li": "p_size % 5 + 2", "ul ul > li, ul.big > li:not(.it)": "2",
    "div.card span": "p_partkey % 3 + p_size % 2", "div.card > span": "p_size % 2", "div.card:not(.promo) p > *": "p_partkey % 3",
    "span[title^='Armor']": "p_partkey % 3", "[title=Other]": "p_size % 2", "[title$=\"er\"]": "p_size % 2",
    "span[title~='of']": "p_partkey % 3", "[title*='" + "PROMO" + "']": "CASE WHEN p_type LIKE '%PROMO%' THEN p_partkey % 3 ELSE 0 END",
    "#t1 td[colspan]": "CASE WHEN p_size % 3 = 1 THEN p_size % 4 + 1 ELSE 0 END", "table td, li.it": "2 * (p_size % 4 + 1) + p_size % 5 + 1",
    "tr > td[colspan='2']": "p_size % 4 + 1", "[lang|=en] > a[href^='#']": "p_partkey % 2 + 1", "td td": "0",
}


@query("SELECT p_partkey AS page_id, t.selector, t.n::BIGINT AS n FROM part, LATERAL (VALUES "
       + ", ".join("('" + k.replace("'", "''") + f"', {n})" for k, n in SELECTED.items()) + ") t(selector, n)")
def selected(spark, folder):
    nodes = part_nodes(spark, folder, markup.selector_page())
    names = {f"_pick{i}": text for i, text in enumerate(SELECTED)}
    for name, text in names.items():
        nodes = selector.selected(nodes, name, text)
    counts = nodes.groupBy("page_id").agg(*[F.count_if(F.col(n)).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(text).alias("selector"), F.col(n).alias("n")) for n, text in names.items()])
    return counts.select("page_id", F.inline(pairs))


@query("""
    SELECT p_partkey AS page_id, CASE WHEN p_size % 3 = 2 THEN 4 ELSE 3 END AS innermost_tables, 3 AS outermost_tables, (1 + p_partkey % 2)::INT AS outer_lists,
           (2 + p_size % 4 + p_partkey % 2)::INT AS listed_items,
           CASE WHEN p_size % 4 = 3 THEN CASE WHEN p_size % 3 = 0 THEN 'third' ELSE '' END || 'inner ' || p_size ELSE 'second ' || p_partkey END AS chosen
    FROM part
""")
def nested_choice(spark, folder):
    nodes = kept(part_nodes(spark, folder, markup.choice_page()))
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").cast("int").alias(name))
    listed = first_per(
        within(nodes, tag("ul"), tag("li")).select("page_id", "start", "end"), ["page_id", "start"], "end"
    )
    body = subtree_text(nodes, tag("tbody"), text="raw").select("page_id", F.col("start").alias("at"), "text")
    picked = tables.choose_table(nodes).join(body, "page_id").where(
        (F.col("at") > F.col("start")) & (F.col("at") <= F.col("end"))
    ).select("page_id", F.col("text").alias("chosen"))
    out = count(innermost(nodes, tag("table")), "innermost_tables")
    for df in (
        count(outermost(nodes, tag("table")), "outermost_tables"), count(outermost(nodes, tag("ul")), "outer_lists"),
        count(listed, "listed_items"), picked,
    ):
        out = out.join(df, "page_id")
    return out


# ---- Tables and skill lists ------------------------------------------------------

@query("""
    SELECT s_suppkey AS page_id, t.tab, t.row, t.col, t.is_header, t.text FROM supplier, LATERAL (VALUES
        (1, 0, 0, true, 'Who Supplier'), (1, 0, 1, true, 'Nation'), (1, 0, 2, true, 'Code'),
        (1, 1, 0, false, s_name), (1, 1, 1, false, 'Nation ' || s_nationkey), (1, 1, 2, false, 'code' || s_suppkey),
        (1, 2, 0, false, 'Pic ' || s_suppkey), (1, 2, 1, false, ''), (1, 2, 2, false, 'code' || s_suppkey),
        (1, 3, 0, false, 'plain'), (1, 3, 1, false, 'wide ' || s_nationkey), (1, 3, 2, false, 'wide ' || s_nationkey),
        (2, 0, 0, false, 'k'), (2, 0, 1, false, 'val ' || s_suppkey)) t(tab, "row", col, is_header, text)
""")
def grid_cells(spark, folder):
    cells = tables.table_cells(supplier_nodes(spark, folder, markup.grid_page()))
    tab = F.dense_rank().over(Window.partitionBy("page_id").orderBy("table_id"))
    return cells.select("page_id", tab.alias("tab"), "row", "col", "is_header", "text")


@query("""
    SELECT s_suppkey AS page_id, t.tab, t.markdown FROM supplier, LATERAL (VALUES
        (1, concat_ws(chr(10), '| Who Supplier | Nation | Code |', '|---|---|---|', '| ' || s_name || ' | Nation ' || s_nationkey || ' | code' || s_suppkey || ' |',
            '| Pic ' || s_suppkey || ' | - | code' || s_suppkey || ' |', '| plain | wide ' || s_nationkey || ' | wide ' || s_nationkey || ' |')),
        (2, concat_ws(chr(10), '| 0 | 1 |', '|---|---|', '| k | val ' || s_suppkey || ' |'))) t(tab, markdown)
""")
def grid_markdown(spark, folder):
    docs = tables.table_markdown(tables.table_cells(supplier_nodes(spark, folder, markup.grid_page())))
    tab = F.row_number().over(Window.partitionBy("page_id").orderBy("start"))
    return docs.select("page_id", tab.alias("tab"), fx.strip("markdown").alias("markdown"))


@query("""
    SELECT s_suppkey AS page_id, t.* FROM supplier, LATERAL (VALUES
        ('Skills ' || s_nationkey, 1, s_name, 'Call ' || s_suppkey, ''), ('Skills ' || s_nationkey, 2, 'Hero ' || s_nationkey, 'Fire ' || s_suppkey, ''),
        ('Skills ' || s_nationkey, 3, 'Tiny', 'Toss ' || s_suppkey, 'Throws ' || s_nationkey),
        (NULL, 1, 'A' || s_suppkey, 'B', '')) t(title, pos, source, ability, details)
""")
def skills(spark, folder):
    return tables.skill_rows(supplier_nodes(spark, folder, markup.skill_page())).drop("block", "block_end")


@query("""
    SELECT s_suppkey AS page_id, t.* FROM supplier, LATERAL (VALUES
        (1, concat_ws(chr(10), '#### Skills ' || s_nationkey, '', '| Source | Ability | Details |', '|---|---|---|',
            '| ' || s_name || ' | Call ' || s_suppkey || ' |  |', '| Hero ' || s_nationkey || ' | Fire ' || s_suppkey || ' |  |',
            '| Tiny | Toss ' || s_suppkey || ' | Throws ' || s_nationkey || ' |')),
        (2, concat_ws(chr(10), '| Source | Ability |', '|---|---|', '| A' || s_suppkey || ' | B |'))) t(pos, markdown)
""")
def skill_tables(spark, folder):
    docs = tables.skill_markdown(tables.skill_rows(supplier_nodes(spark, folder, markup.skill_page())))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("start"))
    return docs.select("page_id", pos.alias("pos"), fx.strip("markdown").alias("markdown"))


# ---- Infoboxes and cards ----------------------------------------------------------

SQL_BOX = """
    (0, 'head', p_name || ' ' || p_partkey, 'A ' || p_type || ' thing.'), (1, 'section', 'Costs', ''),
    (2, 'row', 'Stock', p_size || ' seconds'), (3, 'row', 'Brand', p_brand || ' · +' || p_size), (4, 'section', 'Stats', ''),
    (5, 'row', 'Brand', 'more ' || p_partkey), (6, 'row', 'Type', 'Type ' || p_type || ' · Yes'),
    (7, 'row', 'Builds From', 'Hilt ' || p_size || ' + Recipe'), (8, 'row', 'Upgrades Into', 'Great ' || p_name)
"""


@query(f"""
    SELECT p_partkey AS page_id, t.* FROM part, LATERAL (VALUES {SQL_BOX}, (0, 'none', NULL, NULL)) t(pos, kind, label, value)
""")
def infobox_rows(spark, folder):
    page = markup.content(
        *markup.infobox("fo-nttax-infobox-wrapper", "fo-nttax-infobox"), *markup.infobox("fo-nttax-infobox"))
    return infobox.infobox_props(part_pages(spark, folder, page)).drop("block", "block_end")


SQL_BOX_MARKDOWN = """concat_ws(chr(10), '### ' || p_name || ' ' || p_partkey, '', '> A ' || p_type || ' thing.', '',
    '| Property | Value |', '|---|---|', '| *Costs* | |', '| Stock | ' || p_size || ' seconds |', '| Brand | ' || p_brand || ' · +' || p_size || ' |',
    '| *Stats* | |', '| Brand | more ' || p_partkey || ' |', '| Type | Type ' || p_type || ' · Yes |',
    '| Builds From | Hilt ' || p_size || ' + Recipe |', '| Upgrades Into | Great ' || p_name || ' |', '', '')"""


@query(f"SELECT p_partkey AS page_id, {SQL_BOX_MARKDOWN} AS markdown FROM part")
def infobox_markdown(spark, folder):
    page = markup.content(*markup.infobox("fo-nttax-infobox-wrapper", "fo-nttax-infobox"))
    return infobox.props_markdown(infobox.infobox_props(part_pages(spark, folder, page))).select("page_id", "markdown")


SQL_CARD_ROWS = """
    (1, 'Ability', p_type), (2, 'Affects', 'Enemies ' || p_size), (3, 'Radius', p_size::VARCHAR), (4, 'Cooldown', p_size::VARCHAR), (5, 'Mana Cost', '60')
"""


@query(f"""
    SELECT p_partkey AS page_id, p_name AS title, 'Moves ' || p_size || ' far' AS description, p_brand AS badges,
           'note ' || p_partkey AS notes, t.* FROM part, LATERAL (VALUES {SQL_CARD_ROWS}) t(pos, label, value)
""")
def card_props(spark, folder):
    props = cd.card_props(part_pages(spark, folder, markup.content(*markup.card())))
    return props.select(
        "page_id", "title", "description", F.array_join("badges", ",").alias("badges"), F.array_join("notes", ",").alias("notes"),
        F.posexplode("rows").alias("pos", "r"),
    ).select("page_id", "title", "description", "badges", "notes", (F.col("pos") + 1).alias("pos"), "r.label", "r.value")


def _flat_card(c, prefix: str = ""):
    show = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return [
        c["name"].alias(prefix + "name"),
        F.array_join(F.transform(c["hotkeys"], lambda h: F.concat(h["type"], F.lit("="), h["key"])), ";").alias(prefix + "hotkeys"),
        show(c["metadata"]).alias(prefix + "metadata"), c["description"].alias(prefix + "description"),
        show(c["traits"]).alias(prefix + "traits"), F.array_join(c["extra_descriptions"], ";").alias(prefix + "extras"),
        show(c["costs"]).alias(prefix + "costs"), c["lore"].alias(prefix + "lore"), show(c["tabs"]).alias(prefix + "tabs"),
    ]


SQL_CARD = """'Default Hotkey=Q' || p_size % 9 AS hotkeys, 'Ability=' || p_type || ';Affects=En' AS metadata,
    'Moves ' || p_size || ' far' AS description, 'Radius=5' || p_size || ';radius=400' AS traits, 'one;note ' || p_partkey AS extras,
    'Cooldown Time=' || p_size || ';Mana=60' AS costs, 'Lore of ' || p_type AS lore"""


@query(f"SELECT p_partkey AS page_id, p_name AS name, {SQL_CARD}, 'Details=' || p_brand || chr(10) || 'deep ' || p_size AS tabs FROM part")
def card_struct(spark, folder):
    cards = cd.spellcards(part_pages(spark, folder, markup.content(*markup.card())))
    return cards.select("page_id", *_flat_card(F.col("card")))


SQL_CARD_MARKDOWN = """concat_ws(chr(10), '', '> Moves ' || p_size || ' far', '', '*Restrictions:* ' || p_brand, '', '| Property | Value |', '|---|---|',
    '| Ability | ' || p_type || ' |', '| Affects | Enemies ' || p_size || ' |', '| Radius | ' || p_size || ' |', '| Cooldown | ' || p_size || ' |',
    '| Mana Cost | 60 |', '', '**Notes**', '', '- note ' || p_partkey, '', '**Show All**', '', '- ' || p_brand, '  - deep ' || p_size, '',
    '**Status Effects**', '', '- `mod_' || p_size || '` — effect')"""


@query(f"SELECT p_partkey AS page_id, '#### ' || p_name || chr(10) || {SQL_CARD_MARKDOWN} AS markdown FROM part")
def card_markdown(spark, folder):
    # Parsed twice: kept pages would be written out where they do not fit into memory, and are many times what either reading deals.
    pages = part_pages(spark, folder, markup.content(*markup.card()))
    return cd.card_markdown(cd.card_props(pages), cd.tab_blocks(pages)).select("page_id", "markdown")


# ---- Documents -------------------------------------------------------------------

@query(f"""
    SELECT p_partkey AS page_id, CASE WHEN p_type <> 'PROMO' THEN {SQL_BOX_MARKDOWN} || '#### Card' || chr(10) || {SQL_CARD_MARKDOWN}
        || chr(10) || chr(10) || chr(10) || chr(10) || '## About ' || p_name || chr(10) || chr(10) || 'Body ' || p_partkey END AS markdown,
        CASE WHEN p_type = 'PROMO' THEN 'page has no content element' END AS error
    FROM part
""")
def item_documents(spark, folder):
    return documents.item_markdown(documents.item_body(part_pages(spark, folder, markup.item_page())))


SQL_TOPIC = """concat_ws(chr(10), '# ' || s_name, '', '', '', '## On ' || s_name, '', 'intro ' || s_suppkey, '', '| K |', '|---|',
    '| val ' || s_nationkey || ' |', '', 'mid', '', '| Source | Ability |', '|---|---|', '| A | B' || s_nationkey || ' |', '', '')"""


@query(f"SELECT s_suppkey AS page_id, {SQL_TOPIC} AS markdown FROM supplier")
def topic_documents(spark, folder):
    docs = documents.topic_markdown(kept(documents.topic_body(supplier_nodes(spark, folder, markup.mechanics_page()))))
    names = plain(spark, folder, "supplier").select(F.col("s_suppkey").alias("page_id"), "s_name")
    return docs.join(names, "page_id").select("page_id", documents.with_title("s_name", "markdown").alias("markdown"))


@query(f"""
    SELECT 'nation ' || s_nationkey AS category, s_name AS name,
           CASE WHEN s_suppkey % 3 = 0 THEN 'first run ' || s_nationkey ELSE {SQL_TOPIC} END AS markdown
    FROM supplier
""")
def document_store(spark, folder):
    docs = documents.topic_markdown(kept(documents.topic_body(supplier_nodes(spark, folder, markup.mechanics_page()))))
    names = plain(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("name"), "s_nationkey",
        F.concat(F.lit("nation "), "s_nationkey").alias("category"))
    path = stores.scratch_dir(spark, "docs")
    # Two runs: what the second one writes again is replaced, the rest stays, and an empty text writes nothing.
    first = F.concat(F.lit("first run "), "s_nationkey")
    stores.write_docs(names.select("category", "name", first.alias("markdown")), path)
    again = docs.join(names, "page_id").withColumn("markdown", documents.with_title("name", "markdown"))
    empty = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("markdown"))
    stores.write_docs(again.select("category", "name", empty.alias("markdown")), path)
    return stores.read_docs(spark, path)


@query("""
    SELECT s_suppkey AS page_id, '#### Card ' || s_suppkey || CASE WHEN s_suppkey % 5 <> 4
           THEN concat(chr(10), chr(10), '**Show All**', chr(10), chr(10), '- item ', s_nationkey) ELSE '' END AS markdown
    FROM supplier
""")
def paired_tabs(spark, folder):
    nodes = kept(supplier_nodes(spark, folder, markup.pairing_page()))
    return cd.card_markdown(cd.card_props(nodes), cd.tab_blocks(nodes)).select("page_id", "markdown")


@query("""
    SELECT s_suppkey AS page_id, (s_suppkey % 4)::BIGINT AS ahead, least(s_suppkey % 4, 2)::BIGINT AS taken, (s_nationkey % 3 + s_suppkey % 4 + 1)::BIGINT AS rows
    FROM supplier
""")
def leading_rows(spark, folder):
    rows = kept(children(supplier_nodes(spark, folder, markup.leading_page()), tag("main")))
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    ahead = count(until(rows, F.col("tag") == "h2", ["page_id"]), "ahead")
    taken = count(take_while(rows, F.col("tag") == "p", 2, ["page_id"]), "taken")
    out = count(rows, "rows").join(ahead, "page_id", "left").join(taken, "page_id", "left")
    return out.select("page_id", F.coalesce("ahead", F.lit(0)).alias("ahead"), F.coalesce("taken", F.lit(0)).alias("taken"), "rows")


# ---- Entity records ---------------------------------------------------------------

@query("""
    SELECT p_partkey AS page_id, t.* FROM part, LATERAL (VALUES
        ('strength', 'primary', p_size::VARCHAR, '2.8'), ('agility', 'secondary', '20', p_size::VARCHAR)) t(attribute, type, base_attribute, attribute_gain)
""")
def attributes(spark, folder):
    blocks = records.entity_blocks(part_pages(spark, folder, markup.entity_page()), box="stats")
    # Of a bare column Spark would ask first whether it is empty, and work it out twice for that.
    return blocks.select("page_id", F.inline(F.coalesce("attributes", F.array().cast(ATTRIBUTES))))


SQL_STATS = """'6' || p_size AS base_health, '2.5' AS base_health_regeneration,
    CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE p_size || '7' END AS base_mana, CASE WHEN p_size % 5 <> 0 THEN '0.5' END AS base_mana_regeneration,
    p_size::VARCHAR AS base_armor, '25%' AS base_magic_resistence, p_size || '-99' AS base_damage, '(' || p_size || ' Avg)' AS base_average_damage,
    '9' || p_size AS projectile_speed, '150' AS attack_range, '5' || p_size AS acquisition_range, p_size::VARCHAR AS attack_speed,
    '0.4' AS attack_animation, '3' || p_size AS day_movement_speed, '0.' || p_size AS turn_rate, '24' AS collision_size,
    CASE WHEN p_size % 3 = 0 THEN 'bad' ELSE p_size::VARCHAR END AS bound_radius, '18' || p_size AS day_vision_range, '800' AS night_vision_range"""


@query(f"SELECT p_partkey AS page_id, {SQL_STATS} FROM part")
def stats(spark, folder):
    return records.basic_stats(part_pages(spark, folder, markup.entity_page())).drop("attributes")


@query("""
    SELECT p_partkey AS page_id, p_type || ',Durable' AS roles, '2/3' AS complexity, p_brand || ',Mean' AS adjectives, '2' AS num_legs,
           p_name || ',Helix' AS abilities, 'First ' || p_partkey || chr(10) || 'Second line' || chr(10) AS summary
    FROM part
""")
def summary(spark, folder):
    s = records.summary_info(part_pages(spark, folder, markup.entity_page())).select("page_id", "summary_info.*")
    return s.select("page_id", F.array_join("roles", ",").alias("roles"), "complexity", F.array_join("adjectives", ",").alias("adjectives"),
                    "num_legs", F.array_join("abilities", ",").alias("abilities"), "summary")


@query("""
    SELECT p_partkey AS page_id, 'The ' || p_name AS title, 'Born in ' || p_brand || '.' AS lore_summary, 'One=new ' || p_partkey AS facets,
           's ' || p_partkey AS scepter, 'h1' || chr(10) || chr(10) || 'h ' || p_size AS shard, '25=L' || p_size || '/R' || p_partkey AS talents,
           '' AS errors
    FROM part WHERE p_type <> 'PROMO'
    UNION ALL SELECT p_partkey, NULL, NULL, 'One=new ' || p_partkey, 's ' || p_partkey, 'h1' || chr(10) || chr(10) || 'h ' || p_size,
           '25=L' || p_size || '/R' || p_partkey, 'no biography' FROM part WHERE p_type = 'PROMO'
""")
def biography_and_blocks(spark, folder):
    b = records.entity_blocks(part_pages(spark, folder, markup.entity_page()))
    pairs = lambda m, show: F.array_join(F.transform(F.map_entries(m), show), ";")
    return b.select(
        "page_id", "title", "lore_summary",
        pairs("facets", lambda e: F.concat(e["key"], F.lit("="), e["value"]["description"])).alias("facets"),
        F.col("scepter_upgrade_info").alias("scepter"), F.col("shard_upgrade_info").alias("shard"),
        pairs("talent_tree", lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]["left"], F.lit("/"), e["value"]["right"])).alias("talents"),
        F.array_join("errors", ";").alias("errors"),
    )


@query("""
    SELECT p_partkey AS page_id, concat_ws(';', CASE p_size % 4
        WHEN 2 THEN 'summary without its abilities' WHEN 0 THEN 'base_health_regeneration could not be read'
        WHEN 1 THEN 'attack_range could not be read;acquisition_range could not be read' END,
        CASE WHEN p_type = 'PROMO' THEN 'no biography' END) AS errors
    FROM part
""")
def record_errors(spark, folder):
    b = records.entity_blocks(part_pages(spark, folder, markup.flawed_entity_page()))
    return b.select("page_id", F.array_join("errors", ";").alias("errors"))


def _records(spark, folder):
    nodes = part_pages(spark, folder, markup.entity_page())
    names = plain(spark, folder, "part").select(
        F.col("p_partkey").alias("page_id"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"))
    return records.entity_records(nodes, names)


@query(f"""
    SELECT p_partkey AS page_id, 0 AS pos, 'Inn ' || p_type AS name, {SQL_CARD}, '' AS tabs FROM part
    UNION ALL SELECT p_partkey, 1, p_name, {SQL_CARD}, 'Details=' || p_brand || chr(10) || 'deep ' || p_size FROM part
    UNION ALL SELECT p_partkey, 2, 'Helix', {SQL_CARD}, '' FROM part
""")
def abilities(spark, folder):
    rows = _records(spark, folder).select("page_id", F.posexplode(F.concat(F.array("innate"), "abilities")).alias("pos", "c"))
    flat = rows.select("page_id", "pos", *_flat_card(F.col("c")))
    return flat.withColumn("tabs", F.coalesce("tabs", F.lit("")))


SQL_TYPED = """try_cast('6' || p_size AS INT) AS base_health, 2.5::DOUBLE AS base_health_regeneration,
    CASE WHEN p_size % 5 <> 0 THEN try_cast(p_size || '7' AS INT) END AS base_mana, CASE WHEN p_size % 5 <> 0 THEN 0.5::DOUBLE END AS base_mana_regeneration,
    try_cast('3' || p_size AS INT) AS day_movement_speed, 24 AS collision_size, CASE WHEN p_size % 3 <> 0 THEN p_size END AS bound_radius,
    try_cast('18' || p_size AS INT) AS day_vision_range, 800 AS night_vision_range,
    concat_ws(';', CASE WHEN p_size % 5 = 0 THEN 'base_mana is not int' END, CASE WHEN p_size % 3 = 0 THEN 'bound_radius is not int' END) AS type_errors"""
TYPED = [name for name, kind in STAT_TYPES.items() if kind != "string"]


@query(f"SELECT p_partkey AS page_id, p_name || ' ' || p_partkey AS name, {SQL_TYPED} FROM part")
def records_typed(spark, folder):
    r = records.conform(_records(spark, folder))
    return r.select("page_id", "name", *[F.col(f"basic_stats.{n}").alias(n) for n in TYPED], F.array_join("type_errors", ";").alias("type_errors"))


SQL_CONFORMED = """
    SELECT p_partkey AS page_id, CASE WHEN p_size % 4 <> 0 THEN '2' END AS num_legs,
           CASE WHEN p_size % 5 <> 0 THEN try_cast(p_size || '7' AS INT) END AS base_mana,
           p_size::VARCHAR AS base_attribute, CASE WHEN p_size % 4 <> 2 THEN '2.8' END AS attribute_gain,
           concat_ws(';', CASE p_size % 4 WHEN 0 THEN 'summary_info is missing' WHEN 1 THEN 'summary_info.roles is missing'
                          WHEN 2 THEN 'basic_stats.attributes[0].attribute_gain is missing' END,
                     CASE WHEN p_size % 5 = 0 THEN 'basic_stats.base_mana is not int' END,
                     CASE WHEN p_size % 3 = 0 THEN 'basic_stats.bound_radius is not int' END) AS type_errors
    FROM part
"""


@query(SQL_CONFORMED)
def records_conformed(spark, folder):
    r = conform.conformed(records.entity_records(part_pages(spark, folder, markup.conform_page())), conform.RECORD)
    first = F.get("basic_stats.attributes", F.lit(0))
    return r.select(
        "page_id", "summary_info.num_legs", "basic_stats.base_mana", first["base_attribute"].alias("base_attribute"),
        first["attribute_gain"].alias("attribute_gain"), F.array_join("type_errors", ";").alias("type_errors"))


@query("""
    SELECT p_name || ' ' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'run 1: ' END || '6' || p_size AS base_health,
           2 AS n_abilities, p_type || ',Durable' AS roles,
           'L' || p_size AS talent_left, '' AS main_attribute
    FROM part WHERE p_type <> 'PROMO'
""")
def record_store(spark, folder):
    path = stores.scratch_dir(spark, "records")
    _records(spark, folder).where(F.size("errors") == 0).drop("page_id", "errors").write.parquet(f"{path}-extracted")
    good = spark.read.parquet(f"{path}-extracted")
    # The second run holds the records of even sizes only; its files sort before or after by chance.
    first = F.col("basic_stats").withField("base_health", F.concat(F.lit("run 1: "), F.col("basic_stats.base_health")))
    stores.write_records(good.withColumn("basic_stats", first), path)
    stores.write_records(good.where(F.col("basic_stats.base_health").substr(2, 9).cast("int") % 2 == 0), path)
    back = stores.read_records(spark, path)
    return back.select(
        "name", F.col("basic_stats.base_health").alias("base_health"), F.size("abilities").alias("n_abilities"),
        F.array_join("summary_info.roles", ",").alias("roles"), F.element_at("talent_tree", F.lit(25))["left"].alias("talent_left"), "main_attribute",
    )


# ---- Lookups and pairings -----------------------------------------------------------

@query("""
    SELECT c_custkey, replace(lower('Nation ' || (c_nationkey + 3)), ' ', '_') AS slug, n_regionkey AS region
    FROM customer LEFT JOIN nation ON replace(lower('Nation ' || (c_nationkey + 3)), ' ', '_') = lower(n_name)
""")
def entity_lookup(spark, folder):
    asked = plain(spark, folder, "customer").select(
        "c_custkey", fx.slug(F.concat(F.lit("Nation "), F.col("c_nationkey") + 3)).alias("slug"))
    known = plain(spark, folder, "nation").select(F.lower("n_name").alias("slug"), F.col("n_regionkey").alias("region"))
    return lookup(asked, known, "slug").select("c_custkey", "slug", "region")


DISPLAY = ("Axe", "Keeper of the Light", "Anti-Mage", "Nature's Prophet", "Kez", "Nobody")


@query("""
    SELECT c_custkey, replace(lower(name), ' ', '_') AS exact, exact_group, loose_group
    FROM (SELECT c_custkey, c_nationkey % 6 AS k FROM customer) JOIN (VALUES
        (0, 'Axe', 'strength', 'strength'), (1, 'Keeper of the Light', 'intelligence', 'intelligence'), (2, 'Anti-Mage', NULL, 'agility'),
        (3, 'Nature''s Prophet', NULL, 'universal'), (4, 'Kez', 'agility', 'agility'), (5, 'Nobody', NULL, NULL)) t(k, name, exact_group, loose_group) USING (k)
""")
def entity_domain(spark, folder):
    name = F.element_at(F.array(*map(F.lit, DISPLAY)), F.col("c_nationkey") % 6 + 1)
    return plain(spark, folder, "customer").select(
        "c_custkey", fx.slug(name).alias("exact"), in_domain(fx.slug(name), ENTITY_NAMES).alias("exact_group"),
        in_domain(fx.slug(name, loose=True), ENTITY_NAMES).alias("loose_group"),
    )


@query("""
    SELECT p_partkey AS page_id, t.* FROM part, LATERAL (VALUES (1, 'Cooldown Time', p_size::VARCHAR), (2, 'Mana', '60')) t(rn, label, amount)
""")
def zipped_costs(spark, folder):
    pages = part_pages(spark, folder, markup.content(*markup.card()))
    labelled = pages.withColumn("nodes", F.transform("nodes", lambda e: e.withField("label", e["attrs"].getItem("title"))))
    icons = subtree_text(labelled, lambda e: (e["tag"] == "a") & e["label"].isNotNull(), "label", text="raw").select("page_id", "start", "label")
    amounts = subtree_text(pages, lambda e: F.array_contains(e["classes"], "spellcost_value"), amount="spaced").select("page_id", "start", "amount")
    return zip_rows(icons, amounts, ["page_id"]).select("page_id", "rn", "label", "amount")


@query("SELECT p_partkey AS page_id, upper(p_name) || ' II' AS text FROM part UNION ALL SELECT p_partkey, 'helix' FROM part")
def ability_headings(spark, folder):
    # Parsed twice: only headings and names are dealt, where one parse would be kept or its nodes exchanged.
    pages = part_pages(spark, folder, markup.entity_page())
    named = records.summary_info(pages).select("page_id", F.col("summary_info.abilities").alias("names"))
    heads = subtree_text(pages, lambda e: e["tag"] == "h3", text="spaced")
    return prefix_semi(heads, named).select("page_id", "text")


@query("""
    SELECT p_partkey, p_name || ' ' || p_size AS collapsed, CASE WHEN p_size % 2 = 0 THEN p_name ELSE CASE WHEN p_size < 10 THEN 'a' || p_size || 'x' ELSE right(p_size::VARCHAR, 1) || 'x' END END AS uncoded,
           p_size || ' ' AS left_side_untrimmed, p_size::VARCHAR AS left_side, p_type AS right_side, NULL::VARCHAR AS no_side,
           p_brand AS label, p_size || ':' || p_type AS value, '' AS no_value, p_type AS bold_value,
           lower(p_name) AS heading, p_name AS heading_title,
           CASE WHEN p_size % 2 = 0 THEN p_size || ' seconds' ELSE p_size || '.x' END AS seconds, p_name AS uncosted, p_name AS priced,
           CASE p_type WHEN 'ECONOMY' THEN 'Cooldown' WHEN 'SMALL' THEN 'Mana Cost' WHEN 'LARGE' THEN 'Health Cost' ELSE p_brand END AS cost,
           CASE WHEN p_size % 2 = 0 THEN p_name || '|' || p_brand ELSE 'HUD' END AS parts, p_type || ',x' AS before, p_brand AS behind,
           '-' AS dashed, p_type AS first_filled
    FROM part
""")
def text_functions(spark, folder):
    even = markup.PART.size % 2 == 0
    h = markup.html
    name, brand, kind, size = markup.PART.name, markup.PART.brand, markup.PART.type, markup.PART.size
    before, behind = fx.around(F.array(kind, F.lit("x"), name, brand), name)
    cost = F.when(kind == "ECONOMY", "the COOLDOWN and mana").when(kind == "SMALL", "mana").when(kind == "LARGE", "Cost of health").otherwise(brand)
    return plain(spark, folder, "part").select(
        "p_partkey", fx.collapse(h(" \t", name, " \n  ", size, " ")).alias("collapsed"),
        fx.strip_sort_code(F.when(even, h("b", size, " ", name)).otherwise(h("a", size, "x"))).alias("_code"),
        h(size, " ").alias("left_side_untrimmed"), fx.split_side(h(size, " + ", kind), "+", 0).alias("left_side"),
        fx.split_side(h(size, " + ", kind), "+", 1).alias("right_side"), fx.split_side(h(size, " ", kind), "+", 1).alias("no_side"),
        fx.label_of(h(brand, ": ", size, ":", kind)).alias("label"), fx.value_of(h(brand, ": ", size, ":", kind)).alias("value"),
        fx.value_of(brand).alias("no_value"), fx.after_label(h(brand, " : ", kind), brand).alias("bold_value"),
        fx.heading_key(h(" ", F.upper(name), "[Edit] ")).alias("heading"), fx.heading_title(h(" ", name, "[edit]")).alias("heading_title"),
        fx.with_seconds(F.lit(" Stock "), F.when(even, h(size)).otherwise(h(size, ".x"))).alias("seconds"),
        fx.strip_cost(h(name, " (12.5) ")).alias("uncosted"), fx.priced_name(h(name, " (", size, " )")).alias("priced"),
        fx.cost_label(cost).alias("cost"),
        F.array_join(fx.title_parts(F.when(even, h(name, "/", brand)).otherwise("The Head-up display (HUD)")), "|").alias("parts"),
        F.array_join(before, ",").alias("before"), F.array_join(behind, ",").alias("behind"),
        fx.dash(F.when(even, F.lit(""))).alias("dashed"), fx.first_filled(F.lit(""), F.lit(None).cast("string"), kind, brand).alias("first_filled"),
    ).withColumnRenamed("_code", "uncoded")


@query("""
    SELECT p_partkey AS page_id, 'Part ' || p_partkey || chr(10) || chr(10) || '1. ' || p_name || chr(10) || '2. ' || p_brand || chr(10) || '  - deep'
        || chr(10) || chr(10) || '| Size | Type |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_size || ' | ' || p_type || ' |' || chr(10) || chr(10)
        || '> said ' || p_size || chr(10) || '> ' || chr(10) || '> again' || chr(10) || chr(10) || '```' || chr(10) || '  a  b' || chr(10) || '   ' || p_size || chr(10)
        || '```' || chr(10) || chr(10) || 'end' AS markdown
    FROM part
""")
def rich_markdown(spark, folder):
    return documents.html_to_markdown(part_nodes(spark, folder, markup.rich_page())).select("page_id", "markdown")


# ---- Conversations ---------------------------------------------------------------------

SQL_HISTORY = """
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END AS kind, text FROM conversations WHERE role IN ('user', 'assistant')
"""


def _history(spark, folder):
    return chat.rebuild_history(stores.read_conversations(spark, f"{folder}/conversations.parquet"))


@query(SQL_HISTORY)
def history(spark, folder):
    return _history(spark, folder)


@query(f"""
    SELECT conv_id, turn, kind, text, 0 AS rank FROM ({SQL_HISTORY})
    UNION ALL SELECT conv_id, turn + 1000, CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'tool' ELSE 'ai' END, text,
        CASE role WHEN 'user' THEN 1 WHEN 'system' THEN 2 ELSE 3 END FROM conversations
""")
def history_append(spark, folder):
    steps = stores.read_conversations(spark, f"{folder}/conversations.parquet")
    new = steps.withColumn("turn", F.col("turn") + 1000)
    return chat.append_turns(
        _history(spark, folder), new.where("role = 'user'"), new.where("role = 'system'"), new.where("role = 'assistant'"))


@query(f"""
    SELECT conv_id, 'System: You answer questions about game characters. Look up facts with the tools before you answer, and write Markdown.' || chr(10) || 'Human: User message: '
        || coalesce(max_by(text, turn) FILTER (kind = 'human'), '') || ' ' || chr(10) || chr(10) || ' Chat History: '
        || string_agg(kind || ': ' || text, chr(10) ORDER BY turn) AS prompt
    FROM ({SQL_HISTORY}) GROUP BY conv_id
""")
def prompts(spark, folder):
    return chat.prompts(_history(spark, folder))


def _runs(spark, folder):
    user = F.col("user_id").cast("string")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    keys = (F.when(F.col("event_type") == "click", "session_id").when(F.col("event_type") == "view", "conversation_id")
            .when(F.col("event_type") == "error", "other_id").otherwise("thread_id"))
    return plain(spark, folder, "events").select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "signup", "other").otherwise("wiki").alias("project"),
        F.lit("llm").alias("run_type"), F.create_map(keys, user).alias("metadata"), F.col("ts").cast("timestamp").alias("start_time"),
        F.array(message("system", F.lit("hello")), message("user", F.col("props"))).alias("messages"),
        message("assistant", F.col("event_type")).alias("output"),
    )


@query("""
    SELECT user_id::VARCHAR AS thread, t.* FROM (
        SELECT user_id, arg_max(props, (ts, event_id)) AS props, arg_max(event_type, (ts, event_id)) AS said FROM events
        WHERE event_type NOT IN ('signup', 'error') GROUP BY user_id),
        LATERAL (VALUES (0, 'system', 'hello'), (1, 'user', props), (2, 'assistant', said)) t(pos, role, text)
""")
def latest_state(spark, folder):
    state = chat.thread_state(stores.runs_by_thread(_runs(spark, folder), "wiki"))
    return state.select("thread", F.posexplode("messages").alias("pos", "m")).select("thread", "pos", "m.role", "m.text")


def _model_events(events):
    """Events as recorded model events: a run is one user's day, views end a pass with a call."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    call = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.when(F.col("value") > 30, "get_region").when(F.col("value") > 10, "get_nation").otherwise("get_part").alias("name"),
        F.get_json_object("props", "$.k").alias("arg"),
    )
    is_end = F.col("event_type") == "view"
    return events.select(
        F.col("user_id").alias("conv_id"), F.concat_ws("-", F.date_format(day, "yyyyMMdd"), "user_id").alias("run_id"),
        day.alias("run_started_at"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", 2).otherwise(1).alias("pass"),
        F.when(is_end, chat.END).when(F.col("event_type") == "signup", "on_chain_start").otherwise(chat.STREAM).alias("event"),
        F.concat("event_type", F.lit(" ")).alias("chunk"),
        F.when(is_end & (F.col("value") > 5), F.array(call)).alias("tool_calls"),
    )


def _registry(spark, folder):
    nation = plain(spark, folder, "nation").select("n_nationkey", "n_name")
    part = plain(spark, folder, "part").select("p_partkey", "p_name")
    return {"get_nation": (nation, "n_nationkey"), "get_part": (part, "p_partkey")}


SQL_CALLS = """
    SELECT user_id AS conv_id, strftime(ts, '%Y%m%d') || '-' || user_id AS run_id, event_id::VARCHAR AS tool_call_id,
           CASE WHEN value > 30 THEN 'get_region' WHEN value > 10 THEN 'get_nation' ELSE 'get_part' END AS name,
           json_extract_string(props, '$.k') AS arg FROM events WHERE event_type = 'view' AND value > 5
"""
SQL_RESPONSES = f"""
    SELECT c.*, CASE name WHEN 'get_nation' THEN n_name WHEN 'get_part' THEN p_name END AS found,
           CASE WHEN name = 'get_region' THEN 'unknown tool get_region' END AS error
    FROM ({SQL_CALLS}) c LEFT JOIN nation ON n_nationkey::VARCHAR = arg LEFT JOIN part ON p_partkey::VARCHAR = arg
"""


def _found(responses):
    name = F.coalesce(F.get_json_object("content", "$.n_name"), F.get_json_object("content", "$.p_name"))
    return responses.select("conv_id", "run_id", "tool_call_id", "name", "arg", name.alias("found"), "error")


@query(SQL_RESPONSES)
def tool_responses(spark, folder):
    calls = chat.tool_calls(_model_events(plain(spark, folder, "events")))
    return _found(chat.dispatch(calls, _registry(spark, folder)))


@query(f"SELECT DISTINCT run_id FROM ({SQL_CALLS}) WHERE name <> 'get_region'")
def continued_runs(spark, folder):
    events = _model_events(plain(spark, folder, "events"))
    responses = chat.dispatch(chat.tool_calls(events), _registry(spark, folder))
    return chat.with_tools(events.select("run_id").distinct(), responses)


# Only a call of a known tool starts the second pass; get_region is none.
SQL_ANSWERS = """
    SELECT conv_id, run_id, coalesce(string_agg(c, '' ORDER BY seq) FILTER (p = 1), '')
        || CASE WHEN bool_or(called) THEN coalesce(string_agg(c, '' ORDER BY seq) FILTER (p = 2), '') ELSE '' END AS text
    FROM (SELECT user_id AS conv_id, strftime(ts, '%Y%m%d') || '-' || user_id AS run_id, event_id AS seq,
                 CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END AS p, CASE WHEN event_type NOT IN ('view', 'signup') THEN event_type || ' ' END AS c,
                 event_type = 'view' AND value > 5 AND value <= 30 AS called FROM events)
    GROUP BY conv_id, run_id
"""


@query(SQL_ANSWERS)
def answers(spark, folder):
    return chat.answers(_model_events(plain(spark, folder, "events")), tuple(_registry(spark, folder)))


# ---- Streams ---------------------------------------------------------------------------

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream_table(spark, folder, name, schema):
    """A table as a stream, whether it is one file or a folder of part files; a source takes a file by a pattern only."""
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _event_stream(spark, folder):
    return _model_events(_stream_table(spark, folder, "events", EVENTS))


@query(SQL_ANSWERS.replace("FROM events)", "FROM events WHERE event_type <> 'signup')"))
def stream_messages(spark, folder):
    out = stores.scratch_dir(spark, "messages")
    events = _event_stream(spark, folder)
    messages.land_events(events, f"{out}/table", f"{out}/checkpoint", tuple(_registry(spark, folder)))
    return messages.read_messages(spark, f"{out}/table")


@query(SQL_RESPONSES)
def stream_tools(spark, folder):
    out = stores.scratch_dir(spark, "tools")
    responses = _found(messages.stream_responses(_event_stream(spark, folder), _registry(spark, folder)))
    messages.run_available(responses, f"{out}/table", f"{out}/checkpoint")
    return spark.read.schema(responses.schema).parquet(f"{out}/table")


@query(SQL_HISTORY)
def stream_history(spark, folder):
    out = stores.scratch_dir(spark, "history")
    steps = _stream_table(spark, folder, "conversations", "conv_id long, turn long, role string, text string")
    messages.session_history(steps, f"{out}/table", f"{out}/checkpoint")
    return chat.rebuild_history(stores.read_conversations(spark, f"{out}/table"))
