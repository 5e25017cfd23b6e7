"""Work lists read off catalogue pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import heading_key, heading_title, non_empty, priced_name, strip, title_parts
from pageloom.operators.match import last_per, ordered_list
from pageloom.operators.order import after_heading, children, with_keyed_section, with_section
from pageloom.operators.select import attr, content, has_class, inside, so_far, tag
from pageloom.operators.text import subtree_text
from pageloom.schema import SHOP_CATEGORIES, TIER_SECTIONS

def link_texts(nodes: DataFrame, around: Column | None = None) -> DataFrame:
    """Links inside the matching elements: page_id, start, href, text."""
    around = has_class("heroes-panel__hero-card__title") if around is None else around
    marked = inside(nodes.withColumn("href", attr("href")), around, "_box")
    link = tag("a") & F.col("_box").isNotNull()
    return subtree_text(marked, link, "href", text="lines").drop("end")


def _lines(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("page_id", "start", *keep, F.posexplode(F.split("next.text", "\n")).alias("pos", "line"))


def shop_catalog(nodes: DataFrame, root: Column | None = None,
                 categories: tuple[str, ...] = SHOP_CATEGORIES) -> DataFrame:
    """Priced names in the element after each allowed ``h3``: page_id, start, category, pos, name."""
    rows = children(nodes, content() if root is None else root).withColumn("category", heading_key("text"))
    found = after_heading(
        rows, (F.col("tag") == "h3") & F.col("category").isin(*categories), fields=("text",)
    )
    return (
        _lines(found, "category").withColumn("name", priced_name("line"))
        .where(F.col("name").isNotNull()).drop("line")
    )


def tier_catalog(nodes: DataFrame, root: Column | None = None,
                 sections: dict[str, tuple[str, tuple[str, ...]]] = TIER_SECTIONS) -> DataFrame:
    """Names by tier inside the named sections: page_id, start, category, tier, pos, name."""
    rows = children(nodes, content() if root is None else root).withColumn("tier", heading_key("text"))
    rows = with_keyed_section(rows, F.col("tag") == "h2", F.col("tier"), list(sections))
    allowed, category = F.lit(False), F.lit(None).cast("string")
    for key, (name, tiers) in sections.items():
        here = F.col("section") == key
        allowed = allowed | (here & F.col("tier").isin(*tiers))
        category = F.when(here, name).otherwise(category)
    found = after_heading(
        rows.withColumn("category", category), (F.col("tag") == "h3") & F.coalesce(allowed, F.lit(False)),
        fields=("text",),
    ).where(F.col("next").isNotNull())
    return _lines(found, "category", "tier").withColumn("name", strip("line")).drop("line")


def topic_catalog(nodes: DataFrame, root: Column | None = None) -> DataFrame:
    """Main and sub titles from the table of each section.

    Result: page_id, category, title, parent_title, pos.  The latest table of a
    section replaces earlier ones, a row without a bold title is skipped, and a
    title with ``/`` stands for several that share the sub titles.
    """
    first = F.first(F.when(content() if root is None else root, F.col("start")), ignorenulls=True).over(so_far())
    marked = nodes.withColumn("is_child", F.coalesce(F.col("parent") == first, F.lit(False)) & ~tag("#text"))
    marked = inside(marked, F.col("is_child") & F.col("tag").startswith("table"), "tab")
    marked = inside(marked, tag("tr"), "tr", within=F.col("tab"))
    in_row = F.col("tr").isNotNull() & tag("td", "b", "li")
    rows = subtree_text(marked, F.col("is_child") | in_row, "tag", "is_child", "tab", "tr", text="lines")
    rows = with_section(
        rows, F.col("is_child") & F.col("tag").startswith("h"), heading_title("text"), "category"
    ).where(F.col("tab").isNotNull())

    by_section = Window.partitionBy("page_id", "category")
    rows = (
        rows.withColumn("_first", F.min("tab.start").over(by_section))
        .withColumn("_last", F.max("tab.start").over(by_section))
        .where((F.col("tab.start") == F.col("_last")) & F.col("tr").isNotNull())
    )
    cell = F.min(F.when(F.col("tag") == "td", F.struct("start", "end")))
    rows = rows.withColumn("_cell", cell.over(Window.partitionBy("page_id", "tr.start")))
    in_cell = (F.col("start") > F.col("_cell.start")) & (F.col("start") <= F.col("_cell.end"))
    titles = (
        rows.where(in_cell).groupBy("page_id", "category", "_first", F.col("tr.start").alias("_row"))
        .agg(
            F.min_by("text", F.when(F.col("tag") == "b", F.col("start"))).alias("_title"),
            ordered_list(F.when(F.col("tag") == "li", F.col("text"))).alias("_subs"),
        )
        .where(F.col("_title").isNotNull())
        .select("page_id", "category", "_first", "_row", "_subs",
                F.posexplode(title_parts("_title")).alias("_part", "title"))
    )
    main = F.struct("title", F.lit(None).cast("string").alias("parent_title"))
    subs = F.transform("_subs", lambda s: F.struct(s.alias("title"), F.col("title").alias("parent_title")))
    order = Window.partitionBy("page_id").orderBy("_first", "_row", "_part", "_nth")
    return (
        titles.select("page_id", "category", "_first", "_row", "_part",
                      F.posexplode(F.concat(F.array(main), subs)).alias("_nth", "_entry"))
        .select("page_id", "category", "_entry.title", "_entry.parent_title",
                F.row_number().over(order).alias("pos"))
    )


def titles_to_fetch(catalog: DataFrame) -> DataFrame:
    """One row per title; when a title comes up again the later entry wins."""
    return last_per(catalog.where(non_empty("title").isNotNull()), ["title"], F.struct("page_id", "pos"))
