"""Pages as one row each, and card plans over them."""

from pyspark.sql import functions as F

from pageloom import bindings
from pageloom.operators.select import first_inside, has_class, inside
from pageloom.plans import cards, documents
from pageloom.sources.htmltree import html_nodes, html_pages
from samples import CARD, TABS, content

WRAPPED = '<div class="spellcard-wrapper"><div class="spellcard"><b>in</b></div></div>'
PAGES = [
    content(CARD + TABS + "</div>", "<p>between</p>", CARD + "</div>", TABS),
    f'<p style="display:none">x{CARD}</div></p>', WRAPPED.replace("in", WRAPPED), "<p>none</p>", None,
    '<div class="spellcard-wrapper"><p class="spellcard">no target</p></div>' + CARD.replace('"spelldesc"', '"spelldesc" style="display:none"') + "</div>",
]


def _pages(spark, more=()):
    return spark.createDataFrame([*enumerate(PAGES), *more], "page_id long, html string")


def test_cards_of_pages_are_those_of_nodes(spark):
    for plan in (cards.spellcards, cards.card_props):
        one, many = (plan(form(_pages(spark))).orderBy("page_id", "start").collect() for form in (html_pages, html_nodes))
        assert one == many and len(one) >= 5


LISTS = [
    "<ul><li>a<ul><li>b</li></ul>tail</li><li>c<ol><li>d<div><ul><li>apart</li></ul></div></li></ol></li></ul>",
    "<ul><p>loose</p><ul><li>in a list</li></ul><li><span title=T>x</span><img alt=I><br>e</li></ul><ol><li>no top</li></ol>",
    "<ol><li>x<ul><li>own top</li><li style='display:none'>gone</li></ul></li></ol><ul><li></li><li>two<li>three</ul>",
]


def test_tab_lines_are_the_bullets_of_their_content(spark):
    pages = [f'<div class="tabs-dynamic">{x}<div class="tabs-content">{x}</div><div class="tabs-content"><ul><li>no</li></ul></div></div>' for x in LISTS]
    pages.append("".join(pages) + '<div class="tabs-dynamic"><div><tt>c</tt><div>no content</div></div></div>')
    given = spark.createDataFrame([*enumerate(pages)], "page_id long, html string")
    nodes = html_nodes(given).persist()
    marked = first_inside(inside(nodes, has_class("tabs-dynamic"), "tabs"), has_class("tabs-content"), "content", "tabs")
    want = {}
    for r in cards.bullets(marked, F.col("start") == F.col("content.start"), "tabs").orderBy("page_id", "start").collect():
        want.setdefault((r.page_id, r.area.tabs.start), []).append(r.line)
    for form in (nodes, html_pages(given)):
        got = cards.tab_blocks(form).collect()
        assert len(got) == 7 and {(r.page_id, r.start): r.lines for r in got if r.lines} == want


def test_rows_of_one_id_are_one_page(spark):
    pages = html_pages(spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>a</p>"), (2, "x")], "page_id long, html string"))
    got = {r.page_id: [n.start for n in r.nodes] for r in pages.collect()}
    assert got == {1: [0, 0, 1, 1, 2, 2], 2: [0, 1]}


def test_card_queries_exchange_no_nodes(spark, tmp_path):
    """Only the rows that pages are built from are dealt: nodes are some hundred times their size."""
    spark.createDataFrame([(i, f"n{i}", "b", "t", 5) for i in range(8)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int") \
        .write.parquet(f"{tmp_path}/part.parquet")
    for name in ("card_props", "card_struct", "card_markdown"):
        found = bindings.QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert found.count() > 0 and plan.count("RepartitionByExpression") == plan.count("MapInArrow")
        assert "RepartitionByExpression" not in plan[:plan.index("MapInArrow")]


def test_item_documents_exchange_and_keep_no_nodes(spark, tmp_path):
    spark.createDataFrame([(i, f"n{i}", "b", "t", 5) for i in range(8)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int") \
        .write.parquet(f"{tmp_path}/part.parquet")
    for name in ("item_documents", "infobox_rows"):
        plan = bindings.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Window [" not in plan and "InMemoryTableScan" not in plan, name


def test_items_of_pages_are_those_of_nodes(spark):
    both, one = ('<table class="%s">' % c for c in ("fo-nttax-infobox-wrapper fo-nttax-infobox", "fo-nttax-infobox"))
    rows = '<tr><td><table style="text-align:left"><tr><th>A</th><td>1</td></tr><tr><td>2</td></tr></table></td></tr></table>'
    pages = [
        # An empty card hides nothing, a block in a heading stands behind it, the outer one of two blocks wins.
        content('<div class="spellcard-wrapper"><div class="spellcard"><i></i></div>in', both, rows, "</div>tail"),
        content("<h2>H", both, rows, "</h2>between", both, CARD, TABS, "</div>", rows, one, rows, "end"),
        'out<div class="toc">' + content('<div id="toc">x</div>a<div class="navigation-not-searchable">b', TABS, '</div><div class="navigation-not-searchable">c</div>'),
        "<p>none</p>", None,
    ]
    given = spark.createDataFrame([*enumerate(pages), (None, "x")], "page_id long, html string")
    many, one_row = (sorted(map(tuple, documents.item_markdown(documents.item_body(form(given))).collect()), key=str) for form in (html_nodes, html_pages))
    got = {r[0]: r[1:] for r in one_row}
    table = "| Property | Value |\n|---|---|\n| A | 1 · 2 |\n\n"
    assert many == one_row and len(got) == 6
    assert got[0][0].endswith("in" + table + "tail") and got[1][0].startswith("\n\n## HA12\n\n" + table + "between") and got[1][0].endswith("end")
    assert "#### " not in got[1][0] and got[2][0].startswith("a") and got[2][0].count("c") <= TABS.count("c") and "x" not in got[2][0][:2]
    assert got[3] == (None, documents.NO_CONTENT) and got[None] == (None, documents.NO_CONTENT) and "no html" in got[4][1]
