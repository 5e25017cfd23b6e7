"""Pages and tables that must not end a job or lose a row."""

import random
import time

from pageloom.operators.match import in_domain
from pageloom.plans.documents import html_to_markdown
from pageloom.plans.tables import table_cells
from pageloom.sources import stores
from pageloom.sources.htmltree import html_nodes
from pageloom.sources.pages import read_table
from pyspark.sql import functions as F


def test_hostile_pages_are_errors_of_their_own(spark):
    pages = [(1, "<table><tr><td>a</td></tr></table>"), (2, "<span>" * 16_000), (3, '<table><tr><td colspan="2147483647">x</td></tr></table>'),
             (4, None), (5, "<div>" * 400 + "deep" + "</div>" * 400)]
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string")).cache()
    error = {r.page_id: r.e for r in nodes.groupBy("page_id").agg(F.max(F.expr("attrs['error']")).alias("e")).collect()}
    assert error[1] is None and error[2] is None and error[5] is None and set(error) == {1, 2, 3, 4, 5}
    assert "colspan" in error[3] and error[4]
    # As wide as a browser makes it.
    assert sorted((r.page_id, r.col, r.text) for r in table_cells(nodes).collect()) == [(1, 0, "a"), *((3, i, "x") for i in range(1000))]


def test_pages_beyond_bounds_are_whole(spark):
    """Deep nesting and giant spans lose no text, no link and no cell."""
    rows = '<tr><td>a</td><td>b</td><td>c</td></tr><tr><td colspan="{}">wide</td></tr><tr><td rowspan="99999">d</td><td colspan="9999">e</td></tr><tr><td colspan="9999">f</td></tr>'
    spans = lambda n: f'<p>before</p><table>{rows.format(n)}</table><a href="/x">after</a><i colspan="9999">i</i>'
    pages = [(1, spans(9999)), (2, spans("9" * 5000)), (3, "<font>" * 3000 + '<a href="/y"><b>deep</b></a>' + "</font>" * 3000 + "<p>end</p>")]
    nodes = html_nodes(spark.createDataFrame(pages, "page_id long, html string")).cache()
    text = {r.page_id: r.t for r in nodes.orderBy("start").groupBy("page_id").agg(
        F.concat_ws(" ", F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("start", "text"))))["text"]).alias("t")).collect()}
    assert text == {1: "before a b c wide d e f after i", 2: "before a b c wide d e f after i", 3: "deep end"}
    link = nodes.where("page_id = 3 AND tag = 'a'").first()
    assert link.depth == 3000 and link.attrs["href"] == "/y" and link.end == link.start + 2
    cells = {}
    for r in table_cells(nodes).collect():
        cells.setdefault(r.page_id, {})[r.row, r.col] = r.text
    grid = ["abc", ["wide"] * 3, "dee", "dff"]
    assert cells == {p: {(i, j): t for i, row in enumerate(grid) for j, t in enumerate(row)} for p in (1, 2)}
    errors = nodes.where("attrs['error'] IS NOT NULL").select("page_id", "tag").collect()
    assert sorted(map(tuple, errors)) == [(1, "table"), (2, "table")]
    markdown = html_to_markdown(nodes).collect()
    assert all(r.error is None and ("after" in r.markdown or "deep" in r.markdown) for r in markdown) and len(markdown) == 3


def test_tall_table_with_row_spans(spark):
    rows = "".join(f'<tr><td rowspan="2">a{i}</td><td>b{i}</td></tr><tr><td>end {i}</td></tr>' for i in range(1500))
    nodes = html_nodes(spark.createDataFrame([(1, f"<table>{rows}</table>")], "page_id long, html string"))
    cells = table_cells(nodes)
    assert cells.count() == 6000 and cells.where("row = 2999 AND col = 1").first().text == "end 1499"


def model_grid(rows):
    """{(row, column): text} of rows of (text, colspan, rowspan), cell by cell."""
    grid = {}
    for i, row in enumerate(rows):
        col = 0
        for text, wide, high in row:
            for _ in range(wide):
                while (i, col) in grid:
                    col += 1
                grid |= {(k, col): text for k in range(i, min(i + high, len(rows)))}
    return grid


def test_spans_match_a_plain_model(spark):
    rng = random.Random(4)
    tables = [[[(f"{t}.{i}.{j}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4, 90])) for j in range(rng.randint(1, 4))]
               for i in range(rng.randint(1, 9))] for t in range(120)]
    page = lambda rows: "<table>" + "".join(
        "<tr>" + "".join(f'<td colspan="{w}" rowspan="{h}">{t}</td>' for t, w, h in row) + "</tr>" for row in rows) + "</table>"
    got = {}
    for r in table_cells(html_nodes(spark.createDataFrame([(i, page(t)) for i, t in enumerate(tables)], "page_id long, html string"))).collect():
        got.setdefault(r.page_id, {})[r.row, r.col] = r.text
    assert got == {i: model_grid(t) for i, t in enumerate(tables)}


def test_spans_take_time_in_proportion(spark):
    """Four times the rows with row spans must not take more than about five times as long."""
    def seconds(n):
        rows = "".join(f'<tr><td rowspan="3">a{i}</td><td>b</td></tr><tr><td>c</td></tr><tr><td>d{i}</td></tr>' for i in range(n // 3))
        nodes = html_nodes(spark.createDataFrame([(1, f"<table>{rows}</table>")], "page_id long, html string")).cache()
        nodes.count()
        begin = time.time()
        assert table_cells(nodes).where("col = 1").count() == n // 3 * 3
        return time.time() - begin

    seconds(300)
    few, many = seconds(6000), seconds(24_000)
    assert many < 5 * few + 2


def test_lists_at_any_depth(spark):
    """The same list with 10 and with 600 elements between gives the same lines, and 300 nested lists all have a level."""
    from pageloom.plans.cards import bullets

    page = lambda n, tag: (f"<main>{f'<{tag}>' * n}<ul><li>top<ul><li>low</li></ul></li><li>next<div><ul><li>apart</li></ul></div></li>"
                           f"<ul><li>stray</li></ul></ul>{f'</{tag}>' * n}</main>")
    nest = "<main>" + "".join(f"<ul><li>item {k}" for k in range(300)) + "</li></ul>" * 300 + "</main>"
    nodes = html_nodes(spark.createDataFrame([(1, page(10, "span")), (2, page(600, "span")), (3, page(600, "div")), (4, nest)], "page_id long, html string"))
    lines = {}
    for r in bullets(nodes, F.col("tag") == "main").orderBy("start").collect():
        lines.setdefault(r.page_id, []).append(r.line)
    assert lines[1] == lines[2] == lines[3] == ["- top", "  - low", "- next"]
    assert lines[4] == ["  " * k + f"- item {k}" for k in range(300)]


def test_the_later_run_of_a_record_wins(spark, tmp_path):
    """Whatever the names of the part files; records without a time go by their files."""
    ddl = stores.record_ddl(False)
    one = lambda quote: spark.createDataFrame([("Axe",)], "name string").select(
        "name", *[(F.lit(quote) if f.name == "quote" else F.lit(None)).cast(f.dataType).alias(f.name)
                  for f in spark.createDataFrame([], ddl).schema if f.name != "name"])
    for trial in range(3):
        path = f"{tmp_path}/{trial}"
        stores.write_records(one("new"), path, F.timestamp_seconds(F.lit(200)))
        stores.write_records(one("old"), path, F.timestamp_seconds(F.lit(100)))
        assert [r.quote for r in stores.read_records(spark, path).collect()] == ["new"]


def test_an_empty_table_is_read(spark, tmp_path):
    spark.createDataFrame([], "k long").write.parquet(f"{tmp_path}/t")
    assert read_table(spark, f"{tmp_path}/t").count() == 0 == read_table(spark, f"{tmp_path}/t", "k", 7).count()


def test_domain_names(spark):
    got = spark.sql("SELECT explode(array('axe', 'zeus', 'nobody')) AS n").select(in_domain("n").alias("g")).collect()
    assert [r.g for r in got] == ["strength", "intelligence", None]


def test_cards_take_time_in_proportion_to_their_page(spark):
    """Ten times the list items of a tab must not take a hundred times as long."""
    from pageloom.plans.cards import card_props, spellcards

    def seconds(items):
        tab = "".join(f"<li>item {i}</li>" for i in range(items))
        page = ('<div class="spellcard-wrapper" id="A"><div class="spellcard"><div style="border-bottom"><span style="font-weight:bold">A</span></div>'
                '<div class="tabs-dynamic"><ul class="nav-tabs"><li data-count="1">One</li><li data-count="2">Two</li></ul><div class="tabs-content">'
                f'<div class="content1"><ul>{tab}</ul></div><div class="content2">two</div></div></div></div></div>')
        nodes = html_nodes(spark.createDataFrame([(1, page)], "page_id long, html string")).cache()
        nodes.count()
        begin = time.time()
        card = spellcards(nodes).first().card
        assert card.name == "A" and set(card.tabs) == {"One", "Two"} and card.tabs["Two"] == "two"
        assert card_props(nodes).count() == 1
        return time.time() - begin

    seconds(40)
    few, many = seconds(400), seconds(4000)
    assert many < 4 * few + 10
