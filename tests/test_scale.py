"""Plans that must stay lean as tables grow."""

import pytest
from pyspark.sql import functions as F

from pageloom import bindings
from pageloom.operators.text import subtree_text
from pageloom.plans import records
from pageloom.schema import STAT_TYPES


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.range(7).selectExpr(
        "id p_partkey", "'n' || id p_name", "'b' || id p_brand", "if(id = 3, 'PROMO', 'ECONOMY') p_type", "int(id) p_size").write.parquet(f"{folder}/part.parquet")
    return folder


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_box_needs_few_windows_and_says_the_same(spark, parts):
    nodes = bindings.part_nodes(spark, parts, bindings.markup.entity_page())
    whole = records.entity_blocks(nodes)
    for columns, box in ((["attributes", *STAT_TYPES], "stats"), (["summary_info"], "summary")):
        alone = records.entity_blocks(nodes, box=box).select("page_id", *columns)
        assert plan(alone).count("Window [") <= 5
        assert sorted(map(str, alone.collect())) == sorted(map(str, whole.select("page_id", *columns).collect()))
    assert plan(bindings.QUERIES["attributes"](spark, parts)).count("Window [") <= 5


def test_large_pages_that_are_read_twice_are_not_kept_whole(spark, parts):
    for name in ("ability_headings", "abilities", "records_typed", "records_conformed", "zipped_costs"):
        physical = bindings.QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in physical, name


def test_pages_stay_one_row_and_are_not_dealt_again(spark, parts):
    """Nodes of entity pages must not be exchanged: only the source rows, and the names that records are joined to, are."""
    for name in ("stats", "biography_and_blocks", "abilities"):
        executed = bindings.QUERIES[name](spark, parts)._jdf.queryExecution()
        assert executed.optimizedPlan().toString().count("MapInArrow") == 1, name
        assert "Window" not in executed.sparkPlan().toString() and executed.sparkPlan().toString().count("Exchange") <= 2, name
    assert "Filter" not in plan(bindings.QUERIES["attributes"](spark, parts))
    for name in ("ability_headings", "zipped_costs"):
        assert "_page_batches" in plan(bindings.QUERIES[name](spark, parts)), name


def test_rows_behind_a_parse_are_not_sent_to_the_driver(spark, parts):
    """Their size is taken from the small table that the pages come from."""
    for name in ("card_markdown", "zipped_costs", "ability_headings", "records_typed"):
        physical = bindings.QUERIES[name](spark, parts)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in physical and "SortMergeJoin" in physical, name


def test_blocks_of_rows_and_of_pages_are_the_same(spark, parts):
    """Whether nodes are rows or pages, and with a root that is told by a predicate."""
    page = bindings.markup.entity_page()
    rows, pages = bindings.part_nodes(spark, parts, page), bindings.part_pages(spark, parts, page)
    of = lambda nodes, **how: sorted(map(str, records.entity_records(nodes, **how).collect()))
    assert of(pages) == of(rows) == of(pages, root=F.array_contains("classes", "mw-parser-output"))
    other = records.entity_blocks(pages, root=F.col("id") == "f2").collect()
    assert all(r.facets is None and r.summary_info is None for r in other) and len(other) == 7


def test_texts_of_rows_and_of_pages_are_the_same(spark, parts):
    page = bindings.markup.entity_page()
    rows, pages = bindings.part_nodes(spark, parts, page), bindings.part_pages(spark, parts, page)
    texts = {"a": "lines", "b": "spaced", "c": "raw", "d": "tight"}
    got = subtree_text(pages, lambda e: e["tag"].isin("h3", "div", "td"), "parent", **texts).collect()
    want = subtree_text(rows, F.col("tag").isin("h3", "div", "td"), "parent", **texts).collect()
    assert len(got) > 100 and sorted(map(str, got)) == sorted(map(str, want))
