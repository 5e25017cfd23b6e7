"""Sweeps over places, and the plans that take them in place of windows."""

import random

import numpy as np
import pytest

from pageloom import bindings
from pageloom.functions.intervals import Pages
from pageloom.plans import records


def tree(rng, at=0, depth=0):
    """(start, end, depth) of random nested elements."""
    rows, nxt = [], at + 1
    while depth < 6 and rng.random() < 0.6 and nxt < 40:
        below = tree(rng, nxt, depth + 1)
        rows, nxt = rows + below, below[0][1] + 1
    return [(at, nxt - 1, depth), *rows]


def test_sweeps_against_brute_force():
    rng = random.Random(5)
    pages = [tree(rng) for _ in range(60)]
    pages.insert(3, [])
    sizes = np.array([len(p) for p in pages])
    flat = [(k, *row) for k, page in enumerate(pages) for row in page]
    bits = np.array([rng.randrange(8) for _ in flat])
    places = [np.array([row[i] for row in flat]) for i in (1, 2, 3)]
    p = Pages(sizes, *places, bits, ["a", "b", "c"])
    a, b, c = (p[n] for n in "abc")

    def around(i, hits):
        return [j for j in hits if flat[j][0] == flat[i][0] and flat[j][1] <= flat[i][1] <= flat[j][2]]

    rows = range(len(flat))
    all_a = [i for i in rows if a[i]]
    outer = p.outermost(a)
    assert outer.tolist() == [min(around(i, all_a), default=-1) for i in rows]
    inner = [i for i in rows if b[i] and outer[i] >= 0]
    assert p.outermost(b, outer).tolist() == [min(around(i, inner), default=-1) for i in rows]
    lead = {}
    for i in inner:
        lead.setdefault(outer[i], i)
    assert p.first_inside(b, outer).tolist() == [lead[outer[i]] if outer[i] in lead and lead[outer[i]] in around(i, [lead[outer[i]]]) else -1 for i in rows]
    first = {}
    for i in all_a:
        first.setdefault(flat[i][0], i)
    assert p.first_of_page(a).tolist() == [first[flat[i][0]] if flat[i][0] in first and around(i, [first[flat[i][0]]]) else -1 for i in rows]
    assert p.below(outer).tolist() == [outer[i] >= 0 and outer[i] != i for i in rows]
    assert p.direct(outer).tolist() == [outer[i] >= 0 and flat[i][3] == flat[outer[i]][3] + 1 for i in rows]
    behind = lambda i, n: [j for j in all_a if j > i and flat[j][0] == flat[i][0]][n - 1:n]
    for n in (1, 2):
        assert p.nth_next(a, n).tolist() == [(behind(i, n) or [-1])[0] if a[i] else -1 for i in rows]
    assert len(Pages(np.array([0]), *[np.array([], int)] * 4, ["a"]).outermost(np.array([], bool))) == 0


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("parts"))
    spark.range(5).selectExpr(
        "id p_partkey", "'n' || id p_name", "'b' || id p_brand", "if(id = 3, 'PROMO', 'ECONOMY') p_type", "int(id) p_size").write.parquet(f"{folder}/part.parquet")
    return folder


def test_whole_record_blocks_need_few_windows(spark, parts):
    for name in ("biography_and_blocks", "record_errors"):
        plan = bindings.QUERIES[name](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") <= 2, name


def test_text_of_whole_blocks_is_not_read(spark, parts):
    rows = records._block_elements(bindings.part_nodes(spark, parts, bindings.markup.entity_page()), None).where("page_id = 1").collect()
    assert {r.text for r in rows if r.tag == "#document"} == {None}
    assert all(r.text is None for r in rows if r.is_child and r.tag == "div" and not r.classes and not r.is_lore)
    assert [r.text for r in sorted(rows, key=lambda r: r.start) if r.is_child and r.tag == "h2"] == ["Talents", "Bio[edit]", "Innate", "Abilities"]


def test_infoboxes_need_fewer_windows(spark, parts):
    plan = bindings.QUERIES["infobox_rows"](spark, parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 11
