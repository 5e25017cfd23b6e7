import itertools
import random

from pyspark.sql import functions as F

from pageloom.functions import text as fx
from pageloom.functions.urls import resolve_url
from pageloom.operators import match, order


def model_merge(rows):
    """Plain model of the continuation rule."""
    out, last = [], None
    for kind, label, value in rows:
        if kind == "section":
            out.append(["section", label, value])
        elif kind == "row" and label:
            out.append(["row", label, value])
            last = label
        elif kind == "row" or last:
            if out and out[-1][0] == "row" and last and out[-1][1] == last:
                out[-1][2] = out[-1][2] + " · " + value if out[-1][2] else value
            else:
                out.append(["row", last or "", value])
    return [tuple(r) for r in out]


def test_continuations_match_a_plain_model(spark):
    rng = random.Random(7)
    groups = {
        g: [(k, {"row": rng.choice(["A", "B", ""]), "section": "— S —", "cont": None}[k], "" if k == "section" else rng.choice(["", "x", "y"]))
            for k in rng.choices(["row", "section", "cont"], k=rng.randint(1, 6))]
        for g in range(400)
    }
    data = [(g, i, *r) for g, rs in groups.items() for i, r in enumerate(rs)]
    df = spark.createDataFrame(data, "page_id int, start int, kind string, label string, value string")
    got = {}
    for r in order.merge_continuations(df, ["page_id"]).orderBy("page_id", "start").collect():
        got.setdefault(r.page_id, []).append((r.kind, r.label, r.value))
    assert {g: model_merge(rs) for g, rs in groups.items() if model_merge(rs)} == got


def test_until_and_take_while_match_a_plain_model(spark):
    rng = random.Random(3)
    groups = {g: [rng.random() < 0.6 for _ in range(rng.randint(1, 6))] for g in range(300)}
    df = spark.createDataFrame([(g, i, ok) for g, rs in groups.items() for i, ok in enumerate(rs)], "page_id int, start int, ok boolean")
    took = order.take_while(df, F.col("ok"), 3, ["page_id"]).groupBy("page_id").count().collect()
    want = {g: len(list(itertools.takewhile(bool, rs[:3]))) for g, rs in groups.items()}
    assert {r.page_id: r["count"] for r in took} == {g: n for g, n in want.items() if n}
    left = order.until(df, ~F.col("ok"), ["page_id"]).groupBy("page_id").count().collect()
    want = {g: len(list(itertools.takewhile(bool, rs))) for g, rs in groups.items()}
    assert {r.page_id: r["count"] for r in left} == {g: n for g, n in want.items() if n}


def test_sections(spark):
    df = spark.createDataFrame(
        [(1, 1, "h", "one a"), (1, 2, "p", ""), (1, 3, "h", "other"), (1, 4, "p", ""), (1, 5, "h", "two"), (1, 6, "p", "")],
        "page_id int, start int, tag string, text string")
    head = F.col("tag") == "h"
    plain = [r.section for r in order.with_section(df, head, F.col("text")).orderBy("start").collect()]
    assert plain == ["one a", "one a", "other", "other", "two", "two"]
    keyed = [r.section for r in order.with_keyed_section(df, head, F.col("text"), ["one", "two"]).orderBy("start").collect()]
    assert keyed == ["one", "one", None, None, "two", "two"]


def test_after_heading_first_and_last(spark):
    df = spark.createDataFrame([(1, i, i, t) for i, t in enumerate("HabHcd")], "page_id int, start int, end int, text string")
    get = lambda k, keep: [r.next.text if r.next else None for r in order.after_heading(
        df, F.col("text") == "H", k, keep, fields=("text",)).orderBy("start").collect()]
    assert get(1, None) == ["a", "c"] and get(1, "last") == ["c"] and get(2, "first") == ["b"] and get(3, "last") == [None]


def test_pairing_order(spark):
    # Cards with the intervals of their parents and grandparents; starts of blocks.
    card = lambda page, parent=(5, 50), grand=(0, 90): (page, 10, 20, parent, grand)
    cards = spark.createDataFrame(
        [card(1), card(2), card(3), card(4), card(5), card(6, None, None), card(7, (5, 50), None)],
        "page_id int, start int, end int, parent struct<start:int,end:int>, grand struct<start:int,end:int>")
    blocks = spark.createDataFrame(
        [(1, 12), (1, 30), (2, 30), (2, 60), (3, 60), (4, 7), (5, 95), (6, 3), (6, 70), (7, 70)], "page_id int, start int")
    got = {r.page_id: r.tab.start if r.tab else None for r in order.pair_next(cards, blocks).collect()}
    assert got == {1: 12, 2: 30, 3: 60, 4: 7, 5: None, 6: 70, 7: 70}


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string")
    pick = lambda f: {r.k: r.v for r in f(df, ["k"], "n").collect()}
    assert pick(match.first_per) == {"a": "x", "b": "z"} and pick(match.last_per) == {"a": "y", "b": "z"}
    maps = df.groupBy().agg(match.last_map(F.col("k"), F.col("v"), "n").alias("m")).first().m
    assert maps == {"a": "y", "b": "z"}


def test_zip_is_cut_to_the_shorter_list(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "page_id int, start int, x string")
    b = spark.createDataFrame([(1, 9, "p"), (1, 10, "q")], "page_id int, start int, y string")
    assert sorted((r.x, r.y) for r in match.zip_rows(a, b, ["page_id"]).collect()) == [("a", "p"), ("b", "q")]


def test_strings(spark):
    row = lambda *cols: spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(cols)]).first()
    codes = [fx.strip_sort_code(F.lit(t)) for t in ("a1 foo", "b7", "a12x", "a1x", "z3/4")]
    assert list(row(*codes)) == ["foo", "", "2x", "a1x", "/4"]
    assert list(row(fx.strip(F.lit(" \t x  ")), fx.collapse(F.lit(" a \n b ")))) == ["x", "a b"]
    names = ["Axe", "Keeper of the Light", "Anti-Mage", "Nature's Prophet", "Nobody"]
    exact = list(row(*[match.in_domain(fx.slug(F.lit(n))) for n in names]))
    loose = list(row(*[match.in_domain(fx.slug(F.lit(n), loose=True)) for n in names]))
    assert exact == ["strength", "intelligence", None, None, None]
    assert loose == ["strength", "intelligence", "agility", "universal", None]
    before, behind = fx.around(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("b"))
    none, all_of = fx.around(F.array(F.lit("a")), F.lit("z"))
    assert list(row(before, behind, none, all_of)) == [["a"], ["c"], ["a"], []]
    assert list(row(fx.after_label(F.lit("A.b : c"), F.lit("A.b")), fx.after_label(F.lit("Axb: c"), F.lit("A.b")))) == ["c", "Axb: c"]


def test_urls_match_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://e.org/wiki/", "https://e.org/wiki", "http://h.org/a/b/c?x=1#f", "http://h.org"]
    refs = ["Axe", "/wiki/Axe", "//o.org/p", "?q=1", "#s", "", "../up", "./a/../b", "https://z.org/", "a//b", "/x/./y/", "c?d=../e"]
    df = spark.createDataFrame([(b, r, urljoin(b, r)) for b in bases for r in refs], "base string, ref string, want string")
    bad = df.withColumn("got", resolve_url("base", "ref")).where("got <> want").collect()
    assert not bad
