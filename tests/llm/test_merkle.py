"""The Merkle manifest against a plain model."""

import os

import brute
import duckdb
import pytest
from pageloom.llm import merkle
from pageloom.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def proved(docs):
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    cut = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    made = merkle.manifest(docs, tampered={"text": F.when(even, cut).otherwise(F.col("text"))})
    return [(r.doc_id, r.leaf, r.subroot, r.root, brute.sha(bytes(r.proof).hex().encode()), r.folded_root, r.verified) for r in made.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_messy_rows(spark, messy, messy_rows, empty):
    rows = [(r[0], r[3], r[2], None, r[1]) for r in messy_rows]
    assert ordered(proved(messy)) == ordered(brute.merkle(rows))
    assert proved(empty) == []


@pytest.mark.parametrize("size", [1, 3, 28])
def test_sizes(spark, size):
    rows = [(i, "s", None, i, "a\nb") for i in range(size)]
    assert ordered(proved(spark.createDataFrame(rows, COLUMNS))) == ordered(brute.merkle(rows))


def test_hot_group_many_groups_and_odd_names(spark):
    """A third of the rows in one source, the rest in sources of one to three rows, whose names sort bytewise."""
    names = ["é", "Z", "a", "~", "\U0001F600", "", "=", "s1", "s10", "s2"]
    rows = [(i, "hot", "en", 3, f"line {i}\nend") for i in range(700)]
    rows += [(1000 + i, f"{names[i % 10]}{i // 20 or ''}", None, None, f"x\n{i}" if i % 7 else None) for i in range(800)]
    rows += [(3000 + i // 2, None, None, 1, "twice\n") for i in range(40)]
    assert ordered(proved(spark.createDataFrame(rows, COLUMNS).repartition(7))) == ordered(brute.merkle(rows))


def test_only_changed_rows_fail(spark):
    rows = [(i, f"s{i % 3}", "en", 1, f"text {i}") for i in range(300)]
    changed = F.when(F.col("doc_id") == 77, F.lit("other")).otherwise(F.col("text"))
    got = merkle.manifest(spark.createDataFrame(rows, COLUMNS), tampered={"text": changed}).where("NOT verified").collect()
    assert [r.doc_id for r in got] == [77]


def test_settings_stay(spark):
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    proved(spark.createDataFrame([(1, "s", None, 1, "x")], COLUMNS))
    assert spark.conf.get(key) == before


def test_query(spark):
    folder = brute.FOLDER
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(folder, 'documents.parquet')}'")
    want = con.execute(ORACLE["op13_merkle_manifest"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES["op13_merkle_manifest"](spark, folder).select(*names).collect())) == sorted(want.fetchall())
