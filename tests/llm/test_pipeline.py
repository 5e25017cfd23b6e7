"""Each stage of the pipeline against plain models of its own input, and all of it over messy and empty tables."""

from collections import Counter

import brute
import corpus_pipeline as pipeline
import pyarrow as pa
import pytest
from brute import FOLDER
from pageloom.llm.common import stored
from test_operators import check_packs, plain_tokenizer, sql  # noqa: F401

NAMES = [name for name, _ in pipeline.STAGES]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        given, docs = docs, stored(stage(spark, docs, FOLDER), "step")
        out[name] = (given.collect(), docs.collect(), docs.columns)
    return out


def test_shape(steps):
    assert NAMES == ["quality rules", "near dedup", "substring dedup", "source mixing", "packing"]
    assert all(sorted(steps[n][2]) == sorted(pipeline.COLUMNS) for n in NAMES[:-1])


def test_quality(spark, steps):
    from pageloom.llm.quality import quality_verdicts

    given, got, _ = steps["quality rules"]
    kept = {r.doc_id for r in quality_verdicts(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("kept").collect()}
    assert sorted(got) == sorted(r for r in given if r.doc_id in kept) and 0 < len(got) < len(given)


def test_near_dedup(steps):
    given, got, _ = steps["near dedup"]
    model = brute.near_components([(r.doc_id, r.text) for r in given], percent=80)
    assert sorted(got) == sorted(r for r in given if model[r.doc_id][1] == r.doc_id) and len(got) < len(given)


def test_substring_dedup(steps):
    given, got, _ = steps["substring dedup"]
    model = brute.without_repeated_words([(r.doc_id, r.text) for r in given])
    found = {r.doc_id: brute.sha(" ".join(brute.words_of(r.text)).encode()) for r in got}
    assert found == {i: m[2] for i, m in model.items() if m[1] < m[0] or not m[0]}
    before = {r.doc_id: r for r in given}
    for r in got:
        assert (r.lang, r.source, r.n_chars) == (before[r.doc_id].lang, before[r.doc_id].source, len(r.text))
        assert r.text == before[r.doc_id].text or model[r.doc_id][1]


def test_source_mixing(steps):
    given, got, _ = steps["source mixing"]
    table = pa.table({c: pa.array([r[c] for r in given]) for c in ("doc_id", "text", "source")})
    names, rows = sql("op4_source_mixing", documents=table)
    copies = {r[names.index("doc_id")]: r[names.index("taken")] // max(r[names.index("size")], 1) for r in rows}
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    assert set(got) <= set(given)


def test_packing(steps, plain_tokenizer):  # noqa: F811
    given, got, _ = steps["packing"]
    check_packs(got, [(r.doc_id, r.text) for r in given], plain_tokenizer)
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(r.doc_id for r in given)


@pytest.mark.parametrize("stage", NAMES)
def test_messy_and_empty(spark, messy, empty, stage):
    run = dict(pipeline.STAGES)[stage]
    assert run(spark, empty, FOLDER).count() == 0
    rows = run(spark, messy, FOLDER).collect()
    ids = [r.doc_id for r in rows]
    if stage == "near dedup":
        assert ids.count(10) == 1 and ids.count(None) == 2 and not {2, 3, 4} & set(ids) and 1 in ids
    if stage == "substring dedup":
        assert {5, 6, 7, 8} <= set(ids) and 2 not in ids
    assert stage in ("packing", "source mixing") or all(len(r) == len(pipeline.COLUMNS) for r in rows)


def test_run(spark):
    got = pipeline.run(spark, FOLDER)
    assert got.count() > 0 and {"sequence_id", "offset", "ids"} <= set(got.columns)
