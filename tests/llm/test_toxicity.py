"""The toxicity machine against plain models, held-out labels and written-apart insults."""

import itertools
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pageloom.llm import toxicity as tox
from pageloom.llm.common import Texts
from pageloom.llm.queries import QUERIES
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def symbol(byte):
    c = chr(byte)
    if c.lower() in LETTERS and byte < 128:
        return LETTERS.index(c.lower())
    return 26 if c in " \t\n\v\f\r" else 27 if c.isdigit() and byte < 128 else 30 if 0x80 <= byte < 0xC0 else 29 if byte >= 0xC0 else 28


def subsequences(line, begin):
    """{subsequence: weight} of all that begin in a window, in plain loops."""
    out = {}
    for i in range(begin, min(begin + tox.WINDOW, len(line))):
        for rest in itertools.combinations(range(i + 1, min(i + tox.SPAN, len(line))), tox.ORDER - 1):
            key = tuple(line[k] for k in (i, *rest))
            out[key] = out.get(key, 0) + tox.DECAY ** (rest[-1] - i + 1 - tox.ORDER)
    return out


def texts_of(rng, n):
    return ["".join(rng.choices("ab c.é1D\n", k=rng.randint(0, 40))) for _ in range(n)] + ["", None]


def test_kernels_match_a_plain_model():
    rng = random.Random(1)
    texts = texts_of(rng, 30)
    line, at = tox.symbols(Texts.of(pa.array(texts)))
    places = np.array([a + rng.randrange(max(1, z - a - tox.WINDOW)) for a, z in zip(at, at[1:])])
    windows = tox.cut(line, places)
    plain = [[symbol(b) for b in (t or "").encode()] for t in texts]
    bags = [subsequences(p, int(w - a)) for p, w, a in zip(plain, places, at)]
    want = [[sum(v * y.get(k, 0) for k, v in x.items()) for y in bags] for x in bags]
    np.testing.assert_allclose(tox.Landmarks(windows).kernels(windows), want, rtol=1e-4, atol=1e-4)


def test_sums_over_windows_match_a_plain_model():
    """The collapsed table gives every window the sum of weights times kernels, and a row's margin is its worst window's."""
    rng = random.Random(2)
    texts = texts_of(rng, 25)
    marks = tox.Landmarks(tox.cut(*[(x[0], x[1][:-1][:6]) for x in [tox.symbols(Texts.of(pa.array(texts)))]][0]))
    beta = np.random.default_rng(3).normal(size=6)
    table = marks.spread(beta)
    line, at = tox.symbols(Texts.of(pa.array(texts)))
    sums = tox.window_sums(tox.sums_by_place(line, table))
    for i, t in enumerate(texts):
        n = len((t or "").encode())
        own = [float(marks.kernels(tox.cut(line, np.array([at[i] + k])))[0] @ beta) for k in range(n)]
        np.testing.assert_allclose(sums[at[i]:at[i] + n], own, rtol=1e-3, atol=1e-3)
        assert abs(tox.largest(sums, at)[i] - max(own, default=0)) < 1e-3


def test_letters_set_apart_are_put_together():
    texts = ["an i d i o t here", "i.d.i.o.t", "a b and cd", "", None, "plain", "x y z"]
    line, at, rows = tox.condensed(*tox.symbols(Texts.of(pa.array(texts))))
    seen = ["".join((LETTERS + " 0._~")[c] for c in line[a:z] if c != 31) for a, z in zip(at, at[1:])]
    assert dict(zip(rows.tolist(), seen)) == {0: "an idiot here", 1: "idiot", 6: "xyz"}


def test_rates_rise():
    place, rate = tox.levels([(1, 0, 5), (3, 2, 4), (4, 1, 4), (10, 9, 9)])
    assert place == sorted(place) and rate == sorted(rate) and rate[0] == 0 and rate[-1] == 1
    assert tox.levels([]) == ([], [])


def invented(n, seed):
    """(doc_id, text, toxic): syllables, in every fifth text an insult; ids of one fold hold it out."""
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 2)):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "moron", "clown", "pathetic"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    """Scores of invented texts and of further ones that no label names."""
    rows, rng = invented(1500, 8), random.Random(1)
    clean = [t for i, t, y in rows if not y][:240]
    more, base = [], 100_000
    for k, t in enumerate(clean):
        w = rng.choice(["stupid", "moron", "clown", "pathetic"])
        m = rng.randrange(1, len(w))
        form = {0: "", 1: w, 2: w[:m] + rng.choice("*-.x") + w[m:], 3: w[:m] + w[m - 1:], 4: " ".join(w), 5: ".".join(w.upper())}[k % 6]
        at = t.find(" ") + 1
        more.append((base + k, f"{t[:at]}{form} {t[at:]}"))
    docs = spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string").withColumn("y", F.lit("clash")).repartition(4)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in tox.toxicity_scores(docs, labels).collect()}
    return rows, more, got


def test_held_out_labels(scored):
    rows, _, got = scored
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    held = [(y, got[i].score >= 0.7) for i, _, y in rows if got[i].held_out]
    assert len(held) > 400 and sum(y == p for y, p in held) / len(held) > 0.985
    assert all(0 <= r.score <= 1 for r in got.values())


def test_insults_with_gaps_and_strange_letters(scored):
    _, more, got = scored
    share = lambda k: np.mean([got[i].score >= 0.7 for n, (i, _) in enumerate(more) if n % 6 == k])
    assert share(0) <= 0.03 and share(1) > 0.95 and share(2) > 0.6 and share(3) > 0.85 and share(4) > 0.85 and share(5) > 0.85


def test_messy_rows_and_labels(spark, messy, messy_rows, empty):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 0, "b"), (5, None, None), (None, 0, None), (99, 1, None), (15, 0, ""), (16, 1, "")],
                                   "doc_id long, toxic int, text string")
    got = tox.toxicity_scores(messy, labels).collect()
    assert len(got) == len(messy_rows) and all(0 <= r.score <= 1 for r in got)
    assert tox.toxicity_scores(empty, labels).count() == 0
    none = tox.toxicity_scores(messy, labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(messy_rows)
    assert {r.score for r in tox.toxicity_scores(messy, labels.where("toxic = 0")).collect()} <= {0.0, 0.5}


def test_query(spark):
    got = QUERIES["op12_toxicity"](spark, brute.FOLDER)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == 200 and all(r.predicted == (r.score >= 0.7) for r in rows)
