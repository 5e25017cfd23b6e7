"""Words that a hash linear in their bytes cannot tell apart, and hashes made equal on purpose."""

import brute
import numpy as np
import pyarrow as pa
import pytest
from pageloom.llm import common, language, neardup, quality, repeats, substrings, suffixes, tokens
from pageloom.llm.common import Texts
from tokenizers import Tokenizer

#: The Thue-Morse word of 1,024 letters and its complement.
A = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
B = A.translate(str.maketrans("ab", "ba"))
LEAD = "one two three four five six "
TAIL = " seven eight nine ten eleven twelve"
SCHEMA = "doc_id long, text string"


def test_words_differ():
    h = Texts.of(pa.array([A, B, A])).words().hashes()
    assert h[0] != h[1] and h[0] == h[2]


def test_span_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(1, 255, rng.integers(0, 40)).astype(np.uint8)) for _ in range(500)]
    data, start = b"", []
    for w in words * 2:
        start.append(len(data))
        data += w + b"\x00"
    start = np.array(start)
    end = start + np.array([len(w) for w in words * 2])
    h = common.span_hashes(np.frombuffer(data, np.uint8), start, end)
    assert (h[:500] == h[500:]).all() and len(set(h.tolist())) == len(set(words))
    other = rng.integers(0, len(start), len(start))
    same = common.same_spans(np.frombuffer(data, np.uint8), start, end, other)
    assert same.tolist() == [(words * 2)[i] == (words * 2)[j] for i, j in enumerate(other)]


def test_token_ids():
    made = Tokenizer.from_file(tokens.default_path())
    ids, at = tokens.encode(Texts.of(pa.array([A, B])), tokens.default_path(), added=True)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*made.encode(t, add_special_tokens=False).ids, 0] for t in (A, B)]


def test_token_ids_when_all_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(tokens, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["some words here", "other words", "some more", ""]
    made = Tokenizer.from_file(tokens.default_path())
    ids, at = tokens.encode(Texts.of(pa.array(texts)), tokens.default_path(), added=True)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [[*made.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_segments_when_all_hashes_are_equal(monkeypatch):
    monkeypatch.setattr(repeats, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"abcabdabcxyz", np.uint8)
    start, end = np.arange(0, 12, 3), np.arange(3, 13, 3)
    content = repeats.contents(data, start, end, np.zeros(4, np.uint64))
    assert content[0] == content[2] and len(set(content.tolist())) == 3


@pytest.mark.parametrize("middle", [(A, B), (A, A)])
def test_removed_words_and_bytes(spark, middle):
    rows = [(i, LEAD + m + TAIL) for i, m in enumerate(middle)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(" ".join(brute.words_of(r.kept)).encode())) for r in substrings.without_repeats(docs).collect()}
    assert got == brute.without_repeated_words(rows) and got[1][1] == (13 if middle[0] == middle[1] else 0)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffixes.without_repeated_bytes(docs).collect()}
    assert got == brute.without_repeated_bytes(rows)


def test_links(spark):
    rows = [(i, f"{m} x y z {m} p q {m} r") for i, m in enumerate((A, B, A))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85).collect()}
    assert got == brute.near_components(rows) and got[1][1] == 1 and got[2][1] == 0


def test_counts(spark):
    docs = spark.createDataFrame([(0, f"x y {A} x y {B}", "en")], "doc_id long, text string, lang string")
    assert quality.quality_verdicts(docs).first().n_repeat_words == 0
    held = next(i for i in range(50) if brute.word_scores([(i, "")])[i][0])
    taught = next(i for i in range(50) if not brute.word_scores([(i, "")])[i][0])
    rows = [(taught, A), (held, B)]
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in language.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute.word_scores(rows)
    assert {i: g[:4] for i, g in got.items()} == {i: w[:4] for i, w in want.items()} and got[held][2] == 1
    assert all(abs(got[i][4] - want[i][4]) < 1e-9 for i in want)
