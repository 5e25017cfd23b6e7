"""Operators against plain models, on the given documents and on messy rows."""

import zlib

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pageloom.llm import ann, classifier, language, mixing, neardup, packing, quality, substrings, suffixes, tokenfiles, tokens
from pageloom.llm.common import Texts, scratch_dir
from pageloom.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import FOLDER


@pytest.fixture(scope="module")
def plain_tokenizer():
    made = Tokenizer.from_file(tokens.default_path())
    made.encode_special_tokens = True
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def unique_ids(rows):
    """Rows as the plain models take them: one a doc_id, null ids apart."""
    out = {}
    for r in rows:
        out.setdefault(r[0], r[1])
    return list(out.items())


def test_pieces_encode_as_the_whole_text(plain_tokenizer):
    rng = np.random.default_rng(3)
    letters = [*"ab Z9 \n\t\r\x0b é×ñß—’'.,!#_-$<|>中文 　\x1f", "'s", "n't", "<|endoftext|>", "  ", "٣", "ª"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(1500)] + ["", None]
    ids, at = tokens.encode(Texts.of(pa.array(texts)), tokens.default_path())
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain_tokenizer(t) for t in texts]


def test_added_tokens_have_their_own_ids(spark):
    """As the tokenizer of the file says, without any setting."""
    made = Tokenizer.from_file(tokens.default_path())
    plain = lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 0]
    rng = np.random.default_rng(5)
    letters = [*"ab 9\n.é<|>中", "'s", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "  "]
    texts = ["one document<|endoftext|>another one", "cut here <|endof", "text|> by a row's end", "", None,
             *("".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(1500))]
    ids, at = tokens.encode(Texts.of(pa.array(texts)), tokens.default_path(), added=True)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(t) for t in texts]
    assert ids[at[0]:at[1]].tolist() == [505, 3188, 50256, 29214, 530, 0]
    rows = list(enumerate(texts[:20]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = scratch_dir(spark, "added")
    tokenfiles.write_token_files(docs, out)
    files = {r.doc_id: r.ids for r in tokenfiles.read_token_files(spark, out).collect()}
    packs = {r.doc_id: r.ids for r in packing.packed(docs).collect()}
    assert files == packs == {i: np.array(plain(t), "<u4").tobytes() for i, t in rows}


def check_packs(rows, texts, plain):
    """Every document whole, sequences gapless and within their length; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    wanted = sorted((i is None, i or 0, crc(plain(t))) for i, t in texts)
    found = []
    for (i, total), own in by_doc.items():
        starts = sorted(own, key=lambda r: r.start)
        copies = sum(r.start == 0 for r in starts)
        assert sum(r.length for r in own) == copies * total
        if copies == 1:
            whole = b"".join(r.ids for r in starts)
            found.append((i is None, i or 0, zlib.crc32(whole)))
    assert set(found) <= set(wanted) and len(by_doc) <= len(wanted)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    used = sum(r.length for r in rows)
    return (len(by_sequence) * packing.LENGTH - used) / max(used, 1)


def test_packing(spark, given, messy, messy_rows, empty, plain_tokenizer):
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    assert check_packs(packing.packed(docs).collect(), given, plain_tokenizer) < 0.05
    got = packing.packed(messy).collect()
    check_packs(got, [r[:2] for r in messy_rows], plain_tokenizer)
    assert sum(r.start == 0 for r in got) == len(messy_rows)
    assert packing.packed(empty).count() == 0


def test_patterns_hold_every_piece():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(n) for k, n in zip(rng.permutation(np.arange(1, 1025))[:400], rng.integers(1, 300, 400))}
    made = packing.patterns(histogram)
    held = {}
    for n, lengths in made:
        assert n > 0 and sum(lengths) <= 1024
        for size in lengths:
            held[size] = held.get(size, 0) + n
    assert held == histogram
    waste = sum(n * (1024 - sum(p)) for n, p in made) / sum(k * n for k, n in histogram.items())
    assert waste < 0.05


def test_substrings(spark, given, messy_rows, empty):
    for rows in (given, unique_ids([r for r in messy_rows if r[0] is not None])):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("x")).repartition(3)
        got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(" ".join(brute.words_of(r.kept)).encode()))
               for r in substrings.without_repeats(docs).collect()}
        assert got == brute.without_repeated_words(rows)
    assert substrings.without_repeats(empty).count() == 0


def test_substrings_keep_white_space_and_columns(spark):
    text = "a b\n c  d " + " ".join(f"w{i}" for i in range(13)) + "\nend"
    docs = spark.createDataFrame([(2, text, "x"), (1, "  " + " ".join(f"w{i}" for i in range(13)), "y")], "doc_id long, text string, rows string")
    got = {r.doc_id: (r.kept, r.rows) for r in substrings.without_repeats(docs, carry=("rows",)).collect()}
    assert got == {2: ("a b\n c  d end", "x"), 1: ("  " + " ".join(f"w{i}" for i in range(13)), "y")}


def test_null_ids_rank_last_and_repeated_ids_do_not_remove(messy, messy_rows):
    got = substrings.without_repeats(messy).collect()
    assert len(got) == len(messy_rows)
    assert max(r.n_removed for r in got if r.doc_id is None) == 400  # its text is document 1's
    assert {r.n_removed for r in suffixes.without_repeated_bytes(messy).where("doc_id = 10").collect()} == {598}


def test_automaton_owners():
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 3, rng.integers(1, 30)).tolist() for _ in range(25)]
    lists += [lists[3][2:9], lists[4] + lists[5]]
    made = substrings.SuffixAutomaton()
    for owner, tokens_ in enumerate(lists):
        made.add(tokens_, owner)
    made.close()
    for probe in lists + [[0, 1, 2, 9, 0, 1, 2, 0]]:
        for size in (2, 5):
            got = made.owners(probe, size)
            for i in range(len(probe)):
                window = probe[i - size + 1:i + 1] if i >= size - 1 else None
                want = next((o for o, t in enumerate(lists) if window and any(t[j:j + size] == window for j in range(len(t)))), substrings.NO_ID)
                assert got[i] == want


def test_suffixes(spark, given, messy_rows, empty):
    for rows in (given, unique_ids([r for r in messy_rows if r[0] is not None])):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rows", F.lit(1)).repartition(3)
        made = suffixes.without_repeated_bytes(docs).collect()
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(r.kept)) for r in made}
        assert got == brute.without_repeated_bytes(rows)
        assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in made)
    assert suffixes.without_repeated_bytes(empty).count() == 0


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(2)
    for trial in range(40):
        data = bytes(rng.integers(97, 98 + trial % 4, 900, dtype=np.uint8))
        data = data[:250] * 4 if trial % 2 else data
        at = np.sort(rng.choice(800, rng.choice([0, 1, 2, 60, 500]), replace=False))
        order, new = suffixes.deep_shallow(data, at, 100)
        found = [data[at[i]:at[i] + 100] for i in order]
        assert found == sorted(found)
        assert new.tolist() == [i == 0 or found[i] != found[i - 1] for i in range(len(found))]


def test_quality_counts(spark, given, messy, messy_rows, empty):
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, FOLDER).collect()}
    for i, t in given:
        w = brute.words_of(t)
        lines = [x for x in t.split("\n") if brute.words_of(x)]
        grams = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        inside = {j + k for j, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 3000 else None
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        if inside is not None:
            assert r.n_repeat_words == len(inside)
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
        assert not (r.base_failed and r.kept)
    rows = quality.quality_verdicts(messy).collect()
    assert len(rows) == len(messy_rows)
    assert all(r.base_failed and not r.kept for r in rows if not r.n_words)
    assert quality.quality_verdicts(empty).count() == 0


def test_quality_verdict_is_the_distance(spark, given):
    """References and distances from plain counts."""
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    from collections import Counter
    words, chars = {}, {}
    of = lambda t: np.array([Counter(quality._CLASS[list(t.encode())].tolist())[k] for k in range(len(quality.CLASSES))], float)
    for r in table:
        words.setdefault(r.lang, Counter()).update(brute.words_of(r.text))
        chars[r.lang] = chars.get(r.lang, 0) + of(r.text)
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    for r in table:
        top = sorted(words[r.lang].items(), key=lambda x: (-x[1], x[0].encode()))[:quality.COMMON]
        known = Counter(brute.words_of(r.text))
        mine = [known[w] for w, _ in top]
        ref = [n for _, n in top]
        js = lambda p, q: float(quality.distance(np.array(p, float), np.array(q, float)))
        js_words = js([*mine, sum(known.values()) - sum(mine)], [*ref, sum(words[r.lang].values()) - sum(ref)])
        js_chars = js(of(r.text), chars[r.lang])
        row = got[r.doc_id]
        assert abs(row.js_words - js_words) < 1e-9 and abs(row.js_chars - js_chars) < 1e-9
        assert row.kept == (not row.base_failed and js_chars <= quality.MOST_CHARS and js_words <= quality.MOST_WORDS)


def test_distance():
    p, q = np.array([[1.0, 1, 0], [0, 0, 0]]), np.array([0.0, 0, 5])
    assert quality.distance(p, q).tolist() == [1, 1]
    assert quality.distance(p[0], p[0]) == 0 and quality.distance(p[1], p[1]) == 0


def sql(name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(table, frame)
    out = con.execute(ORACLE[name])
    return [d[0] for d in out.description], out.fetchall()


def test_mixing_messy(messy, messy_rows, empty):
    frame = pa.table({"doc_id": pa.array([r[0] for r in messy_rows], pa.int64()), "text": pa.array([r[1] for r in messy_rows], pa.string()),
                      "source": pa.array([r[3] for r in messy_rows], pa.string())})
    names, want = sql("op4_source_mixing", documents=frame)
    got = mixing.mixed_copies(messy).withColumn("taken", F.col("size") * F.col("copies")).select(*names).collect()
    order = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert order(got) == order(want)
    carried = mixing.mixed_copies(messy, carry=("text", "hash", "size")).drop("size").columns
    assert carried.count("hash") == 1 and len(carried) == 7
    assert mixing.mixed_copies(empty).count() == 0


def test_classifier(spark, messy, messy_rows, empty):
    rows = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    known = spark.createDataFrame([(1, 1), (2, None), (2, 0), (2, 0), (None, 1), (99, 0), (8, 0), (11, 0), (14, 0)], "doc_id long, quality int")
    got = classifier.quality_scores(messy, known).collect()
    assert len(got) == len(messy_rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in classifier.quality_scores(messy, known.limit(0)).collect()} == {0.5}
    assert classifier.quality_scores(empty, known).count() == 0


def test_isotonic():
    place, rate = classifier.isotonic([0, 1, 2, 3], [0, 3, 1, 4], [4, 4, 4, 4])
    assert place.tolist() == [0, 1.5, 3] and rate.tolist() == [0, 0.5, 1]


def test_token_files(spark, given, messy, messy_rows, empty, plain_tokenizer):
    out = scratch_dir(spark, "files")
    tokenfiles.write_token_files(spark.createDataFrame(given, "doc_id long, text string"), out)
    at = 0
    for r in tokenfiles.read_token_files(spark, out).orderBy("doc_id").collect():
        ids = plain_tokenizer(dict(given)[r.doc_id])
        assert (r.start, r.n_tokens, zlib.crc32(r.ids)) == (at, len(ids), crc(ids))
        at += len(ids)
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    assert dictionary
    one = spark.read.parquet(f"{out}/blocks").first()
    block = tokenfiles.Block(bytes(one["data"]), dictionary)
    assert block.ids(1).tolist() == plain_tokenizer(dict(given)[int(block.keys[1])])
    with pytest.raises(ValueError):
        tokenfiles.Block(bytes(one["data"]), b"another")

    some = [int(block.keys[1]), 7, 10**12, 7]
    assert {r.doc_id: r.ids for r in tokenfiles.read_documents(spark, out, some).collect()} == {
        i: np.array(plain_tokenizer(dict(given)[i]), "<u4").tobytes() for i in some if i in dict(given)}
    assert tokenfiles.read_documents(spark, out, []).count() == 0

    out = scratch_dir(spark, "files")
    tokenfiles.write_token_files(messy, out)
    asked = tokenfiles.read_documents(spark, out, [10, None]).collect()
    assert sorted((r.doc_id or -1, zlib.crc32(r.ids)) for r in asked) == sorted(
        (r[0] or -1, crc(plain_tokenizer(r[1]))) for r in messy_rows if r[0] in (10, None))
    got = tokenfiles.read_token_files(spark, out).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i)) and len(ids) == len(messy_rows)
    assert sorted(zlib.crc32(r.ids) for r in got) == sorted(crc(plain_tokenizer(r[1])) for r in messy_rows)
    out = scratch_dir(spark, "files")
    tokenfiles.write_token_files(empty, out)
    assert tokenfiles.read_token_files(spark, out).count() == 0


def test_scores_of_tiny_and_huge_vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 9))
    size = 10.0 ** rng.choice([-200, -150, 0, 150, 200], (40, 1))
    i, j = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    got = ann._cosine(x * size, x * size, i, j)
    want = (x[i] * x[j]).sum(1) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(x[j], axis=1))
    np.testing.assert_allclose(got, want, atol=1e-14)


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from types import SimpleNamespace

    made = lambda master, base: SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: base), sparkContext=SimpleNamespace(master=master))
    assert scratch_dir(made("yarn", "hdfs://x/shared/"), "a").startswith("hdfs://x/shared/a-")
    assert scratch_dir(made("local[2]", None), "a").startswith("file:///")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch_dir(made(master, None), "a")


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:400] = x[7]  # one vector a tenth of all
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    bad = [(5000, None, "e"), (5050, [0.0] * 24, "e"), (5100, [float("nan")] * 24, "e"), (5150, [1.0, None] + [0.0] * 22, "e"),
           (5200, [1.0], "e"), (None, [1.0] * 24, "e"), (50, x[50].tolist(), "e")]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, list string").repartition(4)
    got = {}
    for r in ann.nearest(docs, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        score = np.round(u @ u[q], 12)
        score[q] = -9
        best = np.lexsort((np.arange(3000), -score))[:5]
        assert [r[0] for r in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[v]) < 1e-9 for _, v, s in got[q])
        hits += len(set(best) & {v for _, v, _ in got[q]})
        if 100 <= q < 400:
            assert [v for _, v, _ in got[q]] == best.tolist()  # ties go to the smaller id
    assert len(got) == 60 and hits / 300 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in ann.nearest(few, 50).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.nearest(few.limit(0), 50).count() == 0
    assert ann.nearest(few.where("vec_id = 0"), 50).count() == 0


def test_nearest_counts_ids_and_not_rows(spark):
    """Ids with up to nine rows, equal ones and others: the best of them is the id's, and k other ids are found."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(300, 12))
    rows = [(i, v + rng.normal(size=12) * 1e-3 * (c % 3 > 0)) for i, v in enumerate(centre) for c in range(9 if i % 10 == 0 else 1 + i % 8)]
    want, ids = {}, np.array([i for i, _ in rows])
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    for q in range(0, 300, 10):
        score = np.full(300, -9.0)
        np.maximum.at(score, ids, (u @ u[ids == q].T).max(1))
        score[q] = -9
        want[q] = np.argsort(-score)[:5].tolist()
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in rows * 2], "vec_id long, embedding array<double>").repartition(3)
    for lists in (1, 4):
        got = {}
        for r in ann.nearest(docs, 10, probed=1.0, lists=lists).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == want
    # A query's own rows fill its nearest list: the search goes on to others.
    own = [(0, [1.0, 0.01 * c]) for c in range(20)] + [(i, [-1.0, 0.1 * i]) for i in range(1, 6)]
    few = ann.nearest(spark.createDataFrame(own, "vec_id long, embedding array<double>"), 50, probed=0.1, lists=2)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2, 3, 4, 5]


def test_near_duplicates(spark, given, messy, messy_rows, empty):
    for rows in (given, unique_ids([r for r in messy_rows if r[0] is not None])):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent=85).collect()}
        assert got == brute.near_components(rows)
    rows = neardup.near_duplicates(messy).collect()
    assert len(rows) == len(messy_rows)
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 3, 4)} == {1}
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """A large group whose members differ around the threshold: neighbours alone do not find all links."""
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(700):
        text = list(base)
        for j in rng.choice(200, 4 if i < 500 else 2, replace=False):
            text[j] = f"{i}-{j}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent=85).collect()}
    assert got == brute.near_components(rows)


def test_language_scores(spark, given, messy, messy_rows, empty):
    want = brute.word_scores(given)
    got = QUERIES["op9_lm_scoring"](spark, FOLDER).collect()
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score < 0
    rows = language.scores(messy).collect()
    assert len(rows) == len(messy_rows) and all(r.n_tokens == 1 for r in rows if r.doc_id in (5, 6, 7))
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert language.scores(empty).count() == 0


def test_mixed_bits_is_a_distribution():
    """Over all next bytes the model's probabilities add up to one."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (sum(language.ROWS), 16))
    table = language.logits(counts)
    paths = np.ascontiguousarray(table[:, language._NODES]).view(np.uint32)[:, :, 0].reshape(-1)
    prefix = b"some text befo"
    data = np.frombuffer(b"".join(prefix + bytes([b]) for b in range(256)), np.uint8)
    at = np.arange(257) * (len(prefix) + 1)
    whole = language.mixed_bits(data, at, paths)
    before = language.mixed_bits(np.frombuffer(prefix, np.uint8), np.array([0, len(prefix)]), paths)[0]
    assert np.exp(before - whole).sum() == pytest.approx(1, abs=1e-4)


def test_components(spark):
    from pageloom.llm.graph import components, merged

    rng = np.random.default_rng(8)
    chain = [(i, i + 1) for i in range(200)]  # a long path
    star = [(300, i) for i in range(301, 900)]  # a node with many links
    loose = [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 400, (250, 2))]
    later = [(150, 320), (1001, 5000), (7000, 7001)]

    def model(links):
        root = {}
        find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    links = chain + star + loose
    rng.shuffle(links)
    frame = lambda rows: spark.createDataFrame([tuple(map(int, r)) for r in rows], "a long, b long").repartition(3)
    got = components(frame(links))
    plain = {a: b for a, b in model(links).items() if any(a in r and r[0] != r[1] for r in links)}
    assert {r.id: r.component for r in got.collect()} == plain
    whole = {r.id: r.component for r in merged(got, frame(later)).collect()}
    assert whole == {a: b for a, b in model(links + later).items() if a in plain or any(a in r for r in later)}
    assert components(frame(links).limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    out = con.execute(ORACLE[name])
    names = [d[0] for d in out.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    order = lambda rows: sorted(tuple(rows_) for rows_ in rows)
    assert order(got.select(*names).collect()) == order(out.fetchall())
