"""Quality rules: how far a document's characters and common words diverge from its language."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import Texts, mixed, per_batch, stored, sum_rows

SYMBOLS = b"#*$%&|<>"
#: Character classes by byte; bytes of code points above 127 count once, at the first byte.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "symbol", "other", "wide")
#: Documents with fewer words than this are not judged by the divergence.
LEAST_WORDS = 50
#: Common words of each language.
COMMON = 40
#: Largest Jensen-Shannon distances (base 2, so 0 to 1) of a kept document.
MOST_CHARS, MOST_WORDS = 0.30, 0.43


def _classes() -> np.ndarray:
    c = np.full(256, CLASSES.index("other"), np.uint8)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], c[0x0A] = 3, 4
    c[list(b".,;:!?'\"()-")] = CLASSES.index("stop")
    c[list(SYMBOLS)] = CLASSES.index("symbol")
    c[0x80:0xC0] = len(CLASSES)  # continuation bytes: no character begins here
    c[0xC0:] = CLASSES.index("wide")
    return c


_CLASS = _classes()
_LINE_END = 0x0A


def class_counts(texts: Texts) -> np.ndarray:
    """Characters by row and class."""
    rows = np.repeat(np.arange(len(texts), dtype=np.int64) * (len(CLASSES) + 1), np.diff(texts.at))
    rows += _CLASS[texts.data]
    return np.bincount(rows, minlength=len(texts) * (len(CLASSES) + 1)).reshape(len(texts), -1)[:, :len(CLASSES)]


def repeated_lines(texts: Texts) -> np.ndarray:
    """By row, the lines with a word that equal an earlier line of the row."""
    out = np.zeros(len(texts), np.int64)
    breaks = sum_rows((texts.data == _LINE_END).astype(np.int64), texts.at)
    for i in np.flatnonzero(breaks):
        lines = [x for x in texts.row(i).split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out[i] = len(lines) - len(set(lines))
    return out


def repeated_words(words, hashes: np.ndarray) -> np.ndarray:
    """By row, the words inside 3-word windows that the row holds twice or more."""
    rows = words.rows()
    at, grams = words.windows(3, hashes)
    own = mixed(grams + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(hashes), bool)
    for k in range(3):
        inside[at[twice] + k] = True
    return sum_rows(inside.astype(np.int64), words.first)


def base_counts(texts: Texts, classes: np.ndarray, words, hashes: np.ndarray) -> dict:
    """The counts that the fixed rules use, by row."""
    space = CLASSES.index("space"), CLASSES.index("line")
    return {
        "n_words": words.counts,
        "word_chars": classes.sum(1) - classes[:, space].sum(1),
        "n_symbols": classes[:, CLASSES.index("symbol")],
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_words(words, hashes),
    }


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON) -> DataFrame:
    """Histograms of each language: ``(lang, chars, words, size)``, one row a language.

    ``chars`` counts the character classes, ``words`` the ``common`` commonest words, ``size`` all words.

    Counted over all documents: summed in each batch of texts, then by shuffle.
    Ties between words go to the smaller word.  A null language is a language of its own.
    """
    def count(batch):
        texts = Texts.of(batch.column("text"))
        out = {"lang": [], "word": [], "class": [], "n": []}
        langs, codes = _codes(batch.column("lang"))
        classes = class_counts(texts)
        words = texts.words()
        hashes = words.hashes()
        of = np.repeat(codes, words.counts)
        for k, name in enumerate(langs):
            for c, n in enumerate(classes[codes == k].sum(0).tolist()):
                out["lang"].append(name), out["word"].append(None), out["class"].append(c), out["n"].append(n)
            mine = np.flatnonzero(of == k)
            _, first, n = np.unique(hashes[mine], return_index=True, return_counts=True)
            data = texts.data.tobytes()
            for i, m in zip(mine[first].tolist(), n.tolist()):
                out["word"].append(data[words.start[i]:words.end[i]])
                out["n"].append(m)
            out["lang"] += [name] * len(n)
            out["class"] += [-1] * len(n)
        return {"lang": pa.array(out["lang"], pa.string()), "word": pa.array(out["word"], pa.binary()),
                "class": pa.array(out["class"], pa.int32()), "n": pa.array(out["n"], pa.int64())}

    counts = stored(
        per_batch(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), count, "lang string, word binary, class int, n long")
        .groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "language-counts")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = (
        counts.where("class < 0").withColumn("rank", rank).where(F.col("rank") <= common)
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("words"))
    )
    chars = counts.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.when(F.col("class") >= 0, F.struct("class", "n")))).alias("chars"),
        F.sum(F.when(F.col("class") < 0, F.col("n"))).alias("size"))
    return chars.join(top.withColumnRenamed("lang", "t"), F.col("lang").eqNullSafe(F.col("t")), "left").drop("t")


def _codes(column: pa.Array) -> tuple[list, np.ndarray]:
    coded = pc.dictionary_encode(column, null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms along the last axis; 1 to an empty one, 0 between two empty ones."""
    a, b = p.sum(-1, keepdims=True), q.sum(-1, keepdims=True)
    p, q = p / np.maximum(a, 1e-300), q / np.maximum(b, 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(-1)
        out = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where((a[..., 0] > 0) & (b[..., 0] > 0), out, ((a[..., 0] > 0) != (b[..., 0] > 0)) * 1.0)


def quality_verdicts(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", common: int = COMMON,
                     least_words: int = LEAST_WORDS, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS,
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """The rules' counts and verdict of each document.

    Returns the id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``,
    the distances ``js_chars`` and ``js_words`` to the references of the document's
    language, ``base_failed`` (fewer than 50 words, or more than half of the words
    in repeated 3-word windows) and ``kept``.  A document is kept when it has not
    failed and either has fewer than ``least_words`` words or stays within both
    distances.  Words compare with the histogram of the language's common words and
    all others.  References cover all documents and have a bounded size: classes and ``common`` words for
    each language.  Null or empty texts have counts 0 and fail; a null language is a
    language of its own; rows are judged one by one, so repeated rows agree.
    Columns named in ``carry`` come along; others are ignored.
    """
    refs = {}
    for r in language_references(docs, text, lang, common).collect():
        known = [x["n"] for x in r["words"] or ()]
        chars = np.zeros(len(CLASSES))
        for x in r["chars"]:
            chars[x["class"]] = x["n"]
        names = word_hashes([bytes(x["word"]) for x in r["words"] or ()])
        refs[r["lang"]] = (chars, names, np.array([*known, (r["size"] or 0) - sum(known)], float))

    def judge(batch):
        texts = Texts.of(batch.column("text"))
        classes, words = class_counts(texts), texts.words()
        hashes = words.hashes()
        out = base_counts(texts, classes, words, hashes)
        n = out["n_words"]
        langs, codes = _codes(batch.column("lang"))
        js_chars, js_words = np.zeros(len(texts)), np.zeros(len(texts))
        rows = words.rows()
        for k, name in enumerate(langs):
            chars, names, known = refs[name]
            mine = np.flatnonzero(codes == k)
            js_chars[mine] = distance(classes[mine].astype(float), chars)
            place = np.full(len(texts), -1, np.int64)
            place[mine] = np.arange(len(mine))
            own = place[rows] >= 0
            order = np.argsort(names)
            slot = np.searchsorted(names, hashes[own], sorter=order)
            slot = order[np.minimum(slot, max(len(names) - 1, 0))] if len(names) else slot
            slot = np.where(names[slot] == hashes[own], slot, len(names)) if len(names) else slot
            counts = np.bincount(place[rows[own]] * len(known) + slot, minlength=len(mine) * len(known))
            js_words[mine] = distance(counts.reshape(len(mine), len(known)).astype(float), known)
        failed = (n < 50) | (100 * out["n_repeat_words"] > 50 * n)
        kept = ~failed & ((n < least_words) | ((js_chars <= most_chars) & (js_words <= most_words)))
        return out | {"js_chars": js_chars, "js_words": js_words, "base_failed": failed, "kept": kept} | {
            c: batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("text", "lang") or c in carry}

    taken = [F.col(c) for c in carry if c not in (text, lang, id)]
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(id).alias("doc_id"), *taken)
    kinds = dict(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), *taken).dtypes)
    back = ["doc_id", *(c for c in carry if c != id)]
    return per_batch(rows, judge, ", ".join(f"{c} {kinds[c]}" for c in back) + f", {COUNTS}").withColumnRenamed("doc_id", id)


COUNTS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "js_chars double, js_words double, base_failed boolean, kept boolean")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return Texts.of(pa.array(words, pa.binary())).words().hashes()
