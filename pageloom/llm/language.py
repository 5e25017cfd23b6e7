"""Language-model scores: online logistic mixing of hashed-context bit predictors, and a word-count base.

A byte is two half-bytes of four binary decisions each.  Each predictor hashes a context (the last two bytes, the last
four, the word so far; for the second half with the first) to a row of bit predictions learned from all training documents.
For each document, weights start alike and are refined as its bytes go by: the predictions, in the
logistic domain, are added by a set of weights that the bit's position and
the place in the word select, and each block's errors correct the weights used for the next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import _BYTE, _SPACE, Texts, buckets, crc, crc_mod, powers, stored
from pageloom.llm.repeats import bucket_of, chunk_rows, chunk_table, pack, unpack

CHUNK_MB = 4
#: Rows of the predictors' tables: last two bytes, last four bytes, word so far.
ROWS = (1 << 16, 1 << 18, 1 << 19)
#: Parts in which counts meet.
RANGES = 56
#: Steps of a stored logit in a unit, and what is added to counts.
SCALE, ADDED = 12.0, 0.1
#: Bytes between corrections of the weights, first weights, and how fast they move.
BLOCK, FIRST, RATE = 256, (0.25, 0.45, 0.55), 0.0015
#: Stands for the end of a text among word hashes.
END_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)
_STARTS = np.append(0, np.cumsum(ROWS)) * 16
_SHIFT = tuple(np.uint64(64 - r.bit_length() + 1) for r in ROWS)
_NODES = np.array([[1] + [(1 << k) | (v >> (4 - k)) for k in range(1, 4)] for v in range(16)])
_BITS = np.array([[(v >> (7 - k)) & 1 for k in range(8)] for v in range(256)], np.float32)
_models: dict[int, tuple] = {}


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(places of both half-bytes in the tables by predictor, whether a word has begun) for every byte of rows that begin at ``at``."""
    n = len(data)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    value = _BYTE[data]
    old = lambda k: np.concatenate([np.zeros(min(k, n), np.uint64), value[:n - k]]) * (place >= k)
    two = old(1) + old(2) * np.uint64(0x9E3779B97F4A7C15)
    four = two + old(3) * np.uint64(0xC2B2AE3D27D4EB4F) + old(4) * np.uint64(0x165667B19E3779F9)
    # The word so far: a running hash since the last white space or the row's begin.
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * up[:n], out=total[1:])
    begin = np.zeros(n, np.int64)
    begin[at[:-1][np.diff(at) > 0]] = at[:-1][np.diff(at) > 0]
    after = np.flatnonzero(_SPACE[data[:-1]]) + 1 if n else begin
    begin[after] = after
    begin = np.maximum.accumulate(begin)
    word = (total[:-1] - total[begin]) * down[begin]
    inside = begin < np.arange(n)
    found = []
    high, low = (data >> 4).astype(np.uint64), (data & 15).astype(np.int64)
    for h, shift, first in zip((two, four, word), _SHIFT, _STARTS):
        row = lambda x: (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int64) * 16 + first
        found.append((row(h) + high.astype(np.int64), row(h + (high + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) + low))
    return found, inside


def with_ends(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes with a zero byte after each, and where rows begin."""
    at = texts.at + np.arange(len(texts.at))
    out = np.zeros(at[-1], np.uint8)
    inside = np.ones(len(out), bool)
    inside[at[1:] - 1] = False
    out[inside] = texts.data
    return out, at


def part_of(texts: Texts, rows: np.ndarray) -> Texts:
    """Some rows, in their order."""
    size = np.diff(texts.at)[rows]
    at = np.append(0, np.cumsum(size))
    pick = np.repeat(texts.at[rows] - at[:-1], size) + np.arange(at[-1])
    return Texts(texts.data[pick], at)


def pieces_of(texts: Texts, size: int = 1 << 20):
    """Row numbers in groups of about ``size`` bytes."""
    group = texts.at[1:] // size
    return np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1) if len(texts) else []


def logits(counts: np.ndarray) -> np.ndarray:
    """Stored logits of the decision tree from counts of half-bytes, a row a context."""
    out = np.zeros(counts.shape, np.int8)
    level, width = counts.astype(np.float64), counts.shape[1] // 2
    while width:
        left, right = level[:, ::2], level[:, 1::2]
        out[:, width:2 * width] = np.clip(np.rint(SCALE * np.log((right + ADDED) / (left + ADDED))), -127, 127)
        level, width = left + right, width // 2
    return out


def model(data: bytes) -> np.ndarray:
    """For each context and half-byte, the four stored logits along its path, as one 32-bit value."""
    key = crc(data)
    if key not in _models:
        _models.clear()
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int8).reshape(-1, 16)
        paths = np.empty((len(table), 16), np.uint32)
        for a in range(0, len(table), 1 << 14):
            paths[a:a + (1 << 14)] = np.ascontiguousarray(table[a:a + (1 << 14)][:, _NODES]).view(np.uint32)[:, :, 0]
        _models[key] = paths.reshape(-1)
    return _models[key]


def mixed_bits(data: np.ndarray, at: np.ndarray, paths: np.ndarray, block: int = BLOCK, first=FIRST, rate: float = RATE) -> np.ndarray:
    """Nats that each row costs; all rows go on block by block together, the longest first."""
    found, inside = contexts(data, at)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    cost = np.zeros(len(size))
    # By row, predictor, gate (word begun or not) and bit.
    weights = np.repeat(np.repeat(np.array(first, np.float32)[None, :, None, None], 2, 2), 8, 3).repeat(len(size), 0)
    for begin in range(0, int(size.max(initial=0)), block):
        live = order[:np.searchsorted(-size[order], -begin)]
        spot = at[live][:, None] + begin + np.arange(min(block, size[live[0]] - begin))
        real = spot < at[live + 1][:, None]
        spot = np.minimum(spot, len(data) - 1)
        gate = inside[spot]
        w = weights[live]
        x = np.zeros((*spot.shape, 8), np.float32)
        seen = []
        for i, halves in enumerate(found):
            s = np.stack([paths[place[spot]] for place in halves], -1).view(np.int8).astype(np.float32)
            s *= np.float32(1 / SCALE)
            seen.append(s)
            x += np.where(gate[:, :, None], w[:, i, 1, None], w[:, i, 0, None]) * s
        bit = _BITS[data[spot]]
        # Cost of a bit at logit x: log(1 + exp(-x)) for a one, of x for a zero.
        np.clip(x, -16, 16, out=x)
        e = np.exp(x)
        grown = 1 + e
        cost[live] += ((np.log(grown) - bit * x) * real[:, :, None]).sum((1, 2), dtype=np.float64)
        error = (bit - e / grown) * real[:, :, None]
        error_in = error * gate[:, :, None]
        for i, s in enumerate(seen):
            all_ = np.einsum("abk,abk->ak", error, s)
            in_ = np.einsum("abk,abk->ak", error_in, s)
            w[:, i, 1] += np.float32(rate) * in_
            w[:, i, 0] += np.float32(rate) * (all_ - in_)
        weights[live] = w
    return cost


def scores(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """Base and mixing scores of each text, as log10 probabilities.

    Returns the id, ``held_out`` (crc32 of the id is ``held_out`` modulo ``folds``; such rows
    teach nothing), ``n_tokens`` (words in lower case and one end), ``n_known`` (of them met in training),
    ``train_tokens``, ``base_score`` (smoothed word frequencies), ``score`` (the mixing model's, over the bytes in lower
    case and an end byte) and ``bits_per_byte``.  Counts come from all training rows: words are counted by 64-bit
    hashes in the buckets that hold them and each chunk of texts gets back the
    counts of its own words, so no vocabulary is gathered anywhere; predictor tables are summed by ranges and have a
    fixed size.  A null or empty text is its end alone, a null id's crc is
    that of the empty text, repeated rows count each, and without training rows every token is unknown.
    Extra columns are ignored.
    """
    n = buckets(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), (crc_mod(id, folds) == held_out).alias("held_out"))
    chunks = chunk_rows(rows, CHUNK_MB)

    def tokens(table):
        texts = Texts.of(table.column("text")).lower()
        words = texts.words()
        held = table.column("held_out").to_numpy()
        h = np.append(words.hashes(), np.full(len(texts), END_WORD))
        row = np.append(words.rows(), np.arange(len(texts)))
        every, inverse = np.unique(h, return_inverse=True)
        return texts, held, row, every, inverse, np.searchsorted(bucket_of(every, n), np.arange(n + 1))

    def count(batches):
        sums = np.zeros(_STARTS[-1], np.uint32)
        for batch in batches:
            for chunk, packed_rows in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                texts, held, row, every, inverse, cuts = tokens(chunk_table(packed_rows.as_py()))
                times = np.bincount(inverse[~held[row]], minlength=len(every))
                for b in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[b], cuts[b + 1])
                    yield line(0, b, chunk, pack(every[s], times[s].astype(np.uint32)))
                taught = part_of(texts, np.flatnonzero(~held))
                for group in pieces_of(taught):
                    for halves in contexts(*with_ends(part_of(taught, group)))[0]:
                        for place in halves:
                            np.add.at(sums, place, np.uint32(1))
        edges = np.linspace(0, sum(ROWS), RANGES + 1).astype(np.int64) * 16
        for r, (a, b) in enumerate(zip(edges, edges[1:])):
            used = np.flatnonzero(sums[a:b])
            if len(used):
                yield line(1, r, -1, pack(np.diff(used, prepend=0).astype(np.uint32), sums[a:b][used], b - a))

    def line(kind, bucket, chunk, data):
        return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                                           "chunk": pa.array([chunk], pa.int64()), "data": pa.array([data], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(x.as_py()) for x in table.column("data")]
        every, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(every)).astype(np.int64)
        own = total[inverse]
        cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
        sums = pa.array([int(total.sum())] + [0] * (len(parts) - 1), pa.int64()), pa.array([int((total > 0).sum())] + [0] * (len(parts) - 1), pa.int64())
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": sums[0], "v": sums[1],
                         "data": pa.array([pack(own[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("data"):
            gaps, times, size = unpack(x.as_py())
            total = np.zeros(size, np.int64) if total is None else total
            total[np.cumsum(gaps, dtype=np.int64)] += times
        return pa.table({"bucket": table.column("bucket")[:1], "data": pa.array([logits(total.reshape(-1, 16)).tobytes()], pa.binary())})

    parts = stored(chunks.mapInArrow(count, "kind int, bucket int, chunk long, data binary"), "counts")
    answers = stored(parts.where("kind = 0").groupBy("bucket").applyInArrow(meet, "chunk long, bucket int, n long, v long, data binary"), "words")
    whole = answers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    edges = np.linspace(0, sum(ROWS), RANGES + 1).astype(np.int64)
    # The tables' size is fixed by ROWS, whatever the corpus.
    table = np.zeros((sum(ROWS), 16), np.int8)
    for r in parts.where("kind = 1").groupBy("bucket").applyInArrow(add, "bucket int, data binary").collect():
        table[edges[r["bucket"]]:edges[r["bucket"] + 1]] = np.frombuffer(r["data"], np.int8).reshape(-1, 16)
    data = zstandard.ZstdCompressor(3).compress(table.tobytes())
    norm = np.log10(whole["n"] + 0.5 * (whole["v"] + 1))
    train_tokens = whole["n"]

    def score(batches):
        paths = model(data)
        for batch in batches:
            for packed_rows, back in zip(batch.column("rows"), batch.column("back")):
                source = chunk_table(packed_rows.as_py())
                texts, held, row, every, inverse, cuts = tokens(source)
                times = np.zeros(len(every), np.int64)
                for x in back.as_py():
                    times[cuts[x["bucket"]]:cuts[x["bucket"] + 1]] = unpack(x["data"])[0]
                own = times[inverse]
                size = len(texts)
                nats = np.concatenate([mixed_bits(*with_ends(part_of(texts, g)), paths) for g in pieces_of(texts)])
                yield pa.RecordBatch.from_arrays([
                    source.column("doc_id").combine_chunks(), pa.array(held), pa.array(np.bincount(row, minlength=size)),
                    pa.array(np.bincount(row, own > 0, size).astype(np.int64)), pa.array(np.full(size, train_tokens, np.int64)),
                    pa.array(np.bincount(row, np.log10(own + 0.5) - norm, size)), pa.array(-nats / np.log(10)),
                    pa.array(nats / np.log(2) / np.maximum(np.diff(texts.at), 1))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = dict(rows.dtypes)["doc_id"]
    back = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("back"))
    return chunks.join(back, "chunk").select("rows", "back").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double, bits_per_byte double").withColumnRenamed("doc_id", id)
