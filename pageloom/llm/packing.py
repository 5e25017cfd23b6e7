"""Sequence packing: shortest-pack-first over the length histogram."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import Texts, shipped, slices, stored
from pageloom.llm.tokens import default_path, encode, id_bytes

LENGTH = 1024


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(how many, lengths) of the packs that hold all pieces of a length histogram.

    Longest first; a length goes to the shortest packs that there are, as many at a time as both
    have, and opens new ones when it does not fit even there.
    """
    space: dict[int, list[list]] = defaultdict(list)  # free ids -> packs [how many, lengths]
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            free = max((f for f, packs in space.items() if packs), default=0)
            if free < size:
                space[length - size].append([left, (size,)])
                break
            pack = space[free][-1]
            n = min(left, pack[0])
            pack[0] -= n
            if not pack[0]:
                space[free].pop()
            space[free - size].append([n, (*pack[1], size)])
            left -= n
    return [(n, p) for packs in space.values() for n, p in packs]


def slots(histogram: dict[int, int], length: int = LENGTH) -> dict[str, np.ndarray]:
    """Where pieces go, by length and rank: sorted ranges with their first sequence and offset."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, pattern in patterns(histogram, length):
        offset = 0
        for size in pattern:
            rows.append((size, used[size], sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    rows.sort()
    size, low, sequence_id, offset = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((),) * 4))
    return {"key": (size << 44) + low, "low": low, "sequence": sequence_id, "offset": offset}


def token_pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Stored pieces of at most ``length`` ids: ``(doc_id, start, length, doc_tokens, ids, part, nth)``.

    ``nth`` numbers the pieces of one length inside ``part``, the task that wrote them.
    """
    shipped(docs.sparkSession)
    path = path or default_path()

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in slices(batches):
            ids, at = encode(Texts.of(batch.column("text")), path, added=True)
            total = np.diff(at)
            count = -(-total // length)
            row = np.repeat(np.arange(len(total)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
            size = np.minimum(length, total[row] - start)
            order = np.argsort(size, kind="stable")
            nth = np.empty(len(row), np.int64)
            ranked = size[order]
            nth[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(size, minlength=length + 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(total[row]),
                id_bytes(ids, np.append(at[row] + start, at[-1])), pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
                ["doc_id", "start", "length", "doc_tokens", "ids", "part", "nth"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return stored(rows.mapInArrow(
        cut, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, part int, nth long"), "pieces")


def packed(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Documents as token sequences of ``length`` ids: one row a piece.

    Returns the id, ``start`` (ids of the document before the piece), ``length``, ``doc_tokens`` (with the
    end id), ``sequence_id``, ``offset`` in the sequence and ``ids`` (little-endian 32-bit).
    Documents are cut into full sequences and a rest; only the histogram of lengths,
    ``length`` numbers, comes to the driver, which works out patterns and their
    counts.  A piece's rank among those of its length, counted per task and then over tasks,
    says which pattern's slot is its own, so no length is a group of one task.
    A null or empty text is its end id alone; repeated rows are pieces of their own; a null id stays null.
    No rows in, no rows out; extra columns are ignored.
    """
    pieces = token_pieces(docs, id, text, path, length)
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(histogram, length)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    # One row a task: the ranks before it, by length.
    offsets = stored(
        counts.withColumn("before", before).groupBy("part")
        .agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("before")), "ranks")

    def place(batches):
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.searchsorted(where["key"], (size << 44) + rank, "right") - 1
            sequence = where["sequence"][slot] + rank - where["low"][slot]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "doc_tokens")),
                 pa.array(sequence, pa.int64()), pa.array(where["offset"][slot], pa.int64()), batch.column("ids")],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    ranked = (
        pieces.join(offsets, "part").withColumn("rank", F.col("nth") + F.element_at("before", F.col("length")))
        .select("doc_id", "start", "length", "doc_tokens", "rank", "ids")
    )
    kind = dict(pieces.dtypes)["doc_id"]
    return ranked.mapInArrow(
        place, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("doc_id", id)
