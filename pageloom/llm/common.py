"""Shared folders, text buffers and word hashes for the operators of this folder.

Texts travel as Arrow batches.  ``Texts`` lays the rows of a batch end to end in
one byte array, so words, windows and their hashes are array operations and no
row becomes a Python object.  A missing text counts as an empty one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that are null sort last; the largest long stands for them inside the operators.
NO_ID = np.iinfo(np.int64).max
WORD = r"[^\x20\x09-\x0D]+"
TEXT_MB = 4


_written: list[str] = []


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder of the session's ``spark.checkpoint.dir``.

    Only a session of this machine alone, as in tests, may do without that setting: on a cluster nothing else is shared for sure.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='pageloom-llm-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, no executor is needed again."""
    path = scratch_dir(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Removes what ``stored`` has written in this process; for when results are written, as they read from it."""
    while _written:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shipped(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package from where it lies."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return spark


def buckets(spark: SparkSession) -> int:
    """How many buckets keyed work is dealt into: the session's shuffle partitions, set to the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(key: str, n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


# ---- Text buffers ---------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, ``n`` of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


class Texts:
    """The texts of some rows, end to end: ``data`` bytes and ``at``, where each row begins (one more at the end)."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    @staticmethod
    def of(column: pa.Array) -> "Texts":
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
        return Texts(data, at - at[0])

    def __len__(self) -> int:
        return len(self.at) - 1

    def lower(self) -> "Texts":
        return Texts(_LOWER[self.data], self.at)

    def row(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i + 1]].tobytes()

    def words(self) -> "Words":
        """Runs of bytes other than white space; a row's end ends a word."""
        n = len(self.data)
        if n == 0:
            return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64), self)
        full = ~_SPACE[self.data]
        fresh = np.zeros(n + 1, bool)
        fresh[self.at] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = full[:-1]
        start = np.flatnonzero(full & (~before | fresh[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = full[1:]
        end = np.flatnonzero(full & (~after | fresh[1:])) + 1
        return Words(start, end, np.searchsorted(start, self.at), self)


class Words:
    """Words of ``texts``: byte ranges, and in ``first`` the number of each row's first word (one more at the end)."""

    def __init__(self, start, end, first, texts):
        self.start, self.end, self.first, self.texts = start, end, first, texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit value of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return span_hashes(self.texts.data, self.start, self.end)

    def windows(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all ``n`` consecutive words of one row, in order."""
        h = self.hashes() if hashes is None else hashes
        grams = gram_hashes(h, n)
        left = np.repeat(self.first[1:], self.counts)[:len(grams)]
        at = np.flatnonzero(np.arange(len(grams)) + n <= left)
        return at, grams[at]


def lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte ranges in steps of eight bytes: (value, number within its range, where each range's begin; one more at the end).

    Bytes beyond a range count as zero; ranges may overlap and be empty.
    """
    count = (end - start + 7) >> 3
    at = np.append(0, np.cumsum(count))
    number = np.arange(at[-1]) - np.repeat(at[:-1], count)
    place = np.repeat(start, count) + 8 * number
    padded = np.append(data, np.zeros(8, np.uint8))
    every = np.ndarray(len(data) + 1, "<u8", padded.tobytes(), strides=(1,))
    value = every[place]
    short = np.flatnonzero(np.repeat(end, count) - place < 8)
    left = (np.repeat(end, count)[short] - place[short]).astype(np.uint64)
    value[short] &= (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1)
    return value, number, at


def sequence_hashes(values: np.ndarray, number: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit value of each run of ``values`` and its ``size``; each value is spread with its number before the sum."""
    out = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] += np.add.reduceat(mixed(values + (number.astype(np.uint64) + np.uint64(1)) * _ODD), at[:-1][full])
    return mixed(out)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit values of byte ranges."""
    return sequence_hashes(*lanes(data, start, end), end - start)


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Whether each byte range, or each of ``rows``, equals that of the number ``other``, byte by byte."""
    rows = np.arange(len(start)) if rows is None else rows
    with_ = other[rows]
    same = (end - start)[rows] == (end - start)[with_]
    at = np.flatnonzero(same & (with_ != rows))
    one, two = rows[at], with_[at]
    left, _, first = lanes(data, start[one], end[one])
    right, _, _ = lanes(data, start[two], end[two])
    wrong = np.append(0, np.cumsum(left != right))
    same[at] = wrong[first[1:]] == wrong[first[:-1]]
    return same


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of ``n`` consecutive values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    out = h[:size].copy()
    for i in range(1, n):
        out *= _ODD
        out += h[i:i + size]
    return mixed(out)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", megabytes: float = TEXT_MB) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about ``megabytes`` of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // int(megabytes * 1e6)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(size)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def per_batch(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(batch)`` gives columns by name, or None; one call for each slice of texts."""
    shipped(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def work(batches):
        for batch in slices(batches):
            out = run(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names)

    return df.mapInArrow(work, schema)


def matrix_sum(rows: DataFrame, value: Callable, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices ``value(batch)`` over all batches: in each task, then row by row in the order of the tasks."""
    def add(batches):
        total, some = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total, some = total + value(batch), True
        if some:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(len(total)), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()),
                "row": pa.array([r.tobytes() for r in total], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        table, total = table.sort_by("part"), np.zeros(shape[1])
        for r in table.column("row"):
            total += np.frombuffer(r.as_py())
        return pa.table({"i": table.column("i")[:1], "row": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(shape)
    for r in rows.mapInArrow(add, "i int, part int, row binary").groupBy("i").applyInArrow(meet, "i int, row binary").collect():
        out[r["i"]] = np.frombuffer(r["row"])
    return out


def _array(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x)


def sum_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive places of ``first``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
