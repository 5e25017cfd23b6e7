"""Token-id files: one zstandard frame a document under a shared dictionary, with an offset index.

A file set is a folder of two Parquet tables, so that any store Spark reaches can hold it:

* ``dictionary``: one row ``(hash, dictionary)``;
* ``blocks``: rows ``(part, block, low, high, rows, tokens, data)`` in ascending order of the ids, ``low`` and ``high`` being a
  block's least and greatest id.

``data`` is one block of documents: the header ``MAGIC``, version, bytes of an id, dictionary hash and
number of documents, then three arrays (document ids, ids of each document, byte
offsets of the frames, one more at the end) and the frames.  A document is read by its
offset alone; the other frames of its block are not decompressed, and ``read_documents`` passes blocks over by their ids.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import NO_ID, Texts, buckets, crc, shipped, slices
from pageloom.llm.tokens import default_path, encode, tokenizer

MAGIC = b"PLTK"
_HEADER = struct.Struct("<4sBBqq")
#: The dictionary is trained on this many documents of at most so many characters, those of smallest id hash.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 1000, 20_000, 32_768
LEVEL = 3


def id_type(path: str) -> np.dtype:
    """Two bytes an id where the vocabulary allows."""
    return np.dtype("<u2" if tokenizer(path, added=True)[0].get_vocab_size() <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, path: str, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, size: int = DICTIONARY) -> bytes:
    """A dictionary of serialized id arrays from a bounded, repeatable sample; empty when there is too little to learn from."""
    rows = (
        docs.where(F.length("text").between(1, chars)).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample)
        .select("text").toArrow()
    )
    if not rows.num_rows:
        return b""
    ids, at = encode(Texts.of(rows.column("text")), path, added=True)
    kind = id_type(path)
    try:
        return zstandard.train_dictionary(size, [ids[a:b].astype(kind).tobytes() for a, b in zip(at, at[1:])]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(data: bytes):
    return zstandard.ZstdCompressionDict(data) if data else None


def write_block(keys: np.ndarray, ids: np.ndarray, at: np.ndarray, compressor, kind: np.dtype, dictionary_hash: int) -> bytes:
    raw = ids.astype(kind)
    frames = [compressor.compress(raw[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    offsets = np.cumsum([0, *map(len, frames)]).astype("<i8")
    return b"".join((
        _HEADER.pack(MAGIC, 1, kind.itemsize, dictionary_hash, len(keys)), keys.astype("<i8").tobytes(),
        np.diff(at).astype("<i8").tobytes(), offsets.tobytes(), *frames))


class Block:
    """A block as written: ``keys``, ``counts`` and single documents by place."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, width, dictionary_hash, n = _HEADER.unpack_from(data)
        if magic != MAGIC or version != 1 or dictionary_hash != crc(dictionary):
            raise ValueError("not a block of this file set and dictionary")
        at = _HEADER.size
        self.keys = np.frombuffer(data, "<i8", n, at)
        self.counts = np.frombuffer(data, "<i8", n, at + 8 * n)
        self._offsets = np.frombuffer(data, "<i8", n + 1, at + 16 * n)
        self._frames = at + 24 * n + 8
        self._data, self._kind = data, np.dtype(f"<u{width}")
        self._reader = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def ids(self, i: int) -> np.ndarray:
        a, b = self._frames + self._offsets[i], self._frames + self._offsets[i + 1]
        return np.frombuffer(self._reader.decompress(self._data[a:b]), self._kind).astype("<u4")


def write_token_files(docs: DataFrame, out: str, id: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Writes every document's ids, an end id after each, in ascending order of ``id``.

    Null ids come last, rows of one id in order of a hash of their texts; a null or empty text is its end
    id alone.  Texts are dealt by ranges of the id and encoded after that shuffle; extra columns are ignored.
    """
    spark = shipped(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train_dictionary(rows, path)
    spark.createDataFrame([(crc(dictionary), dictionary)], "hash long, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    kind = id_type(path)

    def encode_blocks(batches):
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(dictionary))
        part, block = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, at = encode(Texts.of(batch.column("text")), path, added=True)
            keys = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            data = write_block(keys, ids, at, compressor, kind, crc(dictionary))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "low": pa.array(keys[:1], pa.int64()), "high": pa.array(keys[-1:], pa.int64()), "rows": pa.array([len(keys)], pa.int64()),
                "tokens": pa.array([len(ids)], pa.int64()), "data": pa.array([data], pa.binary())})
            block += 1

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    (
        rows.repartitionByRange(buckets(spark), *order).sortWithinPartitions(*order)
        .mapInArrow(encode_blocks, "part int, block int, low long, high long, rows long, tokens long, data binary")
        .write.option("compression", "uncompressed").parquet(f"{out}/blocks")
    )


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files: ``start`` counts the ids of all documents before, ``ids`` are little-endian 32-bit."""
    shipped(spark)
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    blocks = spark.read.parquet(f"{out}/blocks")
    # Ids before a part, then before a block of it: the one-task window sees a row a part.
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")
    starts = blocks.select("part", "block", inside.alias("inside")).join(parts, "part").select(
        "part", "block", (F.col("base") + F.col("inside")).alias("start"))

    def decode(batches):
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                block = Block(data.as_py(), dictionary)
                ids = [block.ids(i).tobytes() for i in range(len(block.keys))]
                begin = start + np.cumsum(block.counts) - block.counts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.keys, pa.int64(), mask=block.keys == NO_ID), "start": pa.array(begin),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return blocks.join(starts, ["part", "block"]).select("start", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(spark: SparkSession, out: str, wanted: list[int | None]) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of some documents, every row of their ids; ids that are not there give none.

    The ids' ranges go to the scan, which passes over blocks without them, and of the others only these documents' frames are
    decompressed.  ``wanted`` is a short list; None asks for documents without an id.
    """
    shipped(spark)
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()["dictionary"])
    keys = sorted({NO_ID if k is None else int(k) for k in wanted})
    blocks = spark.read.parquet(f"{out}/blocks")
    # A block that holds a key is not wholly below the least nor above the greatest, and some key lies in its range.
    held = F.exists(F.array(*map(F.lit, keys)).cast("array<long>"), lambda k: (F.col("low") <= k) & (F.col("high") >= k))
    found = blocks.where((F.col("low") <= keys[-1]) & (F.col("high") >= keys[0]) & held) if keys else blocks.limit(0)

    def decode(batches):
        for batch in batches:
            for data in batch.column("data"):
                block = Block(data.as_py(), dictionary)
                rows = np.flatnonzero(np.isin(block.keys, keys))
                ids = [block.ids(i).tobytes() for i in rows.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.keys[rows], pa.int64(), mask=block.keys[rows] == NO_ID),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return found.select("data").mapInArrow(decode, "doc_id long, n_tokens long, ids binary")
