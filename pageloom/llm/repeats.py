"""Windows of a corpus that occur again: the exchange that both repeat removers share.

Every window of ``window`` units (words or bytes) has an anchor, the ``gram``-unit
piece of it with the smallest hash.  Equal windows have equal anchors, so the
anchor's bucket is the only place where their copies need to meet:

1. Texts lie in chunk rows in the shared folder.  Each chunk sends the distinct
   hashes of its anchors to their buckets; a bucket answers which ones other chunks hold too.
2. Each chunk sends its distinct segments (the windows of one anchor, with the
   units they need) once, with their earliest place and a list of where they occur.
3. A bucket works out the earliest place of every window of every distinct segment
   (``solve``, the method proper) and answers each chunk with runs of windows and the list.
4. Each chunk marks its windows that begin earlier elsewhere.

A passage in a third of all documents is one segment of a chunk however often it
occurs there, so no bucket gathers its copies, and texts cross the network as
compressed chunks only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import NO_ID, Texts, buckets, gram_hashes, mixed, same_spans, shipped, slices, span_hashes, stored

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


@dataclass
class Method:
    """What differs between words and bytes."""

    window: int
    gram: int
    #: texts -> (unit hashes, number of each row's first unit, begin and end byte of units or None for bytes)
    units: Callable
    #: (contents, windows of each, doc, start) -> per content (first window, last window, doc, start) runs
    solve: Callable
    #: Whether an earlier place in the same document counts.
    within: bool
    #: Bytes of segments solved together, all those of an anchor at least; a bucket is a series of such shards.
    shard: int
    #: Buckets for each of the session's shuffle partitions, and megabytes of a chunk: less of either, less memory in a task.
    fold: int = 1
    chunk: float = 2


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(arrays, 5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def chunk_rows(docs: DataFrame, megabytes: float) -> DataFrame:
    """``docs`` (with a column ``text``) as stored rows ``(chunk, rows)`` of about ``megabytes`` of text each."""
    shipped(docs.sparkSession)

    def fold(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in slices(batches, megabytes=megabytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    folded = docs.mapInArrow(fold, "rows binary").withColumn("chunk", F.monotonically_increasing_id())
    return stored(folded.select("chunk", "rows"), "chunks")


def chunk_table(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def anchored(h: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first unit, windows, anchor hash) of the segments: consecutive windows of a row with one anchor."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) < window:
        return empty
    grams = gram_hashes(h, gram)
    # The hash's upper half decides, then the place: equal windows choose alike.
    v = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    best = sliding_min(v, window - gram + 1)
    ends = np.repeat(first[1:], np.diff(first))[:len(best)]
    at = np.flatnonzero(np.arange(window, len(best) + window) <= ends)
    if not len(at):
        return empty
    place = (best[at] & _LOW).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(fresh)
    # A least hash is a small one: mixed anew, anchors spread evenly over the buckets.
    return at[begin], np.diff(np.append(begin, len(at))), mixed(grams[place[begin]])


def contents(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, content: np.ndarray | None = None) -> np.ndarray:
    """A value of each segment's bytes, the same for two of one key only if their bytes are.

    Hashes tell candidates; every segment is then compared with the first of its key and value, and where they
    differ it takes another value.
    """
    content = span_hashes(data, start, end) if content is None else content.copy()
    while len(content):
        order = np.lexsort((content, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        first = np.empty(len(order), np.int64)
        first[order] = order[fresh][np.cumsum(fresh) - 1]
        apart = np.flatnonzero(~same_spans(data, start, end, first))
        if not len(apart):
            break
        content[apart] = mixed(content[apart] + np.uint64(1))
    return content


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> _32) * np.uint64(n)) >> _32).astype(np.int64)


def marked(docs: DataFrame, method: Method, id: str, finish: Callable, schema: str) -> DataFrame:
    """``docs`` with the units of repeated windows marked.

    ``finish(table, texts, units, removed)`` makes the columns of ``schema`` from a
    chunk's rows, the units of its texts and a flag for each unit.
    """
    n = buckets(docs.sparkSession) * method.fold
    window, gram = method.window, method.gram
    # Said here, the condition that an inner join adds leaves both joins below with one exchange of chunks.
    chunks = chunk_rows(docs, method.chunk).where("chunk IS NOT NULL")

    def read(rows: bytes):
        table = chunk_table(rows)
        texts = Texts.of(table.column("text"))
        units = method.units(texts)
        return table, texts, units

    def ask(batches):
        for batch in batches:
            for chunk, rows in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                _, _, (h, first, *_) = read(rows.as_py())
                keys = np.unique(anchored(h, first, window, gram)[2])
                cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()),
                    "keys": pa.array([keys[cuts[b]:cuts[b + 1]].tobytes() for b in full], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        twice = np.zeros(len(every), bool)
        same = np.flatnonzero(ranked[1:] == ranked[:-1])
        twice[order[same]] = True
        twice[order[same + 1]] = True
        cuts = np.cumsum([0, *map(len, parts)])
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(
            [np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())})

    def send(batches):
        for batch in batches:
            for chunk, rows, bits in zip(batch.column("chunk").to_pylist(), batch.column("rows"), batch.column("bits")):
                found = list(segments(rows.as_py(), bits.as_py()))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _ in found], pa.int32()), "chunk": pa.array([chunk] * len(found), pa.int64()),
                    "payload": pa.array([p for _, p in found], pa.binary())})

    def segments(rows: bytes, bits: list):
        table, texts, (h, first, begin, end) = read(rows)
        at, size, key = anchored(h, first, window, gram)
        keys, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(bucket_of(keys, n), np.arange(n + 1))
        again = count > 1
        for x in bits:
            a, b = cuts[x["bucket"]], cuts[x["bucket"] + 1]
            again[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
        hit = np.flatnonzero(again[inverse])
        if not len(hit):
            return
        at, size, key = at[hit], size[hit], key[hit]
        units = size + window - 1
        a = at if begin is None else begin[at]
        z = at + units if end is None else end[at + units - 1]
        content = contents(texts.data, a, z, key)
        row = np.searchsorted(first, at, "right") - 1
        doc = ids_of(table, id)[row]
        start = at - first[row]
        # The earliest place of each distinct segment leads; segments lie by key, so by bucket.
        order = np.lexsort((start, doc, content, key))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        number = np.cumsum(fresh) - 1
        lead = order[fresh]
        many = np.bincount(number) > 1
        a, z = a[lead], z[lead]
        data = texts.data.tobytes()
        edges = np.searchsorted(bucket_of(key[lead], n), np.arange(n + 1))
        spans = np.searchsorted(number, edges)
        for b in np.flatnonzero(np.diff(edges)):
            s, o = slice(edges[b], edges[b + 1]), slice(spans[b], spans[b + 1])
            own = lead[s]
            places = (number[o] - edges[b]).astype(np.uint32), row[order[o]].astype(np.uint32), start[order[o]]
            yield b, pack(places, key[own], content[own], size[own], doc[own], start[own], many[s],
                          z[s] - a[s], b"".join(data[x:y] for x, y in zip(a[s].tolist(), z[s].tolist())))

    def settle(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        parts = [unpack(x.as_py()) for x in table.column("payload")]
        of = np.repeat(np.arange(len(parts)), [len(x[1]) for x in parts])
        base = np.cumsum([0, *(len(x[1]) for x in parts)])
        key, content, size, doc, start, many, length = (np.concatenate([x[i] for x in parts]) for i in range(1, 8))
        text = b"".join(x[8] for x in parts)
        place = np.cumsum(length) - length
        content = contents(np.frombuffer(text, np.uint8), place, place + length, key, content)
        order = np.lexsort((start, doc, content, key))
        new_key = np.ones(len(order), bool)
        new_key[1:] = key[order][1:] != key[order][:-1]
        fresh = new_key.copy()
        fresh[1:] |= content[order][1:] != content[order][:-1]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(fresh) - 1
        lead = order[fresh]
        group = (np.cumsum(new_key) - 1)[fresh]
        hard = np.bincount(group)[group] > 1
        # A segment alone with its anchor: all its windows begin where it is first.
        alone = np.flatnonzero(~hard)
        solved = [(alone, np.zeros(len(alone), np.int64), size[lead[alone]] - 1, doc[lead[alone]], start[lead[alone]])]
        for where in shards(np.flatnonzero(hard), group, length[lead]):
            own = lead[where]
            runs = method.solve([text[place[i]:place[i] + length[i]] for i in own.tolist()], size[own], doc[own], start[own])
            solved.append((where[runs[0]], *runs[1:]))
        runs = [np.concatenate(x) for x in zip(*solved)]
        by = np.argsort(runs[0], kind="stable")
        runs = [x[by] for x in runs]
        span = np.searchsorted(runs[0], np.arange(len(lead) + 1))
        # Nothing to say about a segment whose only occurrence is the first one.
        needed = np.flatnonzero(hard[kind] | many | (doc != doc[lead[kind]]) | (start != start[lead[kind]]))
        out = []
        for p, part in enumerate(parts):
            mine = needed[slice(*np.searchsorted(of[needed], [p, p + 1]))]
            count = span[kind[mine] + 1] - span[kind[mine]]
            pick = np.repeat(span[kind[mine]] - np.cumsum(count) + count, count) + np.arange(count.sum())
            asked = np.zeros(base[p + 1] - base[p], bool)
            asked[mine - base[p]] = True
            there = asked[part[0][0]]
            out.append(pack(np.repeat(mine - base[p], count), *(x[pick] for x in runs[1:]), *(x[there] for x in part[0])))
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "runs": pa.array(out, pa.binary())})

    def shards(hard, group, length):
        """Parts of ``hard`` of about ``method.shard`` bytes that leave groups whole."""
        if not len(hard):
            return []
        begins = np.append(0, np.flatnonzero(np.diff(group[hard])) + 1)
        shard = (np.cumsum(length[hard]) - length[hard])[begins] // method.shard
        return np.split(hard, begins[np.flatnonzero(np.diff(shard)) + 1])

    def mark(batches):
        for batch in batches:
            for rows, runs in zip(batch.column("rows"), batch.column("runs")):
                table, texts, units = read(rows.as_py())
                h, first = units[0], units[1]
                edge = np.zeros(len(h) + 1, np.int64)
                for part in runs.as_py() or ():
                    cover(edge, first, ids_of(table, id), *unpack(part))
                yield from finish(table, texts, units, np.cumsum(edge[:-1]) > 0).to_batches()

    def cover(edge, first, ids, which, low, high, doc, origin, number, row, start):
        """Adds the windows of a bucket's runs at the places of their segments."""
        if not len(number):
            return
        span = np.searchsorted(which, np.arange(number.max() + 2))
        count = (span[1:] - span[:-1])[number]
        pick = np.repeat(span[:-1][number] - np.cumsum(count) + count, count) + np.arange(count.sum())
        row, start = np.repeat(row, count), np.repeat(start, count)
        low, high, doc, origin = low[pick], high[pick], doc[pick], origin[pick]
        earlier = doc < ids[row]
        if method.within:
            earlier |= (doc == ids[row]) & (origin < start)
        unit = first[row[earlier]] + start[earlier]
        np.add.at(edge, unit + low[earlier], 1)
        np.add.at(edge, unit + high[earlier] + window, -1)

    bits = (
        chunks.mapInArrow(ask, "bucket int, chunk long, keys binary").groupBy("bucket")
        .applyInArrow(answer, "chunk long, bucket int, bits binary")
        .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))
    )
    # One query from here: the chunks' exchange serves both joins.
    sent = chunks.join(bits, "chunk").mapInArrow(send, "bucket int, chunk long, payload binary")
    runs = (
        sent.groupBy("bucket").applyInArrow(settle, "chunk long, runs binary")
        .groupBy("chunk").agg(F.collect_list("runs").alias("runs"))
    )
    return chunks.join(runs, "chunk", "left").mapInArrow(mark, schema)


def ids_of(table: pa.Table, id: str) -> np.ndarray:
    return table.column(id).cast(pa.int64()).fill_null(NO_ID).to_numpy()
