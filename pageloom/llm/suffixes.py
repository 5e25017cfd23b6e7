"""Suffix-array dedup over bytes: deep-shallow sorting of the positions that may repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import _BYTE, sum_rows
from pageloom.llm.repeats import Method, marked

WINDOW = 100
#: Bytes of an anchor.
GRAM = 16
#: Bytes that multikey quicksort looks at, eight at a time, before the blind tries take over.
SHALLOW = 16
#: Positions compared at a time.
BLOCK = 1 << 16
#: Bytes of segments sorted together.
SHARD = 1_000_000


def _groups(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, size) of the groups that begin where ``new`` is set."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def deep_shallow(data: bytes, at: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` at ``at`` in order of their first ``depth`` bytes.

    Returns the order and a flag at each suffix that differs from the one before it
    within ``depth``; all of them have ``depth`` bytes.  Multikey quicksort orders the
    first ``shallow`` bytes, a word of eight at a time, inside the groups that are
    equal so far.  Groups with longer common prefixes go to blind tries: a group's
    first suffix is the path, every other one leaves it at a branch (length, side
    and byte), and each branch is a smaller group that is known to agree up to there.
    All groups take a step together.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    order = np.arange(len(at))
    new = np.zeros(len(at), bool)
    new[0] = True
    for level in range(0, shallow, 8):
        first, size = _groups(new)
        live = np.flatnonzero(np.repeat(size > 1, size))
        if not len(live):
            return order, new
        group = np.repeat(np.arange(len(first)), size)[live]
        key = words[at[order[live]] + level].astype(np.uint64)
        by = np.lexsort((key, group))
        order[live] = order[live][by]
        fresh = np.ones(len(live), bool)
        fresh[1:] = (group[by][1:] != group[by][:-1]) | (key[by][1:] != key[by][:-1])
        new[live] |= fresh
    offsets = [*range(shallow, depth - 7, 8)]
    offsets += [depth - 8] if not offsets or offsets[-1] + 8 < depth else []
    done = np.zeros(len(at), bool)
    while True:
        first, size = _groups(new)
        live = np.flatnonzero(np.repeat(size > 1, size) & ~done)
        if not len(live):
            return order, new
        pivot = np.repeat(first, size)[live]
        share = np.empty(len(live), np.int64)
        side = np.empty(len(live), np.int8)
        byte = np.zeros(len(live), np.int16)
        for b in range(0, len(live), BLOCK):
            s = slice(b, b + BLOCK)
            share[s], side[s], byte[s] = _leave(words, at[order[live[s]]], at[order[pivot[s]]], offsets, depth)
        # Smaller suffixes leave the path early first, larger ones late first.
        along = np.where(side < 0, share, np.where(side > 0, -share, 0))
        by = np.lexsort((byte, along, side, pivot))
        order[live] = order[live][by]
        columns = [x[by] for x in (pivot, side, along, byte)]
        fresh = np.ones(len(live), bool)
        fresh[1:] = np.any([x[1:] != x[:-1] for x in columns], 0)
        new[live] |= fresh
        done[live] = side[by] == 0


def _leave(words, at, path, offsets, depth):
    """(common bytes, side, byte) at which each suffix leaves its path; side 0 if it stays for ``depth`` bytes."""
    share = np.full(len(at), depth)
    side = np.zeros(len(at), np.int8)
    byte = np.zeros(len(at), np.int16)
    left = np.arange(len(at))
    for o in offsets:
        mine, other = words[at[left] + o].astype(np.uint64), words[path[left] + o].astype(np.uint64)
        apart = np.flatnonzero(mine != other)
        if len(apart):
            x = mine[apart] ^ other[apart]
            # The first byte that differs: above it all bytes of the xor are 0.
            k = 7 - np.searchsorted(_TOPS, x, "right")
            who = left[apart]
            share[who] = o + k
            side[who] = np.where(mine[apart] < other[apart], -1, 1)
            byte[who] = (mine[apart] >> (8 * (7 - k)).astype(np.uint64)) & np.uint64(255)
            left = np.delete(left, apart)
        if not len(left):
            break
    return share, side, byte


_TOPS = np.array([1 << (8 * i) for i in range(1, 8)], np.uint64)


def _solve(contents, sizes, docs, starts):
    """Runs of windows whose first equal window lies in one document at a steady distance."""
    empty = np.zeros(0, np.int64)
    if not contents:
        return [empty] * 5
    place = np.cumsum([0, *map(len, contents)])[:-1]
    which = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order, new = deep_shallow(b"".join(contents), place[which] + nth, WINDOW)
    doc, start = docs[which], starts[which] + nth
    run = np.cumsum(new) - 1
    by = np.lexsort((start[order], doc[order], run))
    lead = order[by[np.flatnonzero(new)]]  # the run's first window in (document, place)
    first_doc, first_start = np.empty(len(which), np.int64), np.empty(len(which), np.int64)
    first_doc[order], first_start[order] = doc[lead][run], start[lead][run]
    shift = first_start - nth
    fresh = np.ones(len(which), bool)
    fresh[1:] = (which[1:] != which[:-1]) | (first_doc[1:] != first_doc[:-1]) | (shift[1:] != shift[:-1])
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(which)) - 1
    # A run's origin is where its window 0 would begin, so that origin and occurrence compare window by window.
    return [which[begin], nth[begin], nth[last], first_doc[begin], shift[begin]]


def _units(texts):
    return _BYTE[texts.data], texts.at, None, None


def without_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without the bytes of 100-byte strings that begin earlier in the corpus too.

    Returns the id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``spans`` (their begins and ends) and ``kept``, the bytes left; a span may cut
    a character, so these are bytes and not a text.  Earlier means in a document of smaller id, or
    in the same one at a smaller place; overlaps count and strings are judged on the input.  Positions whose
    anchor the corpus repeats are dealt to shards by content and suffix-sorted
    there to the depth of a string; equal neighbours in that order are its repeats.
    A null or empty text has no bytes.  Null ids rank last; rows of one id
    count as the same document.  Extra columns are ignored.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))

    def finish(table, texts, units, removed):
        n = len(removed)
        on, off = removed.copy(), removed.copy()
        row_first = np.zeros(n + 1, bool)
        row_first[texts.at] = True
        if n:
            on[1:] &= ~removed[:-1] | row_first[1:n]
            off[:-1] &= ~removed[1:] | row_first[1:n]
        begin, end = np.flatnonzero(on), np.flatnonzero(off) + 1
        spans = np.searchsorted(begin, texts.at)
        base = np.repeat(texts.at[:-1], np.diff(spans))
        pairs = pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["begin", "end"])
        at = np.append(0, np.cumsum(sum_rows((~removed).astype(np.int64), texts.at))).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(texts.data[~removed])]).cast(pa.binary())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(texts.at),
                         "n_removed": sum_rows(removed.astype(np.int64), texts.at), "n_spans": np.diff(spans),
                         "spans": pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs), "kept": kept})

    out = marked(rows, Method(WINDOW, GRAM, _units, _solve, within=True, shard=SHARD, fold=4, chunk=1), "doc_id", finish,
                 "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept binary")
    return out.withColumnRenamed("doc_id", id)
