"""Byte-level BPE ids of whole texts, each distinct piece encoded once.

The pre-tokenizer never joins a letter, digit or mark with white space after it, nor a letter or digit with
an ASCII mark after it, and looks only ahead, so a text may be cut there and its pieces
encoded alone.  A batch is cut by array operations; the tokenizer sees only pieces
that a Python worker has not met yet.  Added tokens of the file, if wanted, are found first and are pieces of their own,
as the tokenizer splits a text at them before all else.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pageloom.llm.common import _SPACE, Texts, same_spans, span_hashes

VOCABULARY = "byte_bpe_50k.json"
END = 0
#: Pieces that a worker remembers; beyond it begins anew.
MEMORY = 400_000

_word = np.zeros(256, bool)
_word[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_print = np.zeros(256, bool)
_print[0x21:0x7F] = True
_mark = _print & ~_word
_known: dict[tuple[str, bool], tuple[Tokenizer, dict[bytes, bytes], re.Pattern | None]] = {}


def tokenizer(path: str, added: bool = False) -> tuple[Tokenizer, dict[bytes, bytes], re.Pattern | None]:
    """The tokenizer of a file, this worker's memory of pieces and a pattern of its added tokens.

    Unless ``added``, the names of special tokens in a text are ordinary text.
    """
    if (path, added) not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = not added
        names = made.get_added_tokens_decoder().values() if added else ()
        if any(t.lstrip or t.rstrip or t.single_word for t in names):
            raise ValueError("added tokens that take in white space or need a word's bounds cannot be cut out")
        # The leftmost counts, and of those the longest.
        names = sorted((t.content.encode() for t in names), key=len, reverse=True)
        _known[path, added] = made, {}, re.compile(b"|".join(map(re.escape, names))) if names else None
    return _known[path, added]


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def named(texts: Texts, data: bytes, names: re.Pattern | None) -> list[tuple[int, int]]:
    """Byte ranges of added tokens; none reaches over the end of a row."""
    found, at = [], 0
    while names and (match := names.search(data, at)):
        stop = int(texts.at[np.searchsorted(texts.at, match.start(), "right")])
        if match.end() > stop and not (match := names.search(data, at, stop)):
            at = stop
            continue
        found.append(match.span())
        at = match.end()
    return found


def pieces(texts: Texts, whole: list[tuple[int, int]] = []) -> np.ndarray:
    """Byte places where pieces begin; every row begins one, and each range of ``whole`` is one."""
    d = texts.data
    cut = np.zeros(len(d) + 1, bool)
    if len(d) > 1:
        # U+00C0 to U+00FF but for the two signs are letters: C3 and a continuation byte.
        latin = np.zeros(len(d), bool)
        latin[1:] = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] < 0xC0) & (d[1:] != 0x97) & (d[1:] != 0xB7)
        before = _word[d] | latin
        cut[1:-1] = (_SPACE[d[1:]] & (before | _mark[d])[:-1]) | (_mark[d[1:]] & before[:-1])
    cut[texts.at] = True
    for a, b in whole:
        cut[a + 1:b] = False
        cut[[a, b]] = True
    return np.flatnonzero(cut[:-1])


def piece_keys(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit key of each piece, numbers of those of over seven bytes).

    A key of up to seven bytes is the bytes and their count, so it is exact; the others are hashes with the highest bit set.
    """
    size = stop - start
    padded = np.append(data, np.zeros(8, np.uint8)).tobytes()
    keys = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[start]
    short = np.minimum(size, 7).astype(np.uint64)
    keys &= (np.uint64(1) << (short * np.uint64(8))) - np.uint64(1)
    keys |= short << np.uint64(56)
    long = np.flatnonzero(size > 7)
    keys[long] = span_hashes(data, start[long], stop[long]) | np.uint64(1 << 63)
    return keys, long


def encode(texts: Texts, path: str, end: int = END, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each row's begin; one more at the end) with ``end`` after each row.

    With ``added``, ids are those of the tokenizer as loaded from its file, which gives an added token inside a text its
    own id; without, such a name is ordinary text.
    """
    made, memory, names = tokenizer(path, added)
    data = texts.data.tobytes()
    start = pieces(texts, named(texts, data, names))
    ids, count, first = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inverse = np.zeros(0, np.int64)
    if len(start):
        stop = np.append(start[1:], len(texts.data))
        keys, long = piece_keys(texts.data, start, stop)
        _, lead, inverse = np.unique(keys, return_index=True, return_inverse=True)
        # Long pieces that share a hash without being one stand for themselves.
        apart = long[~same_spans(texts.data, start, stop, lead[inverse], long)]
        inverse[apart] = len(lead) + np.arange(len(apart))
        lead = np.append(lead, apart)
        distinct = [data[a:b] for a, b in zip(start[lead].tolist(), stop[lead].tolist())]
        fresh = [x for x in distinct if x not in memory]
        if len(memory) + len(fresh) > MEMORY:
            memory.clear()
            fresh = distinct
        for x, made_ids in zip(fresh, made.encode_batch_fast([x.decode() for x in fresh], add_special_tokens=False)):
            memory[x] = np.array(made_ids.ids, "<u4").tobytes()
        parts = [memory[x] for x in distinct]
        count = np.array([len(x) for x in parts], np.int64) // 4
        first = np.cumsum(count) - count
        ids = np.frombuffer(b"".join(parts), "<u4")
    each = count[inverse]
    upto = np.append(0, np.cumsum(each))
    row_at = upto[np.searchsorted(start, texts.at)] + np.arange(len(texts) + 1)
    out = np.full(row_at[-1], end, np.uint32)
    inside = np.ones(len(out), bool)
    inside[row_at[1:] - 1] = False
    out[inside] = ids[np.repeat(first[inverse] - upto[:-1], each) + np.arange(upto[-1])]
    return out, row_at


def id_bytes(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of ids as binary values of little-endian 32-bit integers."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
