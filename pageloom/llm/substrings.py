"""Substring dedup over words: matching statistics against suffix automata of reference shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import NO_ID, sum_rows
from pageloom.llm.repeats import Method, marked

WINDOW = 13
#: Words of an anchor.
GRAM = 5
#: Bytes of segments in one automaton.
SHARD = 200_000


class SuffixAutomaton:
    """All substrings of the token lists added, each with the least owner of a list that holds it.

    Lists are added in ascending order of their owners.
    """

    def __init__(self):
        self.moves, self.link, self.length, self.least = [{}], [-1], [0], [NO_ID]

    def add(self, tokens: list[int], owner: int) -> None:
        last = 0
        for token in tokens:
            last = self._extend(last, token)
            if owner < self.least[last]:
                self.least[last] = owner

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(NO_ID)
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """A state of its own for the strings that reach ``q`` from ``p``; ``q`` itself if it holds no longer ones."""
        moves, link = self.moves, self.link
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(moves[q]), link[q])
        link[q] = part
        while p != -1 and moves[p].get(token) == q:
            moves[p][token] = part
            p = link[p]
        return part

    def _extend(self, last: int, token: int) -> int:
        moves, link = self.moves, self.link
        q = moves[last].get(token)
        if q is not None:
            return self._split(last, token, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and token not in moves[p]:
            moves[p][token] = new
            p = link[p]
        if p != -1:
            link[new] = self._split(p, token, moves[p][token])
        return new

    def close(self) -> None:
        """Hands each state's least owner to its suffixes."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def owners(self, tokens: list[int], size: int) -> list[int]:
        """By place, the least owner of the ``size`` tokens ending there; ``NO_ID`` where they do not occur.

        Matching statistics: state and length of the longest match that ends at each token.
        """
        moves, link, length, least = self.moves, self.link, self.length, self.least
        state, match, out = 0, 0, []
        for token in tokens:
            while state and token not in moves[state]:
                state = link[state]
                match = length[state]
            if token in moves[state]:
                state = moves[state][token]
                match += 1
            while state and length[link[state]] >= size:
                state = link[state]
                match = length[state]
            out.append(least[state] if match >= size else NO_ID)
        return out


def _solve(contents, sizes, docs, starts):
    """Runs of windows with one least document, read from the shard's automaton."""
    numbers: dict[bytes, int] = {}
    lists = [[numbers.setdefault(w, len(numbers)) for w in c.split()] for c in contents]
    automaton = SuffixAutomaton()
    for i in np.argsort(docs, kind="stable").tolist():
        automaton.add(lists[i], int(docs[i]))
    automaton.close()
    out = [[], [], [], [], []]
    for i, tokens in enumerate(lists):
        least = np.array(automaton.owners(tokens, WINDOW)[WINDOW - 1:], np.int64)
        cuts = np.append(0, np.flatnonzero(np.diff(least)) + 1)
        out[0].append(np.full(len(cuts), i))
        out[1].append(cuts)
        out[2].append(np.append(cuts[1:], len(least)) - 1)
        out[3].append(least[cuts])
        out[4].append(np.zeros(len(cuts), np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _units(texts):
    words = texts.words()
    return words.hashes(), words.first, words.start, words.end


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Documents without the words of 13-word windows that a document of smaller id holds too.

    Returns the id, the columns named in ``carry``, ``n_words``, ``n_removed`` and ``kept``,
    the text without the removed words and the white space after each.  Windows
    are judged on the input.  The corpus itself is the reference: its repeated
    passages are dealt into shards by content, each shard builds a suffix automaton
    over words, and the segments of the documents that can match there are
    streamed through it; sending every document past every automaton would be
    quadratic, and no broadcast grows with the corpus.
    A null or empty text has no words and is kept as the empty text.  Null ids rank
    last; rows of one id do not remove each other.  Extra columns are ignored.
    """
    others = [c for c in carry if c not in (id, text)]
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)])

    def finish(table, texts, units, removed):
        _, first, start, end = units
        edge = np.zeros(len(texts.data) + 1, np.int64)
        # A removed word goes with what follows it, up to the next word or the text's end.
        after = np.append(start[1:], len(texts.data))
        after = np.minimum(after, np.repeat(texts.at[1:], np.diff(first)))
        np.add.at(edge, start[removed], 1)
        np.add.at(edge, after[removed], -1)
        keep = np.cumsum(edge[:-1]) == 0
        at = np.append(0, np.cumsum(sum_rows(keep.astype(np.int64), texts.at)))
        kept = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(texts.data[keep])]).cast(pa.large_string()).cast(pa.string())
        return pa.table({"doc_id": table.column("doc_id"), **{f"_{i}": table.column(f"_{i}") for i in range(len(others))},
                         "n_words": np.diff(first), "n_removed": sum_rows(removed.astype(np.int64), first), "kept": kept})

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "text") + ", n_words long, n_removed long, kept string"
    out = marked(rows, Method(WINDOW, GRAM, _units, _solve, within=False, shard=SHARD), "doc_id", finish, schema)
    return out.select(F.col("doc_id").alias(id), *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], "n_words", "n_removed", "kept")
