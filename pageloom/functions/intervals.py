"""Which elements the rows of a page lie in, found by sweeps over arrays of places."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The sweep travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Pages:
    """Rows of many pages end to end, each page in the order of ``start``, with a boolean array for each flag.

    Places of different pages are moved apart, so one running maximum serves all pages.  A match is an array of flags; what is
    found is an array of row numbers, -1 for none.
    """

    def __init__(self, sizes: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray, bits: np.ndarray, names: list[str]) -> None:
        self.sizes, self.page = sizes, np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        base = self.page << 32
        self.places, self.depth = start, depth
        self.start, self.end = start + base, end + base
        self.first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.row = np.arange(len(start))
        self.flags = {name: (bits >> i) & 1 == 1 for i, name in enumerate(names)}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.flags[name]

    def _latest(self, hit: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(hit, self.row, -1)) if len(hit) else self.row

    def _reach(self, hit: np.ndarray) -> np.ndarray:
        """Largest end of the matches so far."""
        return np.maximum.accumulate(np.where(hit, self.end, -1)) if len(hit) else self.end

    @staticmethod
    def _before(reach: np.ndarray) -> np.ndarray:
        return np.concatenate(([-1], reach))[:-1]

    def outermost(self, hit: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """The outermost match around each row, itself included; with ``within``, of the matches that lie in one of those."""
        hit = hit if within is None else hit & (within >= 0)
        at = self._latest(hit & (self.end > self._before(self._reach(hit))))
        return np.where((at >= 0) & (self.end[at] >= self.start), at, -1)

    def first_of_page(self, hit: np.ndarray) -> np.ndarray:
        """The first match of the page, on the rows inside it."""
        return self.first_inside(hit, self.first)

    def first_inside(self, hit: np.ndarray, within: np.ndarray) -> np.ndarray:
        """The first match of each ``within`` element, on the rows inside it."""
        at = np.flatnonzero(hit & (within >= 0))
        leads = np.zeros(len(hit), bool)
        leads[at[np.flatnonzero(np.diff(within[at], prepend=-1))]] = True
        at = self._latest(leads)
        return np.where((at >= 0) & (within[at] == within) & (self.end[at] >= self.start), at, -1)

    def below(self, of: np.ndarray) -> np.ndarray:
        """Whether a row lies in the element found for it and is not that element."""
        return (of >= 0) & (self.start > self.start[of])

    def direct(self, of: np.ndarray) -> np.ndarray:
        """Whether a row is a child of the element found for it."""
        return (of >= 0) & (self.depth == self.depth[of] + 1)

    def covered(self, hidden: np.ndarray, replaced: np.ndarray) -> np.ndarray:
        """Whether a row lies in a hidden element, itself included, or in a replaced one, itself apart."""
        return self.start <= np.maximum(self._reach(hidden), self._before(self._reach(replaced)))

    def holds(self, hit: np.ndarray) -> np.ndarray:
        """Whether a match lies inside each row's element, itself apart: the next one ahead starts there."""
        ahead = np.minimum.accumulate(np.where(hit, self.start, np.iinfo(np.int64).max)[::-1])[::-1]
        return np.concatenate((ahead[1:], [np.iinfo(np.int64).max]))[: len(hit)] <= self.end

    def gone(self, hit: np.ndarray) -> np.ndarray:
        """Whether a row lies in a match, itself included."""
        return self.start <= self._reach(hit)

    def start_of(self, of: np.ndarray) -> np.ndarray:
        return np.where(of >= 0, self.places[of], -1)

    def end_of(self, of: np.ndarray) -> np.ndarray:
        return np.where(of >= 0, (self.end - self.start + self.places)[of], -1)

    def size_of(self, of: np.ndarray) -> np.ndarray:
        """On the row of each element that is found for some, the number of rows it is found for; -1 elsewhere."""
        size = np.bincount(of[of >= 0], minlength=len(of))
        return np.where((size > 0) & (of == self.row), size, -1)

    def above(self, asks: np.ndarray, steps: int, among: np.ndarray, depth: np.ndarray | None = None) -> np.ndarray:
        """The last row ahead of each asking one that is so many steps less deep; the one around it, where that is among the rows."""
        deep = (self.depth if depth is None else depth) + steps + 2
        kind, rows = self.first * (deep.max(initial=0) + 1) + deep, len(deep) + 1
        known = np.sort((kind * rows + self.row)[among])
        at, out = np.flatnonzero(asks), np.full(len(deep), -1)
        wanted = kind[at] - steps
        last = known[np.searchsorted(known, wanted * rows + at) - 1] if len(known) else np.full(len(at), -1)
        out[at] = np.where((last >= 0) & (last // rows == wanted) & (last % rows < at), last % rows, -1)
        return out

    def open(self, hit: np.ndarray) -> np.ndarray:
        """How many matches are open around each row, itself apart."""
        return np.cumsum(hit) - hit - np.searchsorted(np.sort(self.end[hit]), self.start)

    def nearest(self, hit: np.ndarray) -> np.ndarray:
        """The innermost match around each row, itself apart: the last one ahead that one match less is open around."""
        return self.above(np.ones(len(hit), bool), 1, hit, self.open(hit))

    def nth_next(self, hit: np.ndarray, n: int) -> np.ndarray:
        """For each match, the ``n``-th match of its page behind it."""
        at, out = np.flatnonzero(hit), np.full(len(hit), -1)
        same = self.first[at[:-n]] == self.first[at[n:]]
        out[at[:-n][same]] = at[n:][same]
        return out


    def at(self, rows: np.ndarray) -> np.ndarray:
        """Where rows stand in the array of their page; -1 for none."""
        return np.where(rows >= 0, rows - self.first[rows], -1) if len(self.first) else rows

    def once(self, hit: np.ndarray) -> np.ndarray:
        """The matching rows; of those at one place the last."""
        rows = np.flatnonzero(hit)
        return rows[np.append(np.diff(self.start[rows]) != 0, True)] if len(rows) else rows

    def listed(self, rows: np.ndarray, **columns) -> pa.ListArray:
        """The given rows of each page, in order, as structs of columns that go with them; numbers below 0 become null."""
        ends = np.cumsum(np.bincount(self.page[rows], minlength=len(self.sizes)))
        return pa.ListArray.from_arrays(_offsets(ends), _struct(columns))

    def together(self, hit: np.ndarray, of: np.ndarray) -> Together:
        return Together(self, hit, of)


class Together:
    """Matching rows by the element found for them; elements follow each other, so a group's rows do too."""

    def __init__(self, pages: Pages, hit: np.ndarray, of: np.ndarray) -> None:
        self.pages, self.all = pages, np.flatnonzero(hit)
        leads = np.diff(of[self.all], prepend=-1) != 0
        self.group = np.cumsum(leads) - 1
        #: The first row of each group.
        self.lead = self.all[leads]

    def first(self, hit: np.ndarray) -> np.ndarray:
        """The first match of each group, -1 for none."""
        out = np.full(len(self.lead), -1)
        mine = hit[self.all]
        out[self.group[mine][::-1]] = self.all[mine][::-1]
        return out

    def every(self, hit: np.ndarray) -> pa.ListArray:
        """Where all matches of each group stand in their page's array."""
        mine = hit[self.all]
        ends = np.cumsum(np.bincount(self.group[mine], minlength=len(self.lead)))
        return pa.ListArray.from_arrays(_offsets(ends), pa.array(self.pages.at(self.all[mine]), pa.int32()))


def _offsets(ends: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], ends)), pa.int32())


def _struct(columns: dict) -> pa.StructArray:
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) if v.dtype == bool else pa.array(v, pa.int32(), mask=v < 0) for v in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def pages_of(ends: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Places end to end as a list of structs for each page, null below 0."""
    return pa.ListArray.from_arrays(_offsets(ends), _struct({"at": at}))


def _true(found: pa.Array) -> np.ndarray:
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


# What ``Nodes`` reads of a node; ``stand`` is what it shows in place of its text, ``mark`` a match that is already known.
NODE_COLUMNS = ("start", "end", "depth", "tag", "id", "classes", "style", "parent_tag", "stand", "mark")


class Nodes(Pages):
    """``Pages`` with the columns of their nodes; a test is worked out on a whole column at once and is false for null."""

    def __init__(self, **columns: pa.ListArray) -> None:
        start = columns["start"]
        offsets = start.offsets.to_numpy() - start.offsets[0].as_py()
        self.columns = {name: values.flatten() for name, values in columns.items()}
        places = [self.columns[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("start", "end", "depth")]
        super().__init__(np.diff(offsets), *places, np.zeros(len(places[0]), np.int64), [])

    def tag(self, *names: str) -> np.ndarray:
        return _true(pc.is_in(self.columns["tag"], value_set=pa.array(names)))

    def parent_tag(self, *names: str) -> np.ndarray:
        return _true(pc.is_in(self.columns["parent_tag"], value_set=pa.array(names)))

    def has_id(self, *names: str) -> np.ndarray:
        return _true(pc.is_in(self.columns["id"], value_set=pa.array(names)) if names else self.columns["id"].is_valid())

    def has_class(self, *names: str) -> np.ndarray:
        """Any of the class names."""
        lists = self.columns["classes"]
        node = np.repeat(self.row, np.diff(lists.offsets.to_numpy()))
        out = np.zeros(len(self.row), bool)
        out[node[_true(pc.is_in(lists.flatten(), value_set=pa.array(names)))]] = True
        return out

    def style_has(self, *parts: str) -> np.ndarray:
        """Style attribute contains every one of the parts."""
        return np.logical_and.reduce([_true(pc.match_substring(self.columns["style"], part)) for part in parts])

    def stands(self, *tags: str) -> np.ndarray:
        """Nodes of the tags that show something in place of their text."""
        return self.tag(*tags) & self.columns["stand"].is_valid().to_numpy(zero_copy_only=False)

    def mark(self) -> np.ndarray:
        return _true(self.columns["mark"])

    def hidden(self) -> np.ndarray:
        return self.style_has("display:none") | self.style_has("visibility:hidden") | (self.tag("span") & self.has_class("sortkey"))


def node_sweeps(sweep: Callable[[Nodes], dict], kind: str, names: tuple[str, ...], listed: bool = False) -> Callable[..., Column]:
    """A function of arrays of the node columns ``names``, a page a row, that gives what ``sweep`` finds for each node as
    ``array<struct<kind>>``; with ``listed``, the arrays of ``Pages.listed`` it answers with as one ``struct<kind>``.
    """
    @F.arrow_udf(f"struct<{kind}>" if listed else f"array<struct<{kind}>>")
    def run(*columns: pa.Array) -> pa.Array:
        nodes = Nodes(**dict(zip(names, columns)))
        found = sweep(nodes)
        return _struct(found) if listed else pa.ListArray.from_arrays(_offsets(np.cumsum(nodes.sizes)), _struct(found))

    return run


def sweeps(sweep: Callable[[Pages], dict[str, np.ndarray]], names: list[str], kind: str) -> Callable[..., Column]:
    """A function of arrays of starts, ends, depths and flags (bits in the order of ``names``), a page a row, that gives what
    ``sweep`` finds for each row of the page as ``array<struct<kind>>``.  Whole numbers below 0 become null.
    """
    @F.arrow_udf(f"array<struct<{kind}>>")
    def run(start: pa.Array, end: pa.Array, depth: pa.Array, bits: pa.Array) -> pa.Array:
        offsets = start.offsets.to_numpy() - start.offsets[0].as_py()
        pages = Pages(np.diff(offsets), *[a.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for a in (start, end, depth, bits)], names)
        found = sweep(pages)
        columns = [pa.array(v) if v.dtype == bool else pa.array(v, pa.int32(), mask=v < 0) for v in found.values()]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=list(found)))

    return run
