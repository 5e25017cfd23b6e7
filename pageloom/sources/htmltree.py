"""HTML text to node rows: the one Python stage, run over Arrow batches."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate, chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.schema import NODE_SCHEMA

# A page as one row: the nodes of NODE_SCHEMA without their page.
PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("nodes", T.ArrayType(T.StructType(NODE_SCHEMA.fields[1:])))])

# The parser travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p "
    "pre section summary table tbody tfoot thead tr ul".split()
)
UNSHOWN = frozenset(("script", "style"))
# An opening tag closes open elements of the listed kinds, up to a boundary.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tbody": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "thead": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
    "tfoot": (frozenset(("tbody", "thead", "tfoot")), frozenset(("table",))),
}
PARAGRAPH = (frozenset(("p",)), frozenset(("table", "td", "th", "caption", "button", "object")))
CELL_SCOPE = frozenset(("table",))

ROWS_PER_BATCH = 8192
# Nothing of a page is left out beyond these: a table that holds a cell over such a span carries an ``error``, and
# ``table_cells`` bounds the cell.
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}
NONE: tuple = ()
# Plain markup: a run of text, a closing tag, or an opening tag whose attributes are quoted and free of references.
PLAIN = re.compile(r'([^<]+)(?=<)|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?: +[a-z][a-z0-9-]*="[^"&<>]*")*) ?/?>')
ATTRIBUTE = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
# What follows these is not read as markup, or not always.
RAW = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), *(
    "script style textarea title iframe noembed noframes noscript plaintext xmp svg math".split())))


class _Nodes(HTMLParser):
    """Collects the node columns of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Columns of NODE_SCHEMA; ``fill`` adds the rest.
        self.end, self.depth, self.parent, self.sib, self.tag, self.attrs, self.text, self.brk = [], [], [], [], [], [], [], []
        self._open: list[tuple[str, int]] = []
        # Open elements by tag; a tag that is not open is not held.
        self._opened: dict[str, int] = {}
        self._children = [0]
        self._break = False
        self._split = False
        self._add("#document", None, None)
        self._open.append(("#document", 0))

    def _add(self, tag, attrs, text) -> int:
        n = len(self.tag)
        self.end.append(n)
        self.depth.append(len(self._open) - 1)
        self.parent.append(self._open[-1][1] if self._open else None)
        self.tag.append(tag)
        self.text.append(text)
        if attrs is None:
            self.sib.append(None)
        else:
            self.sib.append(self._children[-1])
            self._children[-1] += 1
        self.attrs.append(attrs or NONE)
        self.brk.append(self._break if text is not None else None)
        return n

    def fill(self) -> None:
        """The columns that follow from others, once all nodes are there."""
        attrs = self.attrs
        self.start = range(len(attrs))
        self.id = [a.get("id") if a else None for a in attrs]
        self.classes = [a["class"].split() if a and "class" in a else NONE for a in attrs]
        self.style = [a.get("style") if a else None for a in attrs]
        self.parent_tag = [None if p is None else self.tag[p] for p in self.parent]
        self.attrs = [a.items() if a else NONE for a in attrs]

    def _pop_to(self, depth: int) -> None:
        last = len(self.tag) - 1
        while len(self._open) > depth:
            tag, at = self._open.pop()
            self._children.pop()
            if (more := self._opened.pop(tag, 1) - 1):
                self._opened[tag] = more
            self.end[at] = last
            self._break = self._break or tag in BLOCK

    def _close_open(self, kinds, boundary) -> None:
        if self._opened.keys().isdisjoint(kinds):
            return
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i][0]
            if tag in kinds:
                self._pop_to(i)
                return
            if tag in boundary:
                return

    def handle_starttag(self, tag, attrs) -> None:
        if tag in CLOSES:
            self._close_open(*CLOSES[tag])
        if tag in BLOCK:
            self._close_open(*PARAGRAPH)
            self._break = True
        if tag == "tr" and self._open[-1][0] == "table":
            self._enter("tbody", {})
        kept: dict[str, str] = {}
        for name, value in attrs:
            if name not in kept:
                kept[name] = value or ""
        if kept and tag in ("td", "th"):
            for name, most in MAX_SPAN.items():
                digits = kept.get(name, "").strip().lstrip("0")
                if digits.isascii() and digits.isdigit() and (len(digits) > 9 or int(digits) > most):
                    self._note_table(f"{name} is over {most}")
        self._enter(tag, kept)

    def _note(self, at: int, error: str) -> None:
        self.attrs[at] = {**{k: v for k, v in (self.attrs[at] or {}).items() if k != "error"}, "error": error}

    def _note_table(self, error: str) -> None:
        for tag, at in reversed(self._open):
            if tag == "table":
                self._note(at, error)
                return

    def _enter(self, tag, attrs) -> None:
        at = self._add(tag, attrs, None)
        if tag not in VOID:
            self._open.append((tag, at))
            self._opened[tag] = self._opened.get(tag, 0) + 1
            self._children.append(0)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag not in self._opened:
            return
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                self._pop_to(i)
                return
            if self._open[i][0] in CELL_SCOPE and tag not in CELL_SCOPE and tag not in ("html", "body"):
                return

    def handle_data(self, data) -> None:
        if self._open[-1][0] in UNSHOWN:
            return
        at = len(self.tag) - 1
        same_run = self.tag[at] == "#text" and self.parent[at] == self._open[-1][1]
        if same_run and not self._split:
            self.text[at] += data
            return
        self._split = False
        self._add("#text", None, data)
        if data.strip():
            self._break = False

    def handle_comment(self, data) -> None:
        self._split = True

    def feed(self, data) -> None:
        """Read plain markup by one pattern, and all from the first other place on by the general parser."""
        at, match = 0, PLAIN.match
        while found := match(data, at):
            text, closed, opened, attrs = found.groups()
            if text is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            elif closed is not None:
                self.handle_endtag(closed)
            elif opened in RAW:
                break
            else:
                self.handle_starttag(opened, ATTRIBUTE.findall(attrs) if attrs else NONE)
            at = found.end()
        super().feed(data[at:])

    def updatepos(self, i, j) -> int:
        return j  # line numbers are not wanted

    def finish(self) -> None:
        self.close()
        self._pop_to(0)
        self.fill()


def _parse(html: str | None) -> _Nodes:
    tree = _Nodes()
    try:
        if html is None:
            raise ValueError("page has no html")
        tree.feed(html)
        tree.finish()
    except Exception as err:  # one bad page must not end the job
        tree = _Nodes()
        tree.attrs[0] = {"error": f"{type(err).__name__}: {err}"}
        tree.fill()
    return tree


FLAT = {
    "page_id": pa.int64(), "start": pa.int32(), "end": pa.int32(), "depth": pa.int32(), "parent": pa.int32(),
    "sib": pa.int32(), "tag": pa.string(), "id": pa.string(), "style": pa.string(), "text": pa.string(),
    "brk": pa.bool_(), "parent_tag": pa.string(),
}


def _offsets(sizes) -> pa.Array:
    return pa.array(list(accumulate(sizes, initial=0)), pa.int32())


def _columns(out: dict[str, list]) -> dict[str, pa.Array]:
    """Column lists as Arrow arrays; nested columns go over as flat values and offsets."""
    columns = {name: pa.array(out[name], kind) for name, kind in FLAT.items() if name in out}
    classes = pa.array(list(chain.from_iterable(out["classes"])), pa.string())
    columns["classes"] = pa.ListArray.from_arrays(_offsets(map(len, out["classes"])), classes)
    pairs = list(chain.from_iterable(out["attrs"]))
    columns["attrs"] = pa.MapArray.from_arrays(
        _offsets(map(len, out["attrs"])), pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())
    )
    return columns


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    columns = _columns(out)
    return pa.RecordBatch.from_arrays([columns[n] for n in NODE_SCHEMA.names], names=NODE_SCHEMA.names)


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = NODE_SCHEMA.names
    out: dict[str, list] = {name: [] for name in names}
    for batch in batches:
        ids, pages = batch.column("page_id"), batch.column("html")
        for i in range(batch.num_rows):
            tree = _parse(pages[i].as_py())
            out["page_id"].extend([ids[i].as_py()] * len(tree.start))
            for name in names[1:]:
                out[name].extend(getattr(tree, name))
            if len(out["start"]) >= ROWS_PER_BATCH:
                yield _batch(out)
                out = {name: [] for name in names}
    if out["start"]:
        yield _batch(out)


def _page_batch(ids: list[int], sizes: list[int], out: dict[str, list]) -> pa.RecordBatch:
    columns, names = _columns(out), NODE_SCHEMA.names[1:]
    nodes = pa.StructArray.from_arrays([columns[n] for n in names], names=names)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(_offsets(sizes), nodes)], names=PAGE_SCHEMA.names)


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = NODE_SCHEMA.names[1:]
    ids, sizes, out = [], [], {name: [] for name in names}
    for batch in batches:
        for page, versions in zip(batch.column("page_id").to_pylist(), batch.column("versions").to_pylist()):
            trees = [_parse(v["html"]) for v in versions]
            if len(trees) == 1:
                for name in names:
                    out[name].extend(getattr(trees[0], name))
            else:  # rows of one id are one page, as they are where nodes are grouped by page
                rows = sorted(chain.from_iterable(zip(*[getattr(t, name) for name in names]) for t in trees), key=lambda r: r[0])
                for name, values in zip(names, zip(*rows)):
                    out[name].extend(values)
            ids.append(page)
            sizes.append(sum(len(t.start) for t in trees))
            if len(out["start"]) >= ROWS_PER_BATCH:
                yield _page_batch(ids, sizes, out)
                ids, sizes, out = [], [], {name: [] for name in names}
    if ids:
        yield _page_batch(ids, sizes, out)


def html_pages(pages: DataFrame) -> DataFrame:
    """The nodes of ``pages(page_id, html)`` with a row for each page: page_id, nodes in the order of ``start``.

    What works on the whole rows of a page (``operators.select.page_rows``) needs no exchange of nodes; where ``pages`` lie
    hashed by ``page_id``, as ``read_table`` deals them, none at all.
    """
    versions = pages.groupBy("page_id").agg(F.collect_list(F.struct("html")).alias("versions"))
    return versions.mapInArrow(_page_batches, PAGE_SCHEMA)


def html_nodes(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Node rows of ``pages(page_id, html)``, partitioned by page.

    The one exchange sits behind the parse, so filters and column choices of
    later operators move below it, and every later window, grouping or join
    by page runs without another one.  A task sorts the nodes of all its pages, so ``partitions`` should follow their
    number.  A page is one input row, so a page's group is bounded by what one row can hold.
    """
    parsed = pages.select("page_id", "html").mapInArrow(_node_batches, NODE_SCHEMA)
    return parsed.repartition("page_id") if partitions is None else parsed.repartition(partitions, "page_id")
