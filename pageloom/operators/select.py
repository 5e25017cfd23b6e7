"""Choosing and removing nodes of a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pageloom.functions.intervals import NODE_COLUMNS, node_sweeps, sweeps
from pageloom.functions.text import non_empty, strip
from pageloom.operators.match import let
from pageloom.schema import (
    AD_CLASSES, AD_IDS, BOILERPLATE_CLASSES, BOILERPLATE_IDS, CONTENT_CLASS, NAVIGATION_CLASS, NODE_SCHEMA,
)


def page_order() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("start")


def so_far() -> WindowSpec:
    """The page's rows up to this one."""
    return page_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    """The page's rows ahead of this one."""
    return page_order().rowsBetween(Window.unboundedPreceding, -1)


def behind() -> WindowSpec:
    """The page's rows after this one, nearest last.

    A frame that ends at the last row is quadratic in Spark when its lower bound
    moves, so looking ahead reads the page backwards instead.
    """
    return Window.partitionBy("page_id").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)



# ---- Predicates over a node row; never null ---------------------------------

def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def tag(*names: str) -> Column:
    return _sure(F.col("tag").isin(*names))


def has_class(*names: str) -> Column:
    """Any of the class names."""
    return any_of(*[_sure(F.array_contains("classes", n)) for n in names])


def has_id(*names: str) -> Column:
    return _sure(F.col("id").isin(*names))


def attr(name: str) -> Column:
    return F.col("attrs").getItem(name)


def has_attr(name: str) -> Column:
    return attr(name).isNotNull()


def attr_is(name: str, *values: str) -> Column:
    return _sure(attr(name).isin(*values))


def style_has(*parts: str) -> Column:
    """Style attribute contains every one of the parts."""
    return reduce(lambda a, b: a & b, [_sure(F.col("style").contains(p)) for p in parts])


def href_starts(prefix: str) -> Column:
    return _sure(attr("href").startswith(prefix))


def class_attr_starts(prefix: str) -> Column:
    """The class attribute as written starts with ``prefix``."""
    return _sure(attr("class").startswith(prefix))


def any_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def content() -> Column:
    """The element that holds a page's content."""
    return has_class(CONTENT_CLASS)


def boilerplate() -> Column:
    return has_id(*BOILERPLATE_IDS) | has_class(*BOILERPLATE_CLASSES)


def is_hidden() -> Column:
    return any_of(
        style_has("display:none"), style_has("visibility:hidden"), tag("span") & has_class("sortkey")
    )


def next_match(pred: Column, value: Column | None = None) -> Column:
    """Value (the start, by default) of the next matching row after this one."""
    return F.last(F.when(pred, F.col("start") if value is None else value), ignorenulls=True).over(behind())


def contains_match(nodes: DataFrame, pred: Column, name: str) -> DataFrame:
    """Flag rows that hold a matching row below them: the next match starts inside."""
    return nodes.withColumn(name, _sure(next_match(pred) <= F.col("end")))


CORE = ("page_id", "start", "end", "depth", "parent", "tag", "text", "brk")


def narrow(nodes: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Nodes cut down to their place, text and the given columns.

    Windows copy whole rows, so a plan takes what it needs from the attributes
    and classes once, up front, and leaves the rest behind.
    """
    return nodes.select(*CORE, *keep, *[c.alias(n) for n, c in columns.items()])


def swept(nodes: DataFrame, sweep, kind: str, *fields: str, **flags: Column) -> DataFrame:
    """Nodes with the columns ``kind`` that ``sweep`` finds: page_id, start, end, fields, found columns.

    ``sweep`` takes ``intervals.Pages``, which holds the places and ``flags`` of whole pages, and answers with an array for each
    column.  A page's rows go into one array, so a chain of steps that build on each other costs one grouping, where windows
    would copy all rows once a step.  Only places, depths and flags go to Python.
    """
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << i)).otherwise(0).cast("long") for i, f in enumerate(flags.values())])
    # What a list collects is worked out ahead of the grouping: there it is compiled.
    row = F.struct("start", "end", "depth", *fields, bits.alias("_bits"))
    rows = nodes.select("page_id", row.alias("_row")).groupBy("page_id").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    found = sweeps(sweep, list(flags), kind)("_rows.start", "_rows.end", "_rows.depth", "_rows._bits")
    return (
        rows.withColumn("_found", found).select("page_id", F.inline(F.arrays_zip("_rows", "_found")))
        .select("page_id", *[f"_rows.{n}" for n in ("start", "end", *fields)], "_found.*")
    )


class _Columns:
    """The fields of a node where nodes are rows."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


COLUMNS = _Columns()


def page_rows(nodes: DataFrame, row) -> DataFrame:
    """The rows of every page in one array: page_id, _rows.

    ``row`` makes a struct, ``start`` first, of a node's fields.  ``nodes`` are rows, or pages of ``html_pages``, whose arrays
    are already there and need neither a grouping nor an exchange.
    """
    if "nodes" in nodes.columns:
        return nodes.select("page_id", F.transform("nodes", row).alias("_rows"))
    rows = nodes.select("page_id", row(COLUMNS).alias("_row"))
    return rows.groupBy("page_id").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))


def flag_bits(**flags: Column) -> Column:
    """Flags as one number, which ``swept_blocks`` takes apart again."""
    return reduce(lambda a, b: a + b, [F.when(f, F.lit(1 << i)).otherwise(0).cast("long") for i, f in enumerate(flags.values())])


def swept_blocks(pages: DataFrame, names: list[str], sweep, kind: str, use) -> DataFrame:
    """One row for each block that ``sweep`` finds in the pages of ``page_rows``: page_id and the fields of ``use``.

    Rows carry start, end, depth and ``_bits``, the flags of ``names``.  ``sweep`` gives the columns ``kind`` and ``_size``,
    the number of rows of the block that starts at a row.  ``use`` makes a struct of a block's own row and its rows, each a
    struct of ``r`` (the row) and ``f`` (what was found).  A block takes its slice of the page, so the work is that of the page.
    """
    found = sweeps(sweep, names, kind)("_rows.start", "_rows.end", "_rows.depth", "_rows._bits")
    both = pages.withColumn("_found", found).select("page_id", F.arrays_zip(F.col("_rows").alias("r"), F.col("_found").alias("f")).alias("_both"))
    at = F.filter(F.transform("_both", lambda x, i: F.when(x["f"]["_size"].isNotNull(), F.struct(
        (i + 1).alias("i"), x["f"]["_size"].alias("n"), x.alias("own")))), lambda b: b.isNotNull())
    return both.select("page_id", F.inline(F.transform(at, lambda b: use(b["own"], F.slice("_both", b["i"], b["n"])))))


def page_arrays(nodes: DataFrame) -> DataFrame:
    """Pages as ``html_pages`` gives them: page_id, nodes; node rows are grouped once."""
    if "nodes" in nodes.columns:
        return nodes
    rows = nodes.groupBy("page_id").agg(F.collect_list(F.struct(*NODE_SCHEMA.names[1:])).alias("nodes"))
    return rows.select("page_id", F.array_sort("nodes", lambda a, b: a["start"] - b["start"]).alias("nodes"))


def swept_pages(pages: DataFrame, **sweeps_: tuple) -> DataFrame:
    """Pages with a column for each sweep of (flags of a node, sweep, kind), what it finds for each node; all go to Python at once."""
    def found(flags, sweep, kind: str) -> Column:
        names: list[str] = []

        def bits(e: Column) -> Column:
            of = flags(e)
            names[:] = of
            # A run of text has neither attributes nor classes: its one flag is that it is text.
            return F.when(e["tag"] == "#text", F.lit(1 << names.index("text") if "text" in names else 0).cast("long")).otherwise(flag_bits(**of))

        packed = F.transform("nodes", bits)
        return sweeps(sweep, names, kind)("nodes.start", "nodes.end", "nodes.depth", packed)

    return pages.select("page_id", "nodes", *[found(*of).alias(name) for name, of in sweeps_.items()])


def blocks_of(found: str, row, use) -> Column:
    """The blocks that a sweep of ``swept_pages`` found in a page, as an array of what ``use`` makes of a block's own row and its
    rows (as ``swept_blocks`` calls it).  ``row`` gives the columns of a node and reads those of blocks only.
    """
    at = F.filter(F.transform(found, lambda f, i: F.when(f["_size"].isNotNull(), F.struct(
        (i + 1).alias("i"), f["_size"].alias("n")))), lambda b: b.isNotNull())
    rows = lambda b: F.zip_with(
        F.slice("nodes", b["i"], b["n"]), F.slice(found, b["i"], b["n"]), lambda e, f: F.struct(F.struct(*row(e)).alias("r"), f.alias("f")))
    return F.transform(at, lambda b: let(rows(b), lambda rows: F.struct(
        b["i"].alias("at"), b["n"].alias("size"), use(F.get(rows, F.lit(0)), rows).alias("block"))))


def marked_pages(nodes: DataFrame, mark: Column | None) -> DataFrame:
    """``page_arrays`` with the array ``_mark``, whether each node matches ``mark``; without it where there is no such predicate."""
    if mark is None:
        return page_arrays(nodes).select("page_id", "nodes")
    rows = nodes.select("page_id", F.inline("nodes")) if "nodes" in nodes.columns else nodes
    fields = [n for n in NODE_SCHEMA.names[1:] if n in rows.columns]
    rows = rows.select("page_id", F.struct(*fields, _sure(mark).alias("_mark")).alias("_row")).groupBy("page_id").agg(F.collect_list("_row").alias("nodes"))
    return rows.select("page_id", F.array_sort("nodes", lambda a, b: a["start"] - b["start"]).alias("nodes")).withColumn("_mark", F.col("nodes._mark"))


def found_in(pages: DataFrame, sweep, kind: str, listed: bool = False) -> Column:
    """What ``sweep`` finds in the nodes of ``marked_pages`` (``intervals.node_sweeps``).  Tests of nodes are worked out on whole
    columns in Python; several such columns of a select go there together.
    """
    def stand(e: Column) -> Column:
        attr = lambda name: e["attrs"].getItem(name)
        return F.when(e["tag"] == "img", attr("alt")).when(e["tag"].isin("span", "abbr"), non_empty(strip(attr("title"))))

    columns = {n: F.col(f"nodes.{n}") for n in NODE_COLUMNS if n not in ("stand", "mark")} | {"stand": F.transform("nodes", stand)}
    if "_mark" in pages.columns:
        columns["mark"] = F.col("_mark")
    return node_sweeps(sweep, kind, tuple(columns), listed)(*columns.values())


# ---- Intervals as running windows -------------------------------------------

def _covering(pred: Column, fields: tuple[str, ...]) -> Column:
    """Outermost matching interval around the row, if its end reaches the row.

    Intervals nest or are apart, so of all matches so far the one with the
    largest end (the earliest start among equals) is the outermost around the
    row.  A running maximum finds it in one pass.
    """
    found = F.struct("end", (-F.col("start")).alias("_from"), *fields)
    return F.max(F.when(_sure(pred), found)).over(so_far())


def _interval(name: str, fields: tuple[str, ...], valid: Column) -> Column:
    found = F.struct(
        (-F.col(f"{name}._from")).alias("start"), F.col(f"{name}.end").alias("end"),
        *[F.col(f"{name}.{f}").alias(f) for f in fields],
    )
    return F.when(valid, found)


def inside_all(nodes: DataFrame, **matches: Column | tuple) -> DataFrame:
    """Add an interval column for each of several independent matches.

    A match is a predicate, or a tuple of it and the fields to carry.  Each
    column holds struct(start, end, fields) of the outermost matching element
    around the row (the row itself included), or null.  All share one window in
    page order; there is no interval join.
    """
    specs = {n: m if isinstance(m, tuple) else (m,) for n, m in matches.items()}
    nodes = nodes.withColumns({n: _covering(m[0], m[1:]) for n, m in specs.items()})
    return nodes.withColumns({
        n: _interval(n, m[1:], F.col("start") <= F.col(f"{n}.end")) for n, m in specs.items()
    })


def inside(nodes: DataFrame, pred: Column, name: str, *fields: str, within: Column | None = None) -> DataFrame:
    """Add one interval column, as ``inside_all`` does.

    ``within`` asks for an enclosing interval column, so the match is the
    outermost one in there.
    """
    pred = _sure(pred)
    return inside_all(nodes, **{name: (pred if within is None else pred & within.isNotNull(), *fields)})


def first_inside(nodes: DataFrame, pred: Column, name: str, within: str, *fields: str) -> DataFrame:
    """Add ``name``: the first matching element of each ``within`` block, on the rows inside it.

    Blocks follow each other, so the match with the latest block and the
    earliest start is the running maximum as well.
    """
    found = F.struct(
        F.col(f"{within}.start").alias("_of"), (-F.col("start")).alias("_from"), "end", *fields)
    hit = F.when(_sure(pred) & F.col(within).isNotNull(), found)
    nodes = nodes.withColumn(name, F.max(hit).over(so_far()))
    mine = (F.col(f"{name}._of") == F.col(f"{within}.start")) & (F.col("start") <= F.col(f"{name}.end"))
    return nodes.withColumn(name, _interval(name, fields, mine))


def first_of_page(nodes: DataFrame, **preds: Column) -> DataFrame:
    """Add interval columns of the first matching element of the page, on the rows inside it."""
    nodes = nodes.withColumns({
        n: F.first(F.when(_sure(p), F.struct("start", "end")), ignorenulls=True).over(so_far()) for n, p in preds.items()
    })
    return nodes.withColumns({n: F.when(F.col("start") <= F.col(f"{n}.end"), F.col(n)) for n in preds})


def scope(nodes: DataFrame, pred: Column | None = None, keep_root: bool = False,
          keep_document: bool = False) -> DataFrame:
    """Nodes inside the first matching element of each page.

    ``keep_document`` keeps the document row too, so pages without the element
    stay in the result.
    """
    pred = content() if pred is None else pred
    root = F.first(F.when(pred, F.struct("start", "end")), ignorenulls=True).over(so_far())
    low = F.col("start") >= F.col("_root.start") if keep_root else F.col("start") > F.col("_root.start")
    keep = low & (F.col("start") <= F.col("_root.end"))
    if keep_document:
        keep = _sure(keep) | tag("#document")
    return nodes.withColumn("_root", root).where(keep).drop("_root")


def drop_subtrees(nodes: DataFrame, pred: Column, unless_contains: Column | None = None,
                  unless: Column | None = None) -> DataFrame:
    """Drop every matching element with all it contains.

    ``unless`` spares matching elements themselves, ``unless_contains`` those
    that hold an element matching it.
    """
    if unless is not None:
        pred = pred & ~unless
    if unless_contains is not None:
        nodes = contains_match(nodes, unless_contains, "_spare")
        pred = pred & ~F.col("_spare")
    reach = F.max(F.when(pred, F.col("end"))).over(so_far())
    out = nodes.withColumn("_reach", reach).where(
        F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))
    )
    return out.drop("_reach", "_spare")


def drop_boilerplate(nodes: DataFrame, keep_tabs: bool = False) -> DataFrame:
    """Drop tables of contents, navigation boxes, ad slots and edit links.

    With ``keep_tabs`` a navigation block that is, or holds, a tab block stays.
    """
    if not keep_tabs:
        return drop_subtrees(nodes, boilerplate() | has_class(NAVIGATION_CLASS))
    tab_parts = has_class("tabs-content", "show-all") | (has_class("nav") & has_class("nav-tabs"))
    return drop_subtrees(
        drop_subtrees(nodes, boilerplate()),
        has_class(NAVIGATION_CLASS),
        unless=has_class("tabs-dynamic"),
        unless_contains=tab_parts,
    )


def drop_hidden(nodes: DataFrame) -> DataFrame:
    return drop_subtrees(nodes, is_hidden())


def _ad_kinds(classes: tuple[str, ...], ids: tuple[str, ...]) -> Column:
    kinds = [F.when(tag("iframe"), F.lit("iframe"))]
    kinds += [F.when(has_class(c), F.lit(f"class {c}")) for c in classes]
    kinds += [F.when(has_id(i), F.lit(f"id {i}")) for i in ids]
    return F.array_compact(F.array(*kinds))


def ad_counts(nodes: DataFrame, classes: tuple[str, ...] = AD_CLASSES,
              ids: tuple[str, ...] = AD_IDS) -> DataFrame:
    """Number of ad elements of each kind on each page."""
    return (
        nodes.select("page_id", F.explode(_ad_kinds(classes, ids)).alias("kind"))
        .groupBy("page_id", "kind").agg(F.count("*").alias("n"))
    )


def drop_ads(nodes: DataFrame, classes: tuple[str, ...] = AD_CLASSES,
             ids: tuple[str, ...] = AD_IDS) -> DataFrame:
    return drop_subtrees(nodes, tag("iframe") | has_class(*classes) | has_id(*ids))


def first_in(nodes: DataFrame, pred: Column, by: list[str], *fields: str) -> DataFrame:
    """First matching row in document order of each group, one row per group."""
    return (
        nodes.where(pred).groupBy(*by)
        .agg(F.min_by(F.struct("start", *fields), "start").alias("_first"))
        .select(*by, "_first.*")
    )


def innermost(nodes: DataFrame, pred: Column) -> DataFrame:
    """Matching elements that contain no other match."""
    ahead = F.lead("start").over(page_order())
    return (
        nodes.where(pred).withColumn("_ahead", ahead)
        .where(F.col("_ahead").isNull() | (F.col("_ahead") > F.col("end"))).drop("_ahead")
    )


def outermost(nodes: DataFrame, pred: Column) -> DataFrame:
    """Matching elements that lie in no other match."""
    reach = F.max("end").over(before())
    return (
        nodes.where(pred).withColumn("_reach", reach)
        .where(F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).drop("_reach")
    )


def with_open(nodes: DataFrame, **preds: Column) -> DataFrame:
    """Add how many matching elements are open around each row, itself apart, for each predicate.

    A sweep over the page: a match opens at its row and closes behind the last row of its interval, so the count is
    one running sum over rows and closings, whatever the depth of the page.
    """
    preds = {n: _sure(p).cast("int") for n, p in preds.items()}
    marked = nodes.withColumns({f"_is_{n}": p for n, p in preds.items()})
    any_match = reduce(lambda a, b: a | b, [F.col(f"_is_{n}") > 0 for n in preds])
    step = F.when(any_match, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    events = marked.withColumn("_closes", F.explode(step)).withColumn(
        "_at", F.when(F.col("_closes") == 1, F.col("end")).otherwise(F.col("start")))
    so_far_ = Window.partitionBy("page_id").orderBy("_at", "_closes").rowsBetween(Window.unboundedPreceding, -1)
    change = lambda n: F.when(F.col("_closes") == 1, -F.col(f"_is_{n}")).otherwise(F.col(f"_is_{n}"))
    return (
        events.withColumns({n: F.coalesce(F.sum(change(n)).over(so_far_), F.lit(0)).cast("int") for n in preds})
        .where("_closes = 0").drop("_closes", "_at", *[f"_is_{n}" for n in preds])
    )


def nearest(nodes: DataFrame, pred: Column, name: str, *fields: str) -> DataFrame:
    """Add ``name``: struct(start, end, fields) of the innermost matching element around each row, itself apart, or null.

    Of the matches that as many others are open around, the last one before a row is the one that is open there.
    """
    own = F.when(_sure(pred), F.struct("start", "end", *fields))
    opened = with_open(nodes.withColumn("_own", own), _level=pred)
    # A match stands at its own level for others and asks one level up for itself.
    both = opened.withColumn("_asks", F.explode(F.when(_sure(pred), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))))
    both = both.withColumn("_at_level", F.col("_level") - F.col("_asks").cast("int"))
    level = Window.partitionBy("page_id", "_at_level").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(~F.col("_asks"), F.col("_own")), ignorenulls=True).over(level)
    return both.withColumn(name, F.when(F.col("_level") > 0, around)).where("_asks").drop("_own", "_level", "_asks", "_at_level")


def within(nodes: DataFrame, outer: Column, inner: Column, *fields: str) -> DataFrame:
    """One row per (matching ancestor, matching node), nested ancestors included.

    Adds ``anc`` = struct(start, end, fields) of the ancestor.  A node asks at every level of open ancestors; the last
    match before it at that level is the one around it.  The work is that of the result, however deep the page.
    """
    opened = with_open(nodes.where(outer | inner).withColumn("_own", F.when(_sure(outer), F.struct("start", "end", *fields))), _level=outer)
    # A node asks at the levels 0 to _level - 1; a match stands at its own, _level.
    asks = F.when(_sure(inner) & (F.col("_level") > 0), F.sequence(F.lit(0), F.col("_level") - 1)).otherwise(F.array().cast("array<int>"))
    stands = F.when(F.col("_own").isNotNull(), F.array(F.struct(F.col("_level").alias("level"), F.lit(False).alias("asks")))).otherwise(
        F.array().cast("array<struct<level:int,asks:boolean>>"))
    both = opened.withColumn("_role", F.explode(F.concat(stands, F.transform(asks, lambda k: F.struct(k.alias("level"), F.lit(True).alias("asks"))))))
    level = Window.partitionBy("page_id", "_role.level").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(~F.col("_role.asks"), F.col("_own")), ignorenulls=True).over(level)
    return both.withColumn("anc", around).where("_role.asks").drop("_own", "_level", "_role")


def ancestors(nodes: DataFrame, asks: Column, **steps: int) -> DataFrame:
    """The elements so many steps above matching elements: page_id, start, and a struct(start, end) for each of ``steps``.

    The element that is open at a row in a given depth is the last one of that depth before it.  Null where the
    document ends, or where the ancestor is not among the rows.
    """
    kinds = "struct<step:string,depth:int>"
    own = F.array(F.struct(F.lit(None).cast("string").alias("step"), F.col("depth").alias("depth")).cast(kinds))
    up = F.array(*[F.struct(F.lit(n).alias("step"), (F.col("depth") - k).alias("depth")).cast(kinds) for n, k in steps.items()])
    both = (
        nodes.where(~tag("#text"))
        .select("page_id", "start", "end", F.explode(F.when(_sure(asks), F.concat(own, up)).otherwise(own)).alias("_role"))
    )
    level = Window.partitionBy("page_id", "_role.depth").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(F.col("_role.step").isNull(), F.struct("start", "end")), ignorenulls=True).over(level)
    found = both.withColumn("_up", around).where(F.col("_role.step").isNotNull())
    return found.groupBy("page_id", "start").agg(*[F.max(F.when(F.col("_role.step") == n, F.col("_up"))).alias(n) for n in steps])
