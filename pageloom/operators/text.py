"""Text of elements, gathered once per page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import strip
from pageloom.operators.match import let
from pageloom.operators.select import COLUMNS, any_of, attr, before, is_hidden, so_far, tag

# A block boundary in the pieces of the ``lines`` form.
_MARK = "\u0001"


def _spaced_piece(run: Column, text: Column) -> Column:
    return let(strip(text), lambda t: F.when(t != "", t))


def _raw_piece(run: Column, text: Column) -> Column:
    return text


def _lines_piece(run: Column, text: Column) -> Column:
    shown = F.regexp_replace(text, r"(?U)\s+", " ")
    return (
        F.when(run["tag"] == "br", F.lit("\n"))
        .when(run["tag"].isin("td", "th"), F.lit(" "))
        .when(run["brk"], F.concat(F.lit(_MARK), shown))
        .otherwise(shown)
    )


def _as_lines(joined: Column) -> Column:
    """Shown text: a break per ``br`` and block boundary, lines trimmed."""
    text = F.regexp_replace(joined, rf"[ ]*\n?[ ]*({_MARK}[ ]*)+", "\n")
    text = F.regexp_replace(text, r"(?U)[^\S\n]*\n[^\S\n]*", "\n")
    return strip(F.regexp_replace(text, " +", " "))


# Form -> (piece of a run, separator, finish of the joined text).
FORMS = {
    "spaced": (_spaced_piece, " ", lambda c: c),
    "tight": (_spaced_piece, "", lambda c: c),
    "raw": (_raw_piece, "", lambda c: c),
    "lines": (_lines_piece, "", _as_lines),
}


def _by_position(runs: Column, piece, first: Column | None = None) -> Column:
    """Pieces placed at index start + 1, with nulls in the gaps; counted from ``first`` where it is given."""
    nothing = F.lit(None).cast("string")
    ahead = F.lit(-1) if first is None else first - 1

    def placed(run: Column, i: Column) -> Column:
        gap = run["at"] - F.coalesce(F.get(runs, i - 1)["at"], ahead) - 1
        return F.concat(F.array_repeat(nothing, gap), F.array(piece(run)))

    return F.flatten(F.transform(runs, placed))


def block_pieces(runs: Column, form: str, source: str, first: Column) -> Column:
    """Pieces of a block's text runs (``at``, tag, brk and the sources), of which ``block_text`` takes what lies below an element."""
    return _by_position(runs, lambda r: FORMS[form][0](r, r[source]), first)


def block_text(pieces: Column, form: str, el: Column, first: Column) -> Column:
    """Text below ``el``, worked out for the elements that are asked for only."""
    _, sep, finish = FORMS[form]
    return finish(F.array_join(F.slice(pieces, el["start"] - first + 2, el["end"] - el["start"]), sep))


def subtree_text(nodes: DataFrame, target: Column | Callable[[Column], Column], *fields: str, **texts: str) -> DataFrame:
    """Matching elements with the text below each of them.

    ``texts`` names the text columns and their forms: ``spaced`` (every run
    trimmed, joined by a space), ``tight`` (the same without the space),
    ``raw`` (runs joined as they are) or ``lines`` (as shown, with line
    breaks).  ``form:column`` reads the runs from another column than ``text``,
    and ``form:column@field`` takes the text below the element that the struct
    field (start, end) names instead of the target's own.
    Result: page_id, start, end, fields, texts.

    A page's runs go into one array that is indexed by ``start``, so the text
    of any element, nested or not, is one slice of it.  The array is never
    longer than the page, and a page is one input row.  ``nodes`` may be pages of ``html_pages``, with a ``target`` that takes
    a node; a page then stays one row up to its elements.
    """
    specs = {}
    for name, spec in texts.items():
        spec, _, of = spec.partition("@")
        form, _, source = spec.partition(":")
        specs[name] = (form, source or "text", of)
    arrays = list(dict.fromkeys((form, source) for form, source, _ in specs.values()))
    sources = list(dict.fromkeys(source for _, source in arrays))

    def is_run(e) -> Column:
        found = any_of(*[e[s].isNotNull() for s in sources])
        return found | F.coalesce(e["tag"].isin("br", "td", "th"), F.lit(False)) if any(form == "lines" for form, _ in arrays) else found

    struct = lambda e, *names: F.struct(*[e[n].alias(n) for n in names])
    run = lambda e: F.struct(e["start"].alias("at"), *[e[n].alias(n) for n in ("tag", "brk", *sources)])
    dense = [
        _by_position(
            F.col("_runs"), lambda r, form=form, source=source: FORMS[form][0](r, r[source])
        ).alias(f"_{form}_{source}")
        for form, source in arrays
    ]
    if "nodes" in nodes.columns:
        pages = nodes.select(
            "page_id", F.transform(F.filter("nodes", target), lambda e: struct(e, "start", "end", *fields)).alias("_targets"),
            F.transform(F.filter("nodes", is_run), run).alias("_runs"))
    else:
        # What a list collects is worked out ahead of the grouping: there it is compiled.
        pages = (
            nodes.where(target | is_run(COLUMNS))
            .select("page_id", F.when(target, struct(COLUMNS, "start", "end", *fields)).alias("_target"), F.when(is_run(COLUMNS), run(COLUMNS)).alias("_run"))
            .groupBy("page_id").agg(F.collect_list("_target").alias("_targets"), F.sort_array(F.collect_list("_run")).alias("_runs"))
        )
    pages = pages.select("page_id", "_targets", *dense)

    def with_texts(t: Column) -> Column:
        out = [t[name].alias(name) for name in ("start", "end", *fields)]
        for name, (form, source, of) in specs.items():
            _, sep, finish = FORMS[form]
            el = t[of] if of else t
            below = F.slice(f"_{form}_{source}", el["start"] + 2, el["end"] - el["start"])
            out.append(finish(F.array_join(below, sep)).alias(name))
        return F.struct(*out)

    return pages.select("page_id", F.inline(F.transform("_targets", with_texts)))


def with_clean(nodes: DataFrame, name: str = "clean", hidden: Column | None = None,
               abbr: Column | None = None, span: Column | None = None,
               img: bool = True, br: bool = True,
               title: Column | None = None, alt: Column | None = None) -> DataFrame:
    """Add a column with the text runs as a cell shows them.

    Runs in hidden elements are null.  ``br`` stands for a middle dot, ``img``
    for its alt text, ``abbr`` for its title where ``abbr`` holds, ``span`` for
    its title where ``span`` holds; what a replaced element contains is null,
    and the outermost replaced element wins.  No row goes away.  ``hidden``,
    ``title`` and ``alt`` stand in for the style and attributes of nodes that no
    longer carry them.
    """
    hidden = is_hidden() if hidden is None else hidden
    title = F.nullif(strip(attr("title") if title is None else title), F.lit(""))
    rules = [(tag("br"), F.lit(" · "), br), (tag("img"), attr("alt") if alt is None else alt, img)]
    rules += [(tag("abbr") & abbr, title, True)] if abbr is not None else []
    rules += [(tag("span") & span, title, True)] if span is not None else []
    stands_for = F.coalesce(
        *[F.when(cond, value) for cond, value, use in rules if use], F.lit(None).cast("string")
    )
    # A replaced element in a hidden one covers hidden rows only, so both are
    # running maxima of one window.
    nodes = nodes.withColumn("_for", stands_for).withColumns({
        "_gone": F.max(F.when(hidden, F.col("end"))).over(so_far()),
        "_in": F.max(F.when(F.col("_for").isNotNull(), F.col("end"))).over(before()),
    })
    out = F.coalesce(F.col("start") <= F.greatest("_gone", "_in"), F.lit(False))
    return nodes.withColumn(name, F.when(~out, F.coalesce("_for", "text"))).drop("_for", "_gone", "_in")
