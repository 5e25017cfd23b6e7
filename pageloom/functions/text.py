"""Text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.schema import PRICED_NAME, SORT_CODE, TRAILING_COST


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# White space that trimming removes.
SPACES = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Trim Unicode white space, no-break spaces included."""
    return F.btrim(_col(c), F.lit(SPACES))


def collapse(c: Column | str) -> Column:
    """One space for every run of white space, none at the ends."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def non_empty(c: Column | str) -> Column:
    """Null for the empty string."""
    return F.nullif(_col(c), F.lit(""))


def strip_sort_code(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), SORT_CODE, "")


def clean_cell(c: Column | str) -> Column:
    """Collapsed text without its leading sort code."""
    return strip_sort_code(collapse(c))


def split_side(c: Column | str, sep: str, side: int) -> Column:
    """Side number ``side`` of the text around ``sep``; null if there is none.

    ``side`` counts from 0, or from the end when negative.
    """
    parts = F.split(_col(c), rf"\Q{sep}\E", -1)
    return strip(F.try_element_at(parts, F.lit(side + 1 if side >= 0 else side)))


def label_of(c: Column | str) -> Column:
    """Text before the first colon."""
    return strip(F.get(F.split(_col(c), ":", 2), F.lit(0)))


def value_of(c: Column | str) -> Column:
    """Text after the first colon, empty without one."""
    return F.coalesce(strip(F.get(F.split(_col(c), ":", 2), F.lit(1))), F.lit(""))


def after_label(full: Column | str, label: Column | str) -> Column:
    """``full`` without a leading ``label :``."""
    full, label = _col(full), _col(label)
    rest = F.substring(full, F.length(label) + 1, F.length(full))
    has = full.startswith(label) & rest.rlike(r"(?U)^\s*:")
    return strip(F.when(has, F.regexp_replace(rest, r"(?U)^\s*:\s*", "")).otherwise(full))


def slug(c: Column | str, loose: bool = False) -> Column:
    """Lower case with ``_`` for spaces; ``loose`` also maps ``-`` and drops apostrophes."""
    name = F.replace(F.lower(_col(c)), F.lit(" "), F.lit("_"))
    if not loose:
        return name
    return F.replace(F.regexp_replace(name, "['’]", ""), F.lit("-"), F.lit("_"))


def heading_key(c: Column | str) -> Column:
    """Heading without ``[edit]``, trimmed, lower case (exact but for folds like sharp s)."""
    return F.lower(strip(F.regexp_replace(_col(c), r"(?i)\[edit\]", "")))


def heading_title(c: Column | str) -> Column:
    """Heading without a literal ``[edit]``, trimmed."""
    return strip(F.replace(_col(c), F.lit("[edit]"), F.lit("")))


def with_seconds(label: Column | str, value: Column | str) -> Column:
    """A bare number under the label ``stock`` is a number of seconds."""
    value = _col(value)
    bare = (F.lower(strip(label)) == "stock") & value.rlike(r"^\d+(?:\.\d+)?$")
    return F.when(bare, F.concat(value, F.lit(" seconds"))).otherwise(value)


def strip_cost(c: Column | str) -> Column:
    """Drop a trailing cost such as `` (650)``."""
    return F.regexp_replace(_col(c), TRAILING_COST, "")


def priced_name(c: Column | str) -> Column:
    """Name before a bracketed price, null if the text has no price."""
    c = _col(c)
    return F.when(c.rlike(PRICED_NAME), F.regexp_extract(c, PRICED_NAME, 1))


def cost_label(c: Column | str) -> Column:
    """Common cost labels under one name; the first rule that fits wins."""
    c = _col(c)
    return (
        F.when(c.rlike("(?i)cooldown"), "Cooldown")
        .when(c.rlike("(?i)mana"), "Mana Cost")
        .when(c.rlike("(?i)health") & c.rlike("(?i)cost"), "Health Cost")
        .otherwise(c)
    )


def title_parts(c: Column | str) -> Column:
    """Array of titles: split on ``/`` untrimmed, or the one alias, or the title."""
    c = _col(c)
    return (
        F.when(c.contains("/"), F.split(c, "/"))
        .when(c.contains("Head-up display (HUD)"), F.array(F.lit("HUD")))
        .otherwise(F.array(c))
    )


def around(items: Column | str, item: Column | str) -> tuple[Column, Column]:
    """(before, after) the first ``item``; everything is before when it is absent."""
    items, item = _col(items), _col(item)
    at = F.when(F.coalesce(item, F.lit("")) != "", F.array_position(items, item)).otherwise(0)
    at = F.coalesce(at, F.lit(0)).cast("int")
    empty = F.array().cast("array<string>")
    before = F.when(at > 0, F.slice(items, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(items)
    after = F.when(at > 0, F.slice(items, at + 1, F.size(items))).otherwise(empty)
    return before, after


def dash(c: Column | str, empty: bool = True) -> Column:
    """``-`` for null, and for the empty string too unless ``empty`` is false."""
    c = _col(c)
    return F.coalesce(non_empty(c) if empty else c, F.lit("-"))


def first_filled(*cs: Column | str) -> Column:
    """First of the columns that is neither null nor empty, else empty."""
    return F.coalesce(*[non_empty(c) for c in cs], F.lit(""))
