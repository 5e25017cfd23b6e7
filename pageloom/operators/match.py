"""Lookups, pairings and keyed first/last rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.schema import ENTITY_NAMES


def lookup(requests: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Exact-key lookup; unknown keys give nulls.

    No broadcast hint: the record side grows, so Spark broadcasts it only while
    its measured size is under the threshold, and splits skewed keys otherwise.
    """
    return requests.join(records, key, "left")


def in_domain(name: Column | str, groups: dict[str, tuple[str, ...]] = ENTITY_NAMES) -> Column:
    """Group of a known entity name, null for an unknown one (a fixed, small list)."""
    name = F.col(name) if isinstance(name, str) else name
    group = F.lit(None).cast("string")
    for label, names in groups.items():
        group = F.when(name.isin(*names), label).otherwise(group)
    return group


def merging(side: DataFrame) -> DataFrame:
    """The side of a join that is never sent to the driver.  Behind a parse Spark takes rows to be as small as the table the pages come from,
    and would broadcast millions of them.
    """
    return side.hint("merge")


def number_rows(rows: DataFrame, by: list[str], order: str = "start", name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def zip_rows(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Pair rows of two lists by position, cut to the shorter unless ``how`` says else.

    Both sides carry ``start``; the right one loses it.
    """
    a = number_rows(left, by)
    b = number_rows(right, by).drop("start")
    return a.join(merging(b), [*by, "rn"], how)


def prefix_semi(headings: DataFrame, names: DataFrame) -> DataFrame:
    """Headings of a page that start with any of the page's names, case ignored.

    ``names(page_id, names array)`` has one row per page.
    """
    starts = F.exists("names", lambda n: F.lower("text").startswith(F.lower(n)))
    return headings.join(merging(names), "page_id").where(starts).drop("names")


def _pick(df: DataFrame, key: list[str], order: Column | str, last: bool) -> DataFrame:
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_row"))
        .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def first_per(df: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    """First row of each key by ``order``; an aggregate, so hot keys combine map-side."""
    return _pick(df, key, order, last=False)


def last_per(df: DataFrame, key: list[str], order: Column | str) -> DataFrame:
    """Last row of each key by ``order``."""
    return _pick(df, key, order, last=True)


def ordered_list(value: Column | str, order: Column | str = "start") -> Column:
    """Aggregate: non-null values as an array in the given order."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])


def distinct_ordered(value: Column | str, order: Column | str = "start") -> Column:
    """Aggregate: distinct values in order of first appearance."""
    return F.array_distinct(ordered_list(value, order))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row, also where ``use`` reads it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def last_of_keys(pairs: Column, key: str, value: str) -> Column:
    """Map of an array of structs in which the last value of a key stays, keys in order of appearance; null when empty."""
    def build(rows: Column) -> Column:
        last = lambda k: F.element_at(F.filter(rows, lambda e: e[key] == k), -1)[value]
        return let(F.array_distinct(F.transform(rows, lambda e: e[key])), lambda keys: F.when(
            F.size(keys) > 0, F.map_from_arrays(keys, F.transform(keys, last))))
    return let(pairs, build)


def last_map(key: Column, value: Column, order: Column | str = "start") -> Column:
    """Aggregate: map from each key to its last value; null for no entries.

    Keys keep the place of their first appearance.  For the bounded lists of one
    page only.
    """
    entries = ordered_list(F.when(key.isNotNull(), F.struct(key.alias("k"), value.alias("v"))), order)
    return last_of_keys(entries, "k", "v")


def empty_columns(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Add ``has_<name>``: whether the column has any non-empty value in its list."""
    w = Window.partitionBy(*by)
    for name in names:
        rows = rows.withColumn(f"has_{name}", F.max(F.col(name) != "").over(w))
    return rows


def frontier(**catalogs: DataFrame) -> DataFrame:
    """Named work lists as one, tagged with their category."""
    tagged = [df.withColumn("category", F.lit(name)) for name, df in catalogs.items()]
    return reduce(DataFrame.unionByName, tagged)


def pending(catalog: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Entries whose output does not exist yet."""
    return catalog.join(done.select(key), key, "left_anti")
