"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import WORD, stored

#: Hex digits of the hash: three each for the histogram and its refinements.
DIGITS, LEVELS = 3, 4
WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``, one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn.  Shares that
    would pass ``most`` times a source's size stop there and the excess goes to
    the others by weight.  The water level of that process is read off the order in
    which sources fill up; the table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    levels = (
        ranked.withColumn("before", F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("whole", F.sum("source_size").over(all_rows))
        .withColumn("level", (F.col("whole") - F.col("before")).cast("double") / F.col("weights_left"))
        .withColumn("stops", F.col("cap").cast("double") <= F.col("level") * F.col("weight"))
    )
    # The level of the first source that does not fill up holds for all after it.
    final = F.min(F.when(~F.col("stops"), F.col("before"))).over(all_rows)
    left = F.max(F.when(~F.col("stops"), F.col("weights_left"))).over(all_rows)
    level = (F.col("whole") - final).cast("double") / left
    return levels.select(
        "source", "source_size",
        F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(level * F.col("weight")).alias("target"),
    )


def mixed_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
                 weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often each document goes into the mix: one row a document.

    Returns the id, the source, the columns named in ``carry``, ``size``, ``source_size``,
    ``target`` and ``copies``.  ``copies`` is the whole number of times that the source fits
    its target, plus one for documents whose hash lies at or below the source's
    threshold.  Words are summed by source and hash bucket, the bucket in which
    the rest of the budget runs out is refined ``LEVELS`` - 1 times, and the
    threshold is the hash nearest to the budget: nothing is sorted.  The hash
    is of the id, so reruns agree; rows of one id (a null id counts as empty text)
    are taken together.  A null or empty text has size 0; a null source is a
    source of its own.  A source of size 0 has target 0 and no copies.  No rows
    in, no rows out.  Other columns are ignored.
    """
    digest = F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))
    others = [c for c in carry if c not in (id, source)]
    every = docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
        F.substring(digest, 1, DIGITS * LEVELS).alias("hash"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(others)],
    )
    sized = stored(every.select("doc_id", "source", "size", "hash"), "sized")
    by_source = stored(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
        .withColumn("whole_copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("whole_copies") * F.col("source_size")), "targets")

    # Each level leaves, per source, the bucket in which the budget ends and the words before it.
    # The budget is below the source's size, so there is one; sources without words drop out.
    edge = by_source.select("source", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("taken"), "budget")
    for digits in range(DIGITS, DIGITS * LEVELS + 1, DIGITS):
        words = (
            sized.join(_named(edge, "prefix"), F.col("source").eqNullSafe(F.col("s")) & F.col("hash").startswith(F.col("prefix")))
            .groupBy("source", F.substring("hash", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
        )
        run = Window.partitionBy("source").orderBy("bucket")
        reached = (
            words.join(_named(edge, "prefix", "taken", "budget"), F.col("source").eqNullSafe(F.col("s")))
            .withColumn("upto", F.col("taken") + F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
        )
        if digits < DIGITS * LEVELS:
            over = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", "before")))
            edge = stored(
                reached.groupBy("source").agg(over.alias("over"), F.first("budget").alias("budget")).where("over IS NOT NULL")
                .select("source", F.col("over.bucket").alias("prefix"), F.col("over.before").alias("taken"), "budget"), "edge")
    # The last hash that is nearer to the budget when taken; without one, all hashes before the prefix.
    half = F.max(F.when(F.col("before") + F.col("words") / 2 <= F.col("budget"), F.col("bucket")))
    limits = reached.groupBy("source").agg(F.coalesce(half, F.first("prefix")).alias("bound"))
    limits = by_source.join(_named(limits, "bound"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    limits = stored(limits, "limits")
    extra = F.coalesce((F.col("hash") <= F.col("bound")).cast("long"), F.lit(0))
    # What is carried stays where it lies: a row's copies follow from its own hash and its source's limits.
    return (
        (every if others else sized).join(_named(limits, "bound", "whole_copies", "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("doc_id").alias(id), F.col("source").alias(source), *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)],
                "size", "source_size", "target",
                F.when(F.col("source_size") > 0, F.col("whole_copies") + extra).otherwise(0).cast("long").alias("copies"))
    )


def _named(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(F.col("source").alias("s"), *columns)
