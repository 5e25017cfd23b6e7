"""Connected components by DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import buckets, stored


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for the ends of ``(a, b)``: the smallest id that can be reached.

    Alternates large stars (larger neighbours move to a node's least neighbour) and small
    stars (smaller neighbours do) until nothing changes, which takes about the logarithm of
    the longest path.  A node with very many links is the smaller end of them: its least neighbour is a
    minimum that combines before the shuffle, and its links meet it in an equi-join whose skewed
    partitions Spark splits.  Only larger ends gather their links, which are few.  Self links and repeated links do not matter.
    """
    # Edges are a few bytes a document: they are written by fewer tasks than the shuffles before have.
    tasks = max(1, buckets(links.sparkSession) // 16)
    keep = lambda df: stored(df.distinct().coalesce(tasks), "edges")
    edges = keep(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = edges.join(least, "v").select("u", "m")
        small = large.withColumn("low", F.min("m").over(Window.partitionBy("u")))
        edges = keep(small.select(F.explode(F.array("u", "m")).alias("u"), F.col("low").alias("v")).where("u != v"))


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """``component`` after further links: only the graph of components that these join is worked on."""
    of = lambda side: component.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    more = components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
    moved = more.select(F.col("id").alias("component"), F.col("component").alias("to"))
    known = component.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return stored(known.unionByName(more.join(component.select("id"), "id", "left_anti").select("id", "component")), "components")
