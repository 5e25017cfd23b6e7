"""Merkle manifest of a dataset: levels of parent-linked nodes, and proofs by a recursive query."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.llm.common import buckets, stored

#: Children of a node.
FAN = 3
#: Levels that every leaf climbs alone; above them all leaves of a node share its way to the root.
ALONE = 4
#: Tree number of the nodes above the groups' own roots.
TOP = -1
_NODE = ("tree long, level int, pos long, up_tree long, up_level int, up_pos long, size long, digest binary, left binary, "
         "right binary, above binary")


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts one after another, as 32 bytes; binary parts count as lower-case hex text."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def counted(value: Column) -> Column:
    """A value with its byte count before it, so that neighbours cannot run into each other; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


@contextmanager
def unbounded_recursion(spark: SparkSession):
    """Recursive queries that run inside may return any number of rows."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def leaf_rows(docs: DataFrame, id: str, group: str, columns: tuple[str, ...], tampered: dict[str, Column]) -> DataFrame:
    """``(doc_id, key, leaf, tampered, row)``: digests of the columns, once as they are and once as ``tampered`` has them.

    ``key`` stands for the group, null as the empty string, so that it sorts first; ``row`` tells equal rows apart.
    """
    of = lambda change: digest(*[counted(change.get(c, F.col(c))) for c in columns])
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), key.alias("key"), of({}).alias("leaf"), of(tampered).alias("tampered"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves with the number of their group (``tree``), its ``size`` and their place in it (``pos``), both from 0.

    Rows are sorted by range over all tasks, so a hot group spreads; a task's rows are numbered alone and moved on
    by the counts of the tasks before, a row a task and group.
    """
    order = ["key", F.col("doc_id").asc_nulls_last(), "leaf", "row"]
    dealt = stored(
        leaves.repartitionByRange(buckets(leaves.sparkSession), *order).withColumn("part", F.spark_partition_id()), "dealt")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = stored(dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), "spans")
    firsts = spans.groupBy("key").agg(F.min("part").alias("first"), F.sum("n").alias("size"))
    # One row a task: its groups that no earlier task has begun.
    begun = firsts.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    skipped = begun.select("first", F.coalesce(F.sum("n").over(before(Window.orderBy("first"))), F.lit(0)).alias("trees"))
    trees = firsts.join(skipped, "first").select(
        "key", "size", (F.col("trees") + F.row_number().over(Window.partitionBy("first").orderBy("key")) - 1).alias("tree"))
    shifts = spans.join(trees, "key").select(
        "key", "part", "tree", "size", F.coalesce(F.sum("n").over(before(Window.partitionBy("key").orderBy("part"))), F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order)) - 1
    return stored(
        dealt.withColumn("local", local).join(shifts, ["key", "part"])
        .select("doc_id", "row", "tree", "size", (F.col("shift") + F.col("local")).alias("pos"), "leaf", "tampered"), "placed")


def built(bottom: DataFrame) -> list[DataFrame]:
    """Parent-linked nodes of each level below the roots, from ``(tree, pos, size, digest)`` at the lowest.

    Runs of ``FAN`` neighbours make a node of the next level until a tree has one.  A node holds its digest,
    that of its parent (``above``) and its siblings' to the ``left`` and ``right``; a parent that is a tree's root is named
    as the leaf that it is in the tree on top.  Every level is stored, a third of the one below.
    """
    now, level, made = bottom, 0, []
    most = bottom.agg(F.max("size")).first()[0] or 0
    while most > 1:
        run = (F.col("pos") / FAN).cast("long")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        grown = F.ceil(F.col("size") / FAN)
        runs = now.where("size > 1").groupBy("tree", run.alias("up"), "size").agg(kids.alias("kids"))
        joined = lambda a: text_of(reduce(F.concat, [F.coalesce(F.get(a, F.lit(i)), F.unhex(F.lit(""))) for i in range(FAN)]))
        rows = (
            runs.withColumn("above", digest(joined(F.col("kids"))))
            .select("tree", "up", "size", "above", "kids", F.posexplode("kids").alias("i", "digest"))
        )
        last = (grown == 1) & (F.col("tree") != TOP)
        some = lambda keep: F.array_join(F.transform(F.filter("kids", lambda _, j: keep(j)), F.hex), "")
        rows = rows.select(
            "tree", F.lit(level).alias("level"), (F.col("up") * FAN + F.col("i")).alias("pos"),
            F.when(last, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("up_tree"), F.when(last, 0).otherwise(level + 1).alias("up_level"),
            F.when(last, F.col("tree")).otherwise(F.col("up")).alias("up_pos"), "size", "digest",
            F.unhex(some(lambda j: j < F.col("i"))).alias("left"), F.unhex(some(lambda j: j > F.col("i"))).alias("right"), "above")
        nodes = stored(rows, "nodes")
        made.append(nodes)
        now = nodes.where(F.col("pos") % FAN == 0).select(
            "tree", (F.col("pos") / FAN).cast("long").alias("pos"), F.ceil(F.col("size") / FAN).alias("size"), F.col("above").alias("digest"))
        most, level = -(-most // FAN), level + 1
    return made


def together(spark: SparkSession, levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], _NODE)


def climbed(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each leaf ``ALONE`` levels up or at its tree's root: ``(row, up_tree, up_level, up_pos, hash, siblings)``.

    A recursive query: every step finds the node that a leaf has come to, appends its siblings and folds the hash.
    """
    spark = leaves.sparkSession
    start = leaves.select(
        "row", *[F.when(F.col("size") > 1, own).otherwise(F.lit(top)).alias(c) for c, own, top in (
            ("tree", F.col("tree"), TOP), ("level", F.lit(0), 0))], F.when(F.col("size") > 1, F.col("pos")).otherwise(F.col("tree")).alias("pos"),
        F.col("tampered").alias("hash"))
    found = spark.sql(f"""
        WITH RECURSIVE climb(row, tree, level, pos, hash, siblings) MAX RECURSION LEVEL {ALONE + 1} AS (
            SELECT row, cast(tree AS long), level, cast(pos AS long), hash, unhex('') FROM {{start}}
            UNION ALL
            SELECT c.row, n.up_tree, n.up_level, n.up_pos,
                   unhex(sha2(lower(hex(concat(n.left, c.hash, n.right))), 256)), concat(c.siblings, n.left, n.right)
            FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.level = c.level AND n.pos = c.pos)
        SELECT row, tree AS up_tree, level AS up_level, pos AS up_pos, hash, siblings FROM climb WHERE tree = {TOP} OR level = {ALONE}
        """, start=start, nodes=nodes.select("tree", "level", "pos", "up_tree", "up_level", "up_pos", "left", "right"))
    with unbounded_recursion(spark):
        return stored(found, "climbed")


def ways(tops: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """From each of the nodes ``(tree, level, pos)`` to the root: ``(tree, level, pos, way)``, siblings by step."""
    spark = tops.sparkSession
    found = spark.sql(f"""
        WITH RECURSIVE climb(tree, level, pos, at_tree, at_level, at_pos, way) MAX RECURSION LEVEL {levels + 1} AS (
            SELECT tree, level, pos, tree, level, pos, cast(array() AS array<struct<left: binary, right: binary>>) FROM {{tops}}
            UNION ALL
            SELECT c.tree, c.level, c.pos, n.up_tree, n.up_level, n.up_pos, concat(c.way, array(struct(n.left, n.right)))
            FROM climb c JOIN {{nodes}} n ON n.tree = c.at_tree AND n.level = c.at_level AND n.pos = c.at_pos)
        SELECT tree, level, pos, max_by(way, size(way)) AS way FROM climb GROUP BY tree, level, pos
        """, tops=tops, nodes=nodes.select("tree", "level", "pos", "up_tree", "up_level", "up_pos", "left", "right"))
    with unbounded_recursion(spark):
        return stored(found, "ways")


def manifest(docs: DataFrame, id: str = "doc_id", group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """Root, subroot and proof of every row, and what a row folds to when columns are replaced.

    Returns the id, ``leaf``, ``subroot``, ``root``, ``proof`` (the siblings' digests up to the root, as bytes), ``folded_root`` and
    ``verified`` (whether that is the root); the others are lower-case hex.  A leaf is the SHA-256 of ``columns``, each with
    its byte count, ``-`` for null.  Leaves of a group rise by id (null ids last, ties by digest); each ``FAN`` consecutive nodes make one, to the
    group's subroot; subroots by group (null first, bytewise) make the root alike.  ``tampered`` replaces columns in
    the leaf that is folded.

    Levels are stored as parent-linked node rows.  A recursive query takes each leaf ``ALONE`` levels up, appending siblings
    and folding its hash; a second one takes the nodes reached there to the root, once for all leaves below, and
    each leaf folds its hash along that way.  Spark deals the whole frontier of a recursion anew at every level, so
    carrying each leaf's siblings over all levels would shuffle several times the input.
    Texts are read once and never shuffled.  Null and empty texts, null groups and ids and repeated rows (each a leaf of its own) are leaves like any other;
    a single row is its own root with an empty proof; no rows in, no rows out.  Extra columns are ignored.
    """
    leaves = placed(leaf_rows(docs, id, group, columns, tampered or {}))
    spark = docs.sparkSession
    low = built(leaves.select("tree", "pos", "size", F.col("leaf").alias("digest")))
    subroots = stored(
        together(spark, low).where(f"up_tree = {TOP} AND pos = 0").select("tree", F.col("above").alias("digest"))
        .unionByName(leaves.where("size = 1").select("tree", F.col("leaf").alias("digest"))), "subroots")
    trees = subroots.count()
    high = built(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("long").alias("size"), "digest"))
    root = (high[-1].select("above") if high else subroots.select(F.col("digest").alias("above"))).first()
    root = F.lit(bytes(root["above"]) if root else None).cast("binary")

    climbs = climbed(leaves, together(spark, low[:ALONE]))
    tops = climbs.select(F.col("up_tree").alias("tree"), F.col("up_level").alias("level"), F.col("up_pos").alias("pos")).distinct()
    # A node at a group's root stands in the tree on top, at the place of its group.
    way = ways(tops, together(spark, low[ALONE:] + high), len(low[ALONE:] + high))
    group_of = F.when(F.col("tree") == TOP, F.col("pos")).otherwise(F.col("tree"))
    way = (
        way.withColumn("group", group_of).join(subroots.select(F.col("tree").alias("group"), F.col("digest").alias("subroot")), "group")
        .select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("pos").alias("up_pos"), "way", "subroot",
                F.unhex(F.array_join(F.flatten(F.transform("way", lambda x: F.array(F.hex(x["left"]), F.hex(x["right"])))), "")).alias("more"))
    )
    folded = F.aggregate("way", F.col("hash"), lambda h, x: digest(text_of(F.concat(x["left"], h, x["right"]))))
    proof = F.concat("siblings", "more")
    return (
        leaves.select("row", "doc_id", "leaf").join(climbs, "row").join(way, ["up_tree", "up_level", "up_pos"])
        .select(F.col("doc_id").alias(id), "leaf", "subroot", proof.alias("proof"), folded.alias("folded"))
        .select(id, text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(root).alias("root"), "proof",
                text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"))
    )
