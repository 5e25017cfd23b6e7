"""MinHash near-dedup with an LSH forest: neighbours in several sorted signature orders."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import Texts, buckets, gram_hashes, mixed, per_batch, shipped, slices, stored
from pageloom.llm.graph import components, merged

WORDS, PERCENT = 5, 80
#: Orders of the forest, values of a label in each, and how many of them neighbours share at least.
#: At a similarity of 0.8 a pair misses all orders with probability (1 - 0.8**4)**16 = 0.0002, at 0.85 with 0.00001.
TREES, DEPTH, BASE = 16, 8, 4
#: Members of a region that meet in one task when neighbours alone have not joined it.
TILE = 512

_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**32, TREES * DEPTH, np.uint32) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, TREES * DEPTH, np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: Texts, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and where each row's begin (one more at the end).

    A-Z count as lower case.  Fewer words than ``size`` are one shingle; no word, none.
    """
    words = texts.lower().words()
    h, counts = words.hashes(), words.counts
    held = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.append(0, np.cumsum(held))
    g = np.empty(at[-1], np.uint64)
    long = np.repeat(counts >= size, held)
    if long.any():
        grams = gram_hashes(h, size)
        first = np.repeat(words.first[:-1] - at[:-1], held)
        g[long] = grams[(np.arange(at[-1]) + first)[long]]
    for n in range(1, size):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            x = np.full(len(rows), n, np.uint64)
            for j in range(n):
                x = mixed(x * _STEP + h[words.first[rows] + j])
            g[at[rows]] = x
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        g[a:b].sort()
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    fresh[at[:-1][held > 0]] = True
    kept = np.append(0, np.cumsum(fresh))
    return g[fresh], kept[at]


def signatures(texts: Texts, size: int) -> dict:
    """By row: the set's size, two hashes of the whole set, and its MinHash values (bytes; none for an empty set)."""
    g, at = shingle_sets(texts, size)
    full = np.flatnonzero(np.diff(at))
    begin = at[:-1][full]
    h1, h2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    least = np.empty((len(full), TREES * DEPTH), np.uint32)
    if len(full):
        h1[full] = np.add.reduceat(mixed(g + _STEP), begin)
        h2[full] = np.add.reduceat(mixed(g ^ _STEP), begin)
        x = (g >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for i in range(TREES * DEPTH):
            np.bitwise_xor(x, _FLIP[i], out=y)
            np.multiply(y, _MULTIPLY[i], out=y)
            least[:, i] = np.minimum.reduceat(y, begin)
    sig = [None] * len(texts)
    for k, i in enumerate(full.tolist()):
        sig[i] = least[k].tobytes()
    return {"n_shingles": np.diff(at), "h1": h1.view(np.int64), "h2": h2.view(np.int64), "sig": pa.array(sig, pa.binary())}


@contextmanager
def batches_of(spark, rows: int):
    """Arrow batches of at most ``rows`` rows for the writes inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forest(sets: DataFrame) -> DataFrame:
    """``(tree, region, label, id)``: a row of ``(id, sig)`` in each order; a region shares the first ``BASE`` values of an order."""
    def grow(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, TREES, DEPTH)
            if not len(sig):
                continue
            region = np.zeros(sig.shape[:2], np.uint64) + np.arange(TREES, dtype=np.uint64)
            for k in range(BASE):
                region = mixed(region * _STEP + sig[:, :, k])
            label = np.ascontiguousarray(sig[:, :, BASE:].astype(">u4")).view(f"S{4 * (DEPTH - BASE)}").reshape(-1)
            size = 4 * (DEPTH - BASE)
            label = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), label.size, [None, pa.py_buffer(label.tobytes())]).cast(pa.binary())
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(ids))), "region": pa.array(region.reshape(-1).view(np.int64)), "label": label, "id": pa.array(np.repeat(ids, TREES), pa.int64())})

    return sets.select("id", "sig").mapInArrow(grow, "tree int, region long, label binary, id long")


def neighbours(rows: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: rows of one region that follow each other in the order of their labels.

    Sorting by label puts the longest common prefixes side by side, so the depth at
    which two neighbours meet adapts to how many others their region holds.  The
    order is split by range, ids included, so a region of any size spreads over
    tasks; the last row of a task meets the first of the next in a table of two rows a task.
    """
    n = buckets(rows.sparkSession)

    def walk(batches):
        last, part, first = None, TaskContext.get().partitionId(), None
        row = lambda kind, x: pa.RecordBatch.from_pydict({
            "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "region": pa.array([x[0]], pa.int64()),
            "a": pa.array([x[1]], pa.int64()), "b": pa.array([None], pa.int64())})
        for batch in batches:
            if not batch.num_rows:
                continue
            region, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "id"))
            if last is not None:
                region, ids = np.append(last[0], region), np.append(last[1], ids)
            else:
                first = (region[0], ids[0])
            last = (region[-1], ids[-1])
            at = np.flatnonzero((region[1:] == region[:-1]) & (ids[1:] != ids[:-1]))
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.zeros(len(at), np.int32)), "part": pa.array(np.full(len(at), part, np.int32)),
                "region": pa.array(region[at]), "a": pa.array(ids[at]), "b": pa.array(ids[at + 1])})
        if first is not None:
            yield row(1, first)
            yield row(2, last)

    order = ["region", "label", "id"]
    found = stored(rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
                   .mapInArrow(walk, "kind int, part int, region long, a long, b long"), "neighbours")
    tasks = Window.orderBy("part", "kind")
    seams = (
        found.where("kind > 0").withColumn("next_region", F.lead("region").over(tasks)).withColumn("b", F.lead("a").over(tasks))
        .where("kind = 2 AND next_region = region AND a != b").select("a", "b")
    )
    pairs = found.where("kind = 0").select("a", "b").unionByName(seams)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets share ``percent`` of their union; ``texts`` is ``(id, text)``."""
    def confirm(batches):
        for batch in slices(batches, "left", 1):
            (g, at), (k, to) = (shingle_sets(Texts.of(batch.column(c)), size) for c in ("left", "right"))
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                linked[i] = alike(g[at[i]:at[i + 1]], k[to[i]:to[i + 1]], percent)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    wide = (
        pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")
    )
    with batches_of(pairs.sparkSession, 500):
        return stored(wide.mapInArrow(confirm, "a long, b long"), "links")


def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    of = lambda side: component.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
    return (
        pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    )


def unjoined(rows: DataFrame, texts: DataFrame, component: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that share a region and that neighbours alone did not join.

    Only regions of three or more that still hold several components.  Members are dealt into
    tiles and each pair of tiles is one task's block; pairs never leave it.  There, pairs whose signatures agree within six
    deviations of the threshold are compared in full, those in the first order that they share only, the
    likeliest first and only while they still lie in different components, so the links that leave are fewer than the block's members.
    """
    placed = rows.select("tree", "region", "id").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tiles = lambda n: F.ceil(n / TILE).cast("int")
    held = placed.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = stored(
        held.groupBy("region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component")).alias("most"))
        .where("n > 2 AND components > 1")
        .select("region", F.col("most.component").alias("bulk"), tiles(F.col("n") - F.col("most.n")).alias("few"), tiles(F.col("most.n")).alias("many")),
        "open-regions")
    if open_.isEmpty():
        return open_.select(F.col("region").alias("a"), F.col("region").alias("b"))
    # The largest component's members meet the others, not each other: its tiles come after theirs.
    inner = F.col("component") == F.col("bulk")
    dealt = (
        placed.join(open_, "region")
        .withColumn("tile", F.when(inner, F.col("few") + F.pmod(F.xxhash64("id"), "many")).otherwise(F.pmod(F.xxhash64("id"), "few")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inner, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
        .select("region", "tree", "id", "component", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
        .join(texts.select("id", "sig", "text"), "id")
    )
    p = percent / 100
    least = int(TREES * DEPTH * p - 6 * (TREES * DEPTH * p * (1 - p)) ** 0.5)

    def meet(table: pa.Table) -> pa.Table:
        ids, component, tile = (table.column(c).to_numpy() for c in ("id", "component", "tile"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), TREES, DEPTH)
        i, j, tree = (table.column(c)[0].as_py() for c in ("i", "j", "tree"))
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        pairs = []
        for x in left.tolist():
            y = right[(component[right] != component[x]) & ((right > x) | (i != j))]
            same = sig[y] == sig[x]
            agree = np.count_nonzero(same, axis=(1, 2))
            good = (agree >= least) & (same[:, :, :BASE].all(2).argmax(1) == tree)
            pairs.append(np.column_stack([agree[good], np.full(np.sum(good), x), y[good]]))
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        sets, root, found = {}, {}, []

        def set_of(x):
            if x not in sets:
                sets[x] = shingle_sets(Texts.of(table.column("text").slice(x, 1)), size)[0]
            return sets[x]

        def find(c):
            while root.get(c, c) != c:
                c = root[c] = root.get(root[c], root[c])
            return c

        for _, x, y in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
            a, b = find(component[x]), find(component[y])
            if a != b and alike(set_of(x), set_of(y), percent):
                root[max(a, b)] = min(a, b)
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    with batches_of(rows.sparkSession, 500):
        return stored(dealt.groupBy("region", "i", "j").applyInArrow(meet, "a long, b long"), "unjoined")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` of their union."""
    both = np.concatenate((x, y))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return bool(shared) and 100 * shared >= percent * (len(both) - shared)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The near-duplicate component of each document.

    Returns the id, ``n_shingles``, ``component_id`` (the smallest id reachable over links, its own
    included) and ``kept`` (whether that is its own id), a row for each row.  Documents are linked when
    100 * intersection >= ``percent`` * union of their sets of distinct ``size``-word
    shingles; the full sets decide, the forest only proposes.  Equal sets are one
    node.  First each node's best neighbour is confirmed, then every other proposal
    that would join two components, then whatever a region still keeps apart.
    A null or empty text has an empty set and no links.  A null id has no component and is kept.  Rows of one
    id are one node.  No rows in, no rows out; extra columns are ignored.
    """
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    made = stored(per_batch(rows, lambda b: {"doc_id": b.column("doc_id"), **signatures(Texts.of(b.column("text")), size)},
                            "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "signatures")
    nodes = made.where("doc_id IS NOT NULL AND sig IS NOT NULL")
    # Stored, so that the join deals the rows anew and a set that many hold can be split there.
    leads = stored(nodes.groupBy("h1", "h2").agg(F.min("doc_id").alias("lead")), "leads")
    members = stored(nodes.join(leads, ["h1", "h2"]).select("doc_id", "lead", F.expr("CASE WHEN doc_id = lead THEN sig END AS sig")), "members")
    sets = members.where("sig IS NOT NULL").select(F.col("doc_id").alias("id"), "sig").distinct()
    trees = forest(sets)
    pairs = stored(neighbours(trees).groupBy("a", "b").agg(F.count(F.lit(1)).alias("orders")), "pairs")

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = sets.join(ids, F.col("id") == F.col("doc_id"), "left_semi")
    texts = stored(rows.join(wanted, F.col("doc_id") == F.col("id")).select("id", "text", "sig"), "candidates")
    best = stored(pairs.groupBy("b").agg(F.max_by("a", F.struct("orders", -F.col("a"))).alias("a")).select("a", "b"), "best")
    # An id with several texts joins their sets.
    least = members.groupBy("doc_id").agg(F.min("lead").alias("a"), F.max("lead").alias("b")).where("a != b").select("doc_id", "a")
    same = members.join(least, "doc_id").select("a", F.col("lead").alias("b")).where("a != b")
    component = components(same.unionByName(confirmed(best, texts, size, percent)))

    rest = stored(apart(pairs.join(best, ["a", "b"], "left_anti"), component), "rest")
    if not rest.isEmpty():
        component = merged(component, confirmed(rest, texts, size, percent))
    rest = unjoined(trees, texts, component, size, percent)
    if not rest.isEmpty():
        component = merged(component, rest)

    found = (
        members.select("doc_id", F.col("lead").alias("id")).distinct().join(component, "id", "left")
        .groupBy(F.col("doc_id").alias("member")).agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    )
    own = F.coalesce("component_id", "doc_id")
    return (
        made.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("member"), "left")
        .select(F.col("doc_id").alias(id), "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
    )
