"""Nearest neighbours by adaptive dimension scan inside probed lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import shipped, stored

#: Vectors that the lists' centres are fitted on: those of smallest id hash.
SAMPLE = 20_000
ROUNDS = 10
#: Share of the lists that a query probes; vectors without clusters need most of them for a recall of 0.95 and more.
PROBED = 0.75
#: Vectors and queries that meet in one task's block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Columns scanned at a time, and the deviations by which a partial distance must exceed the best to give up.
COLUMNS, DEVIATIONS = 16, 2.1


def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def sound(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows that take part: an id, ``size`` finite components, not all zero."""
    column = batch.column("v")
    good = pc.and_(pc.is_valid(batch.column("vec_id")), pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    at = np.flatnonzero(good.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(at), size)  # nulls become NaN
    whole = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[whole], x[whole]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centres(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), lists, replace=False))]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def adaptive_scan(q: np.ndarray, x: np.ndarray, asks: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that may be among a query's ``k`` nearest other ids; rows are rotated unit vectors, ``ids`` rise.

    Distances grow block of columns by block.  A query's bound is its ``k``-th distance among the
    ids that look nearest after the first block, each by the row that looks nearest and none the query's own.  A candidate is given up as
    soon as its partial distance, scaled to all columns, exceeds the bound by more
    than chance allows at that many columns; ties stay.
    """
    size = q.shape[1]
    step = min(COLUMNS, size)
    part = lambda i, j, a, b: ((q[i, a:b] - x[j, a:b]) ** 2).sum(1)
    partial = np.maximum((q[:, :step] ** 2).sum(1)[:, None] + (x[:, :step] ** 2).sum(1) - 2 * q[:, :step] @ x[:, :step].T, 0)
    partial[asks[:, None] == ids] = np.inf
    # One row an id: the least partial distance, and where it is.
    every, first, group = np.unique(ids, return_index=True, return_inverse=True)
    least, row = partial, None
    if len(every) < len(ids):
        least = np.minimum.reduceat(partial, first, axis=1)
        row = np.maximum.reduceat(np.where(partial == least[:, group], np.arange(len(ids)), -1), first, axis=1)
    probe = min(len(every), 4 * k)
    near = np.argpartition(least, probe - 1, axis=1)[:, :probe]
    own = np.isinf(np.take_along_axis(least, near, 1))
    if row is not None:
        near = np.take_along_axis(row, near, 1)
    full = part(np.repeat(np.arange(len(q)), probe), near.ravel(), 0, size).reshape(len(q), probe)
    full[own] = np.inf
    # Fewer other ids than asked for: all stay.
    bound = (np.sqrt(np.partition(full, k - 1, axis=1)[:, k - 1]) if probe >= k else np.full(len(q), np.inf)) + 1e-9
    # The slack is for rounding: equal vectors may differ by it.
    limit = lambda p: ((1 + DEVIATIONS / np.sqrt(p)) * bound) ** 2 * p / size + 1e-12
    i, j = np.nonzero((partial <= limit(step)[:, None]) & (partial < np.inf))
    seen = partial[i, j]
    for a in range(step, size, step):
        b = min(a + step, size)
        seen = seen + part(i, j, a, b)
        stay = seen <= (limit(b) if b < size else bound**2 + 1e-9)[i]
        i, j, seen = i[stay], j[stay], seen[stay]
    return i, j


def nearest(vectors: DataFrame, every: int, k: int = 5, id: str = "vec_id", vector: str = "embedding",
            probed: float = PROBED, lists: int | None = None) -> DataFrame:
    """The ``k`` nearest other vectors by cosine of each vector whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score``, nearest first and ties to the smaller id; the score is computed in
    double precision on the original vectors.  Centres are fitted on at most ``SAMPLE``
    vectors; every vector is indexed.  The number of lists follows the square root of the
    number of vectors up to 1024, and a query probes the share ``probed`` of them, more while those hold too few.
    Lists and the queries of a list are split into blocks, so a list with a third
    of all vectors is many blocks.  Vectors that are null, zero, of another length than most or that hold null or
    non-finite components take no part, nor does a null id.  Equal rows of an id are indexed once; its other rows are one
    vector with the best of their scores, and bounds and answers count ids, not rows; a query never finds its own id.  Fewer candidates than ``k`` are all returned; no rows in, none out.
    """
    spark = shipped(vectors.sparkSession)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    most = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.col("count").desc(), F.col("size").desc()).first()
    size = most["size"] if most else 0
    if not size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def clean(batches):
        for batch in batches:
            at, x = sound(batch, size)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])

    good = stored(rows.mapInArrow(clean, "vec_id long, x binary").distinct(), "vectors")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).toArrow()
    total = good.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    matrix = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)
    turn = rotation(size)
    lists = min(lists or (1 if total < 1000 else min(1024, 2 ** round(np.log2(total) / 2))), sample.num_rows)
    middle = centres(unit(matrix(sample.column("x"))) @ turn, lists)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                near = (unit(matrix(batch.column("x"))) @ turn @ middle.T).argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("vec_id"), batch.column("x")], ["list", "vec_id", "x"])

    index = stored(good.mapInArrow(assign, "list int, vec_id long, x binary"), "index")
    held = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    # An id whose rows lie in several lists counts in one of them, so lists never seem to hold more ids than they do.
    home = index.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count()
    homes = {r["list"]: r["count"] for r in home.collect()}
    filled, member = (np.array([n.get(i, 0) for i in range(lists)]) for n in (held, homes))

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                close = np.argsort(-(unit(matrix(batch.column("x"))) @ turn @ middle.T), axis=1, kind="stable")
                upto = np.cumsum(member[close], axis=1)
                # The nearest lists, and on while those before hold no more ids than k and the query's own.
                take = (np.arange(lists) < max(1, int(np.ceil(probed * lists)))) | (upto - member[close] <= k)
                row, col = np.nonzero(take & (filled[close] > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(close[row, col], pa.int32()), batch.column("vec_id").take(pa.array(row)), batch.column("x").take(pa.array(row))],
                    ["list", "query_id", "q"])

    asked = stored(good.where(F.col("vec_id") % every == 0).mapInArrow(probe, "list int, query_id long, q binary"), "probes")
    load = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    # One row a list: into how many blocks its vectors and its queries are dealt.
    blocks = spark.createDataFrame(
        [(i, -(-n // BLOCK), -(-load[i] // QUERY_BLOCK)) for i, n in held.items() if i in load], "list int, vectors int, queries int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (
        index.join(blocks, "list").withColumn("b", F.pmod(F.xxhash64("vec_id"), "vectors").cast("int"))
        .withColumn("c", span("queries")).select("list", "b", "c", "vec_id", "x")
    )
    right = (
        asked.join(blocks, "list").withColumn("c", F.pmod(F.xxhash64("query_id"), "queries").cast("int"))
        .withColumn("b", span("vectors")).select("list", "b", "c", "query_id", "q")
    )

    def scan(x_rows: pa.Table, q_rows: pa.Table) -> pa.Table:
        x_rows = x_rows.sort_by("vec_id")
        x, q = matrix(x_rows.column("x")), matrix(q_rows.column("q"))
        ids, asks = x_rows.column("vec_id").to_numpy(), q_rows.column("query_id").to_numpy()
        out = [[], [], []]
        if len(x) and len(q):
            turned_x, turned_q = unit(x) @ turn, unit(q) @ turn
            for a in range(0, len(q), 128):
                i, j = adaptive_scan(turned_q[a:a + 128], turned_x, asks[a:a + 128], ids, k)
                i = i + a
                score = _cosine(q, x, i, j)
                # The best row of each id, then the best ids.
                order = np.lexsort((-score, ids[j], i))
                i, j, score = i[order], j[order], score[order]
                best = np.ones(len(i), bool)
                best[1:] = (i[1:] != i[:-1]) | (ids[j][1:] != ids[j][:-1])
                i, j, score = i[best], j[best], score[best]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.searchsorted(i, i)
                best = np.arange(len(i)) - first < k
                for column, value in zip(out, (asks[i[best]], ids[j[best]], score[best])):
                    column.append(value)
        query, found, score = (np.concatenate(c) if c else np.zeros(0) for c in out)
        return pa.table({"query_id": pa.array(query.astype(np.int64)), "vec_id": pa.array(found.astype(np.int64)), "score": pa.array(score.astype(np.float64))})

    keys = ("list", "b", "c")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _cosine(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, a few at a time; equal vectors give equal values wherever they lie."""
    out = np.empty(len(i))
    for a in range(0, len(i), 1 << 15):
        s = slice(a, a + (1 << 15))
        y, z = scaled(q[i[s]]), scaled(x[j[s]])
        out[s] = (y * z).sum(1) / (np.sqrt((y * y).sum(1)) * np.sqrt((z * z).sum(1)))
    return out
