"""Whitening of vectors: blockwise QR, Householder bidiagonals, dqds singular values, twisted factorisations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import matrix_sum, shipped, stored

COMPONENTS = 32
#: Entries c count as the whole numbers floor(SCALE * c) + SHIFT, so that sums are exact.
SCALE, SHIFT = 64, 1_000_000
#: Triangles that meet in one task, and rows of a block that is reduced at once.
MEET, BLOCK = 16, 2048
EPS = float(np.finfo(float).eps)
#: Relative gap below which eigenvalues count as close.
CLOSE = 1e-3
_LONG = np.iinfo(np.int64).max


# ---- Rows -----------------------------------------------------------------------

def grid(column: pa.Array, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their whole numbers end to end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    values = pc.fill_null(column.values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    # Infinite, missing, or no long.
    bad = ~(np.abs(scaled) < 2.0**62)
    upto = np.append(0, np.cumsum(bad))
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) > 0) & (upto[at[1:]] == upto[at[:-1]])
    rows = np.flatnonzero(good)
    size = np.diff(at)[rows]
    first = np.cumsum(size) - size
    pick = np.repeat(at[rows] - first, size) + np.arange(size.sum())
    return rows, size, scaled[pick].astype(np.int64) + shift


def whole(batch: pa.RecordBatch) -> np.ndarray:
    """The whole numbers of a batch's rows, a row each."""
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(batch.num_rows, -1)


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exact: longs where all fit, Python's whole numbers otherwise."""
    bound = max(1, int(np.abs(x).max(initial=0))) * n + max(map(abs, total))
    if bound < 2**62:
        return x * np.int64(n) - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def squares(c: np.ndarray) -> np.ndarray:
    """Sums of squares by row as longs; exact, an error where one does not fit."""
    most = int(np.abs(c).max(initial=0))
    if c.dtype == object or most * most * c.shape[1] > _LONG:
        c = c.astype(object)
        out = (c * c).sum(1)
        if max(out) > _LONG:
            raise OverflowError("a sum of squared deviations does not fit a long")
        return out.astype(np.int64)
    return (c * c).sum(1)


# ---- Small matrices on the driver -------------------------------------------------

def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta) such that (1 - beta v v') x has zeros after its first entry."""
    v = x.astype(float)
    most = np.abs(v[1:]).max(initial=0.0)
    if most == 0:
        return v, 0.0
    most = max(most, abs(v[0]))
    v = v / most
    v[0] += np.copysign(np.sqrt(v @ v), v[0])
    return v, 2 / (v @ v)


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with ``a`` = U B V' by Householder reflections from both sides."""
    a, size = a.astype(float), a.shape[1]
    v = np.eye(size)
    for k in range(size):
        w, beta = reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * w, w @ a[k:, k:])
        if k < size - 2:
            w, beta = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ w, beta * w)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ w, beta * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float):
    """One differential qd transform: (q, e, least d), or (None, None, d) with the d that fell below zero last."""
    n, d = len(q), q[0] - shift
    qq, ee, least = [0.0] * n, [0.0] * (n - 1), d
    for k in range(n - 1):
        if d < 0:
            return None, None, -np.inf
        qq[k] = d + e[k]
        if qq[k] == 0:
            # Nothing couples this place to the next.
            t, ee[k], d = 0.0, 0.0, q[k + 1] - shift
        else:
            t = q[k + 1] / qq[k]
            ee[k] = e[k] * t
            d = d * t - shift
        least = min(least, d)
    qq[-1] = d
    return (qq, ee, least) if d >= 0 else (None, None, d)


def _pair(q1: float, e: float, q2: float) -> tuple[float, float]:
    """Eigenvalues of a block of two, the larger first, without cancellation."""
    half = (q1 - q2 + e) / 2
    large = (q1 + q2 + e) / 2 + np.sqrt(half * half + q2 * e)
    return large, (q1 * (q2 / large) if large else 0.0)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling; each to a small relative error.

    Differential qd transforms with shifts below the least value: only sums and products of positive numbers, so no
    value loses digits to larger ones.  A shift that turns out too large is taken back.
    """
    found, small = [], (4 * EPS) ** 2
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    while work:
        q, e, moved = work.pop()
        guess = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(moved + q[0])
                break
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= small * (moved + min(q[k], q[k + 1])) or e[k] < 1e-300), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], moved))
                q, e, guess = q[cut + 1:], e[cut + 1:], 0.0
                continue
            if n == 2:
                found += [moved + x for x in _pair(q[0], e[0], q[1])]
                break
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = guess
            while True:
                new, left, least = _sweep(q, e, shift)
                if new is not None:
                    break
                # Failing at the last place alone, the shift and what is missing bound the least value from below.
                lower = shift + least if np.isfinite(least) else 0.0
                shift = lower * (1 - 4 * EPS) if 0 < lower < shift * (1 - 8 * EPS) else shift / 4 if shift > 1e-3 * guess else 0.0
            q, e, moved = new, left, moved + shift
            guess = max(least, 0.0)
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for the eigenvalues ``values``, a column each.

    With B'B = L D L', the stationary transform factors L D L' - value from above and the progressive one from below;
    where both meet with the least remainder, the vector is read off both factors by products alone.
    """
    n, many = len(diagonal), len(values)
    tiny = EPS * EPS * max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0), 1e-150)
    a = np.where(np.abs(diagonal) > tiny, diagonal, tiny)
    d, low = a * a, above / a[:-1]
    safe = lambda x: np.where(np.abs(x) > 1e-290, x, 1e-290)
    s, upper = np.empty((n, many)), np.empty((max(n - 1, 0), many))
    s[0] = -values
    for i in range(n - 1):
        upper[i] = d[i] * low[i] / safe(s[i] + d[i])
        s[i + 1] = upper[i] * low[i] * s[i] - values
    p, lower = np.empty((n, many)), np.empty((max(n - 1, 0), many))
    p[-1] = d[-1] - values
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] ** 2 + p[i + 1])
        lower[i] = low[i] * t
        p[i] = p[i + 1] * t - values
    rest = s + p + values
    rng = np.random.default_rng(11)
    out = np.zeros((n, many))
    for j in range(many):
        r = int(np.abs(rest[:, j]).argmin())
        middle = np.concatenate([s[:r, j] + d[:r], rest[r:r + 1, j], d[r:-1] * low[r:] ** 2 + p[r + 1:, j]])
        middle = safe(middle)
        near = near if j and values[j - 1] - values[j] < CLOSE * values[j - 1] else j
        z = np.zeros(n)
        z[r] = middle[r]
        # Among close values, inverse iteration from a start of its own, orthogonal to the vectors before.
        alone = near == j and (j + 1 == many or values[j] - values[j + 1] >= CLOSE * values[j])
        for turn in range(1 if alone else 4):
            if not alone and not turn:
                z = rng.normal(size=n)
            z = _solve(upper[:, j], lower[:, j], middle, r, z)
            for k in [*range(near, j)] * 2:
                z -= (out[:, k] @ z) * out[:, k]
            z /= max(np.sqrt(z @ z), 1e-300)
        out[:, j] = z
    return out


def _solve(upper, lower, middle, r: int, z: np.ndarray) -> np.ndarray:
    """Solves N diag(middle) N' x = z for a twisted factor N that meets at ``r``."""
    y, n = z.copy(), len(z)
    for i in range(r):
        y[i + 1] -= upper[i] * y[i]
    for i in range(n - 1, r, -1):
        y[i - 1] -= lower[i - 1] * y[i]
    x = y / middle
    x /= max(np.abs(x).max(), 1e-300)
    for i in range(r - 1, -1, -1):
        x[i] -= upper[i] * x[i + 1]
    for i in range(r, n - 1):
        x[i + 1] -= lower[i] * x[i]
    return x / max(np.abs(x).max(), 1e-300)


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest squared singular values of a square matrix, falling, and their right vectors by column.

    Values that rounding alone could make are left out.
    """
    scale = np.abs(r).max(initial=0.0)
    if scale == 0:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    diagonal, above, v = bidiagonal(r / scale)
    size, values, vectors = len(diagonal), [], []
    # Where the superdiagonal is zero to rounding, the matrix falls apart.
    cuts = [0, *(np.flatnonzero(np.abs(above) <= size * EPS * np.abs(diagonal).max()) + 1), size]
    for a, b in zip(cuts, cuts[1:]):
        own = dqds(diagonal[a:b], above[a:b - 1])
        values.append(own)
        block = np.zeros((size, len(own)))
        block[a:b] = twisted(diagonal[a:b], above[a:b - 1], own)
        vectors.append(block)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    order = order[np.sqrt(values[order]) > 8 * size * EPS * np.sqrt(values.max())][:most]
    w = v @ vectors[:, order]
    w /= np.sqrt((w * w).sum(0))
    white = (r / scale) @ w / np.sqrt(values[order])
    if not np.abs(white.T @ white - np.eye(len(order))).max() < 1e-8 or not np.abs(w.T @ w - np.eye(len(order))).max() < 1e-8:
        w = rotated(r / scale @ v, v)[:, :len(order)]
    w *= np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
    return values[order] * scale * scale, w


def rotated(y: np.ndarray, v: np.ndarray, turns: int = 60) -> np.ndarray:
    """``v`` rotated until the columns of ``y``, rotated alike, are orthogonal; by falling length.

    For matrices with so many equal singular values that twisted factors cannot tell their vectors apart.
    """
    y, v, moved = y.copy(), v.copy(), True
    for _ in range(turns):
        if not moved:
            break
        moved = False
        for i in range(y.shape[1] - 1):
            for j in range(i + 1, y.shape[1]):
                a, b, c = y[:, i] @ y[:, i], y[:, j] @ y[:, j], y[:, i] @ y[:, j]
                if abs(c) <= 4 * EPS * np.sqrt(a * b) or c == 0:
                    continue
                moved = True
                zeta = (b - a) / (2 * c)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                for m in (y, v):
                    m[:, i], m[:, j] = cos * (m[:, i] - t * m[:, j]), cos * (t * m[:, i] + m[:, j])
    return v[:, np.argsort(-(y * y).sum(0), kind="stable")]


# ---- Spark ----------------------------------------------------------------------

def triangle(rows: DataFrame, centred, size: int) -> np.ndarray:
    """R of the QR factorisation of all centred rows: by task in blocks, then of ``MEET`` triangles at a time."""
    def reduce_(batches):
        r = np.zeros((0, size))
        for batch in batches:
            y = centred(batch)
            for a in range(0, len(y), BLOCK):
                r = np.linalg.qr(np.vstack([r, y[a:a + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        table, r = table.sort_by("part"), np.zeros((0, size))
        for x in table.column("r"):
            r = np.linalg.qr(np.vstack([r, np.frombuffer(x.as_py()).reshape(-1, size)]), mode="r")
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // MEET], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    parts = stored(rows.mapInArrow(reduce_, "part int, r binary"), "triangles")
    while (most := parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = stored(parts.groupBy((F.col("part") / MEET).cast("int")).applyInArrow(meet, "part int, r binary"), "triangles")
    found = parts.first()
    r = np.frombuffer(found["r"]).reshape(-1, size) if found else np.zeros((0, size))
    return np.vstack([r, np.zeros((max(size - len(r), 0), size))])


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Whitening components of each vector.

    Returns the id, ``component`` (from 1, by falling eigenvalue of the covariance), ``n`` (vectors fitted), ``deviation``
    (sum over dimensions of (n * x - S)^2, S the sums; exact), ``whitened`` (the centred x along the component in units of its deviation),
    ``explained`` (the component's share of all variance) and ``identity_error`` (how far the covariance of ``whitened``
    is from the identity).  x is floor(``scale`` * entry) + ``shift``.

    Every row is fitted.  Sums are whole numbers; tasks reduce centred rows to triangles by QR in blocks, and triangles meet
    ``MEET`` at a time, so what a task or the driver holds depends on the number of dimensions alone.  The covariance is never
    formed: the driver makes the last triangle bidiagonal, finds its singular values by dqds and their vectors by
    twisted factorisations.
    Null or empty vectors and vectors that hold null, infinite or NaN entries, or entries for which x is no long,
    take no part and get no rows; neither do vectors of another length than most (the smaller length, if two are as
    common).  Repeated rows and ids count each; a null id stays.  Components without variance are not returned, so a single vector
    or equal vectors give no rows.  No rows in, no rows out.  A deviation that does not fit a long is an error.
    Extra columns are ignored.
    """
    shipped(vectors.sparkSession)
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vector).alias("v"))
    kind = dict(rows.dtypes)["vec_id"]

    def parse(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            taken, size, x = grid(batch.column("v"), scale, shift)
            ends, data = np.cumsum(size) * 8, x.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(taken)), pa.array(size.astype(np.int32)),
                pa.array([data[z - 8 * m:z] for z, m in zip(ends.tolist(), size.tolist())], pa.binary())], ["vec_id", "size", "x"])

    parsed = stored(rows.mapInArrow(parse, f"vec_id {kind}, size int, x binary"), "whole")
    common = parsed.groupBy("size").count().orderBy(F.col("count").desc(), "size").first()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("vec_id", id)
    if common is None:
        return none
    size, n = common["size"], common["count"]
    fitted = parsed.where(F.col("size") == size).select("vec_id", "x")

    def halves(batches):
        # Sums of the upper and lower 32 bits: exact for two billion rows a task.
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = whole(batch)
                total += np.array([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "high": pa.array(total[0]), "low": pa.array(total[1])})

    as_whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = fitted.mapInArrow(halves, "i int, high long, low long").groupBy("i").agg(as_whole("high"), as_whole("low")).orderBy("i").collect()
    total = [(int(r["high"]) << 32) + int(r["low"]) for r in sums]

    def centred(batch):
        return deviations(whole(batch), n, total).astype(float) / n if batch.num_rows else np.zeros((0, size))

    r = triangle(fitted, centred, size)
    variance = float((r * r).sum()) / n
    values, directions = right_vectors(r, components)
    count = len(values)
    if not count:
        return none
    values = values / n
    project = directions / np.sqrt(values)

    def turn(batches):
        for batch in batches:
            if batch.num_rows:
                c = deviations(whole(batch), n, total)
                w = (c.astype(float) / n) @ project
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(squares(c)), pa.array([x.tobytes() for x in w], pa.binary())], ["vec_id", "deviation", "w"])

    turned = stored(fitted.mapInArrow(turn, f"vec_id {kind}, deviation long, w binary"), "whitened")
    read = lambda batch: np.frombuffer(b"".join(batch.column("w").to_pylist())).reshape(-1, count)
    mean = matrix_sum(turned, lambda batch: read(batch).sum(0, keepdims=True), (1, count))[0] / n

    def products(batch):
        w = read(batch) - mean
        return w.T @ w

    covariance = matrix_sum(turned, products, (count, count)) / n
    error = float(np.abs(covariance - np.eye(count)).max())
    explained = values / variance

    def spread(batches):
        for batch in batches:
            m = batch.num_rows
            if m:
                each = pa.array(np.repeat(np.arange(m), count))
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, n, np.int64)),
                    batch.column("deviation").take(each), pa.array(read(batch).reshape(-1)), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * count, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return turned.mapInArrow(spread, schema).withColumnRenamed("vec_id", id)
