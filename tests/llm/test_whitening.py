"""Whitening against plain linear algebra on all rows at once."""

import math

import brute
import numpy as np
import pytest
from pageloom.llm import whitening
from pageloom.llm.queries import QUERIES


def whole_rows(rows):
    """Vectors that take part as exact whole numbers, by row."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    return [(i, v) for i, v in kept if len(v) == size]


def check(got, rows, components=32):
    """Rows of the operator against eigenvectors of the covariance in double precision."""
    kept = whole_rows(rows)
    n, size = len(kept), len(kept[0][1])
    sums = [sum(v[k] for _, v in kept) for k in range(size)]
    exact = [[n * v[k] - sums[k] for k in range(size)] for _, v in kept]
    y = np.array(exact, float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(components, int((values > 1e-18 * values[0]).sum()))
    want = y @ vectors[:, :count] / np.sqrt(values[:count])
    by_row = {}
    for r in got:
        by_row.setdefault(r.vec_id, []).append(r)
    assert set(by_row) == {i for i, _ in kept}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    found = np.zeros((n, count))
    for k, (i, _) in enumerate(kept):
        own = sorted(by_row[i], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, count + 1))
        assert {r.deviation for r in own} == {sum(c * c for c in exact[k])}
        np.testing.assert_allclose([r.explained for r in own], values[:count] / values.sum(), rtol=1e-9)
        found[k] = [r.whitened for r in own]
    signs = np.sign((found * want).sum(0))
    gaps = np.abs(np.diff(values[:count + 1] if count < len(values) else np.append(values[:count], 0))).min() / values[0]
    if gaps > 1e-9:
        np.testing.assert_allclose(found * signs, want, atol=1e-9 / gaps)
    cov = (found - found.mean(0)).T @ (found - found.mean(0)) / n
    assert np.abs(cov - np.eye(count)).max() < 1e-8


def test_query(spark):
    table = spark.read.parquet(f"{brute.FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    check(QUERIES["op11_whitening"](spark, brute.FOLDER).collect(), rows)


SCHEMA = "embedding array<double>, vec_id long, x string, size string, component string"


def framed(spark, rows):
    return spark.createDataFrame([(v, i, "x", None, "c") for i, v in rows], SCHEMA).repartition(5)


def test_messy_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [50, 3, 1, 0.5, 20] + [0, 9000, 0, -3, 1]).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 2.0, 3.0, 4.0]), (1003, [float("nan")] * 5), (1004, [float("inf")] + [0.0] * 4),
             (1005, [1.0, 2.0]), (1006, [1e300] * 5)]
    check(whitening.whitened(framed(spark, rows)).collect(), [r for r in rows if r[0] != 1006])


def test_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whitened(framed(spark, rows))
        assert got.collect() == [] and got.columns[0] == "vec_id"


def test_repeated_rows_count_and_null_ids_stay(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 2.0]), (2, [5.0, 1.0])]
    got = whitening.whitened(framed(spark, rows)).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2


def test_fewer_directions_than_dimensions(spark):
    """Constant and copied dimensions have no variance of their own."""
    rng = np.random.default_rng(4)
    base = rng.integers(-50, 50, (200, 3)) / 64
    rows = [(i, [*b.tolist(), float(b[0]), 7.0, float(b[1] + b[2])]) for i, b in enumerate(base)]
    got = whitening.whitened(framed(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert got[0].identity_error < 1e-10 and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_a_deviation_beyond_long_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whitened(framed(spark, [(1, [1e14]), (2, [-1e14]), (3, [0.0])])).collect()


@pytest.mark.parametrize("case", ["random", "graded", "equal", "clusters", "wilkinson", "diagonal", "singular", "one"])
def test_singular_values_and_vectors(case):
    rng = np.random.default_rng(7)
    turn = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    made = {
        "random": lambda: rng.normal(size=(64, 64)), "graded": lambda: turn(40) * 10.0 ** -np.arange(40) @ turn(40),
        "equal": lambda: turn(30) * 3.0, "clusters": lambda: turn(24) * np.repeat([9.0, 4.0, 1.0], 8) @ turn(24),
        "wilkinson": lambda: np.diag(np.abs(np.arange(-20, 21)) + 1.0) + np.diag(np.ones(40), 1),
        "diagonal": lambda: np.diag([3.0, 5.0, 3.0, 1.0]), "singular": lambda: rng.normal(size=(20, 5)) @ rng.normal(size=(5, 20)),
        "one": lambda: np.array([[2.0]]),
    }[case]()
    size = made.shape[1]
    r = np.linalg.qr(made, mode="r")
    want = np.linalg.svd(r, compute_uv=False)
    values, w = whitening.right_vectors(r, size)
    if case == "graded":
        # Small values keep their digits as far as the bidiagonal matrix has them.
        diagonal, above, _ = whitening.bidiagonal(r)
        own = np.linalg.svd(np.diag(diagonal) + np.diag(above, 1), compute_uv=False)
        np.testing.assert_allclose(np.sqrt(whitening.dqds(diagonal, above))[:14], own[:14], rtol=1e-2)
    assert len(values) == {"singular": 5}.get(case, len(values))
    np.testing.assert_allclose(np.sqrt(values), want[:len(values)], rtol=1e-10, atol=1e-13 * want[0])
    assert np.abs(w.T @ w - np.eye(len(values))).max() < 1e-10
    assert np.abs(r.T @ (r @ w) - w * values).max() < 1e-12 * want[0] ** 2 * size


def test_dqds_keeps_small_values():
    """Values of a bidiagonal matrix over 200 orders of magnitude, against whole-number arithmetic."""
    from fractions import Fraction

    diagonal, above = np.array([1.0, 1e-50, 1e-100]), np.array([1e-10, 1e-60])
    got = whitening.dqds(diagonal, above)
    product = Fraction(1)
    for x in diagonal:
        product *= Fraction(float(x)) ** 2
    assert abs(Fraction(got[0]) * Fraction(got[1]) * Fraction(got[2]) / product - 1) < Fraction(1, 10**13)
