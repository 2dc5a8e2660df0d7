import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v and [None if x is None else float(x) for x in v], 1, 5, "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def check(got, vectors, count):
    """Compare with a direct eigendecomposition; ``vectors`` are the usable ones, in id order."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    v = c.T @ c / n
    values = np.linalg.eigvalsh(v)[::-1]
    assert {r.n for r in got} == {n}
    y = {(r.vec_id, r.component): r for r in got}
    ids = sorted({i for i, _ in y})
    assert len(y) == len(ids) * count
    w = np.array([[y[i, k + 1].whitened for k in range(count)] for i in ids])
    # Projections of x's rows on the whitened ones give the directions back.
    directions = c.T @ w / n / np.sqrt(values[:count])
    assert np.abs(v @ directions - directions * values[:count]).max() < 1e-9 * values[0]
    assert np.abs(directions.T @ directions - np.eye(count)).max() < 1e-9
    assert np.allclose([y[ids[0], k + 1].explained for k in range(count)], values[:count] / np.trace(v), rtol=1e-9)
    assert [y[i, 1].deviation for i in ids] == ((n * x - sums) ** 2).sum(axis=1).tolist()
    assert max(r.identity_error for r in got) < 1e-9


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(0)
    vectors = (rng.standard_normal((700, 40)) @ rng.standard_normal((40, 40)) / 20).astype(np.float32)
    check(whitening.whitened_components(frame(spark, vectors.tolist()).repartition(20)).collect(), vectors, 32)


def test_repeated_rows_and_equal_values(spark):
    # Every direction has the same variance, and rows repeat.
    vectors = [[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0], [0, -1.0, 0], [0, 0, 1.0], [0, 0, -1.0]] * 3
    check(whitening.whitened_components(frame(spark, vectors)).collect(), vectors, 3)


def test_rows_that_do_not_count(spark):
    good = [[0.5, -1.0, 2.0], [0.0, 1.5, -2.0], [3.0, 0.25, 0.125], [1.0, 1.0, 1.0], [7.0, -1.0, 0.0]]
    bad = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [1.0, math.inf, 1.0], [1.0, 2.0], [-math.inf, 0.0, 0.0]]
    df = frame(spark, good + bad, [*range(5), *range(10, 15), None, 3])
    got = whitening.whitened_components(df).collect()
    assert {r.vec_id for r in got} == set(range(5))
    check(got, good, 3)


def test_without_variance_and_empty(spark):
    assert whitening.whitened_components(frame(spark, [])).count() == 0
    assert whitening.whitened_components(frame(spark, [None, [math.nan]])).count() == 0
    assert whitening.whitened_components(frame(spark, [[1.0, 2.0]] * 4)).count() == 0
    # A constant dimension has no component.
    got = whitening.whitened_components(frame(spark, [[1.0, 2.0], [1.0, 3.0], [1.0, 5.0]])).collect()
    assert {r.component for r in got} == {1} and len(got) == 3 and all(math.isclose(r.explained, 1.0) for r in got)


def test_large_entries_stay_exact(spark):
    big = 1.0e8
    vectors = [[big * (i % 7), float(i), -big] for i in range(50)]
    got = whitening.whitened_components(frame(spark, vectors)).collect()
    x = [[math.floor(64 * float(np.float32(v))) + 1_000_000 for v in row] for row in vectors]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((50 * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    by = {r.vec_id: r.deviation for r in got}
    assert [by[i] for i in range(50)] == [e if e < 1 << 63 else None for e in exact]


def test_other_columns_stay(spark):
    df = frame(spark, [[1.0, 0.0], [0.0, 2.0], [3.0, 1.0]])
    model = whitening.fit_whitening(df, components=1)
    out = whitening.whiten(df, model)
    assert out.columns == ["vec_id", "label", "n", "deviation", "whitened"] and out.select(F.size("whitened")).distinct().first()[0] == 1


@pytest.mark.parametrize("seed", range(40))
def test_solver(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 14))
    r = np.triu(rng.integers(-2, 3, (size, size)) if seed % 2 else rng.standard_normal((size, size)) * 10.0 ** rng.integers(-6, 1, size))
    values, directions = bidiagonal.principal(r.astype(float), size)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want[: len(values)], rtol=1e-9, atol=1e-13 * want[0])
    assert (want[len(values):] <= 1e-19 * want[0] + 1e-300).all() or len(values) == size
    assert np.abs(directions.T @ directions - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(r.T @ (r @ directions) - directions * values).max(initial=0) <= 1e-12 * max(want[0], 1e-300)


def test_small_values_are_relatively_accurate():
    # Of a graded bidiagonal matrix the least value is found to full relative precision.
    diagonal, above = 10.0 ** -np.arange(0, 12.0), 0.5 * 10.0 ** -np.arange(0, 11.0)
    values = bidiagonal.squared_singular_values(diagonal, above)
    product = np.prod(diagonal**2)
    assert math.isclose(np.prod(values), product, rel_tol=1e-12)
