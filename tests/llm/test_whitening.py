import math

import numpy as np
import pytest

from docmill.llm import whitening


def brute(vectors, k):
    """Components, deviations and whitened values by numpy's covariance of the distinct vectors."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors])
    once = np.unique(x, axis=0)
    values, parts = np.linalg.eigh(np.cov(once.T.astype(float), bias=True).reshape(x.shape[1], -1))
    values, parts = values[::-1], parts[:, ::-1]
    n, sums = len(once), once.sum(axis=0)
    dev = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return n, dev, (x - sums / n) @ (parts[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


def check(spark, vectors, k, df=None):
    got = {}
    for r in whitening.whiten(df or spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>"), k).collect():
        assert (r.vec_id, r.component) not in got
        got[r.vec_id, r.component] = r
    n, dev, white, part = brute(vectors, k)
    assert len(got) == len(vectors) * k
    for c in range(k):
        mine = np.array([got[i, c + 1].whitened for i in range(len(vectors))])
        sign = np.sign(mine @ white[:, c])
        np.testing.assert_allclose(mine, sign * white[:, c], rtol=1e-8, atol=1e-8)
        for i in range(len(vectors)):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, dev[i])
            assert r.explained == pytest.approx(part[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 9)) * np.array([3, 1, 0.3, 2, 0.1, 1, 5, 0.2, 1]) @ rng.normal(size=(9, 9)) + 40
    check(spark, np.vstack([v, np.repeat(v[:1], 300, axis=0)]), 4)  # a hot vector counts once


def test_without_full_rank(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 3))
    v = np.column_stack([v, v[:, 0], np.full(120, 7.0), v[:, 1], v[:, 2] * 0])  # equal and constant dimensions
    check(spark, v, 3)
    assert whitening.fit(spark.createDataFrame([([int(c * 256 // 1) for c in r],) for r in v], "x array<long>").distinct()).components.shape == (7, 3)


def test_far_apart_scales(spark):
    """A condition of about 1e9, where one Cholesky factor of the plain Gram matrix would lose half of the digits."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 5)) * np.array([1e9, 1e6, 1e4, 50, 5])).astype(int)
    turned = x.copy()
    turned[:, 1] += x[:, 0] // 3
    turned[:, 4] += x[:, 0] // 1000
    model = whitening.fit(spark.createDataFrame([(r.tolist(),) for r in turned], "x array<long>").distinct())
    a = turned - turned.mean(axis=0)
    singular = np.linalg.svd(a, compute_uv=False)
    np.testing.assert_allclose(np.sqrt(model.eigenvalues * model.n), singular, rtol=1e-7)
    white = a @ (model.components / np.sqrt(model.eigenvalues))
    np.testing.assert_allclose(white.T @ white / model.n, np.eye(5), atol=1e-6)


def test_rows_without_vectors_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (None, [3.0, 3.5]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "9 as x", "'c' as component", "1 as n")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 1, 2) for c in (1, 2))
    assert {r.n for r in got} == {3}


def test_nothing_to_fit(spark):
    for rows in ([], [(1, None)], [(1, [2.0, 2.0]), (2, [2.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_numbers_beyond_a_long():
    assert whitening.deviations(np.array([[1 << 40, 0], [1, 2]]), 10, [5, 5]) == [None, 5**2 + 15**2]
    assert whitening.deviations(np.array([[3, 4]]), 1 << 31, [0, 0]) == [None]


def test_sums_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "CELLS", 3)
    df = spark.createDataFrame([([i, -i, 1 << 61],) for i in range(50)], "x array<long>").repartition(9)
    assert whitening.added_up(df, lambda x: x.T.astype(float) @ x[:, :2], 6).tolist()[:2] == [float(sum(i * i for i in range(50))), -float(sum(i * i for i in range(50)))]
    assert whitening.fit(df).sums == [1225, -1225, 50 << 61]
