import numpy as np
import pytest

from docmill.llm import neighbours

IS_QUERY = "vec_id % 20 = 0"


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    m = np.array([v for _, v in good])
    ids = np.array([i for i, _ in good])
    out = {}
    for at, (i, v) in enumerate(good):
        if i % 20 == 0:
            s = (m * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if j != at][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(3000):
        v = centres[i % 30] + 0.4 * rng.standard_normal(16)
        v = v * rng.uniform(0.3, 2) if scaled else v / np.linalg.norm(v)
        rows.append((i, [float(x) for x in v]))
    hot = rows[40][1]
    rows += [(5000 + i, hot) for i in range(1500)]
    rows += [(9000, None), (9001, [0.0] * 16), (9020, [float("nan")] * 16), (9040, [None] + [1.0] * 15), (9060, [1.0]), (None, [1.0] * 16), (9080, []), (9100, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as leaf", "'x' as v")
    got = {}
    for r in neighbours.nearest(df, IS_QUERY).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, 20)
    assert got.keys() == want.keys()
    good = total = 0
    for q, hits in want.items():
        assert len(got[q]) == 20 and len({i for i, _ in got[q]}) == 20 and q not in {i for i, _ in got[q]}
        assert got[q] == sorted(got[q], key=lambda h: (-h[1], h[0]))
        good += len({i for i, _ in hits} & {i for i, _ in got[q]})
        total += 20
    assert good / total >= 0.9
    assert got[5000] == want[5000]  # a copy of the hot vector: its nearest are the copies with the smallest ids


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    got = neighbours.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 2.0])], schema), IS_QUERY).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert neighbours.nearest(spark.createDataFrame([], schema), IS_QUERY).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, None)], schema), IS_QUERY).count() == 0


def test_chi_square_and_tree():
    assert abs(neighbours.chi_square_quantile(0.95, 12) - 21.026) < 0.001
    points = np.random.default_rng(0).standard_normal((500, 12))
    tree = neighbours.build_tree(points, 16)
    leaf = tree.leaf(points)
    assert set(leaf) == set(range(16)) and np.bincount(leaf).max() <= 40
    assert all(tree.distances(p)[n] == 0 for p, n in zip(points, leaf, strict=True))
