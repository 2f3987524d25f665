"""k nearest neighbours against all distances."""

import functools
import math
import operator

import numpy as np
import pytest

from spacerlake.operators import neighbours, scoring

KNOWN, ASKED = "id long, x array<double>, y double", "x array<double>"


def brute(asked, known, k):
    def usable(x):
        return x and all(v is not None and math.isfinite(v) for v in x)

    out = {}
    for q in {tuple(x) for x in asked if usable(x)}:
        rows = [(functools.reduce(operator.add, [(a - b) * (a - b) for a, b in zip(q, x, strict=True)]), i, y) for i, x, y in known if i is not None and usable(x)]
        out[q] = sorted(rows)[:k]
    return out


def told(df):
    return {tuple(r["x"]): [(n["distance"], n["id"], n["value"]) for n in r["neighbours"]] for r in df.collect()}


@pytest.mark.parametrize("k,pivots,rings,block,parts", [(7, 64, 32, 2048, 3), (7, 3, 4, 10, 7), (1, 5, 1, 50, 2), (40, 8, 4, 16, 4)])
def test_equal_all_distances(spark, k, pivots, rings, block, parts):
    rng = np.random.default_rng(k + pivots)
    x = np.concatenate([rng.integers(0, 6, (250, 3)), rng.integers(40, 90, (150, 3)), np.tile([[5, 5, 5]], (200, 1))]).astype(float)  # ties, two groups, a third of the rows equal
    known = [(int(i), row.tolist(), float(i % 2)) for i, row in zip(rng.permutation(len(x)), x, strict=True)]
    known += [(900, None, 1.0), (901, [1.0, None, 2.0], 1.0), (902, [1.0, float("nan"), 2.0], 1.0), (903, [float("inf"), 1.0, 2.0], 0.0), (None, [1.0, 1.0, 1.0], 0.0), (904, [], 1.0)]
    asked = [*rng.uniform(-5, 100, (60, 3)).tolist(), [5.0, 5.0, 5.0], [5.0, 5.0, 5.0], None, [None, 1.0, 1.0], [float("nan"), 1.0, 1.0], [1e6, -1e6, 0.0]]
    got = neighbours.nearest(spark.createDataFrame([(a,) for a in asked], ASKED).repartition(parts), spark.createDataFrame(known, KNOWN).repartition(parts), "x", "id", "y", k, pivots, rings, block)
    assert told(got) == brute(asked, known, k)


def test_few_and_none(spark):
    asked = spark.createDataFrame([([0.0],), ([-0.0],), ([2.0],)], ASKED)
    few = spark.createDataFrame([(1, [1.0], 1.0), (1, [1.0], 0.0), (2, [1.0], None)], KNOWN)
    assert told(neighbours.nearest(asked, few, "x", "id", "y")) == {(0.0,): [(1.0, 1, 0.0), (1.0, 1, 1.0), (1.0, 2, None)], (2.0,): [(1.0, 1, 0.0), (1.0, 1, 1.0), (1.0, 2, None)]}
    assert neighbours.nearest(asked, few.limit(0), "x", "id", "y").count() == 0
    assert neighbours.nearest(asked.limit(0), few, "x", "id", "y").count() == 0


def test_rings_are_left_out():
    away, low, high = np.array([[1.0, 1.0, 50.0], [6.0, 6.0, 40.0]]), np.array([0.0, 2.0, 0.0]), np.array([2.0, 5.0, 3.0])
    assert neighbours.near_rings(away, low, high, np.array([4, 9, 9]), 3).tolist() == [[True, True, False], [True, True, False]]
    assert neighbours.near_rings(away, low, high, np.array([4, 9, 9]), 15).tolist() == [[True, True, True], [True, True, True]]
    assert neighbours.near_rings(np.array([[0.0, 0.0]]), np.array([0.0, 3.0]), np.array([2.0, 5.0]), np.array([4, 9]), 4).tolist() == [[True, False]]


def test_ensemble_of_neighbours(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b), int(a + b > 0)) for k, (a, b) in enumerate(rng.standard_normal((300, 2)))]
    df = spark.createDataFrame([*rows, (300, None, 2.0, 1)], "k long, a double, b double, y int")
    scored = scoring.fit_ensemble(df, "y", {8: ["a", "b"], 9: ["a"]}, kind="neighbours", id_="k").score(df).collect()
    assert len(scored) == 301 and all(0 <= r["score"] <= 1 for r in scored)
    points = [(a or 0.0, b) for _, a, b, _ in [*rows, (300, None, 2.0, 1)]]
    labels = [r[3] for r in rows] + [1]
    for r in scored:
        q = (r["a"] or 0.0, r["b"])
        near = sorted(((q[0] - a) ** 2 + (q[1] - b) ** 2, k) for k, (a, b) in enumerate(points))[:7]
        assert r["score_8"] == pytest.approx(sum(labels[k] for _, k in near) / 7)


def test_boxes_leave_out_most_points():
    """Of points on a plane, the boxes within the bound of a query's own box hold few, and no nearer point is outside of them."""
    rng = np.random.default_rng(9)
    known, asked = rng.uniform(0, 1000, (4000, 2)), rng.uniform(0, 1000, (300, 2))
    dims, cuts = neighbours.split_tree(known[:1000], 128)
    own = neighbours.cell_of(known, dims, cuts)
    cells = np.unique(own)
    assert 100 < len(cells) <= 128
    low, high = (np.array([f(known[own == c], axis=0) for c in cells]) for f in (np.min, np.max))
    n = np.array([(own == c).sum() for c in cells])
    d = neighbours._distances(asked, known)
    home = np.where(own[None, :] == neighbours.cell_of(asked, dims, cuts)[:, None], d, np.inf)
    bound = np.partition(home, 6, axis=1)[:, 6]
    near = neighbours._from_boxes(asked, low, high) <= bound[:, None]
    assert (near @ n).mean() < 0.1 * len(known)
    inside = near[:, np.searchsorted(cells, own)]
    assert (inside | (d > bound[:, None])).all() and (neighbours._to_boxes(asked, low, high)[:, np.searchsorted(cells, own)] >= d).all()
    assert (neighbours.split_tree(np.ones((50, 3)), 64)[0] == -1).all() and neighbours.cell_of(np.ones((2, 3)), *neighbours.split_tree(np.ones((50, 3)), 1)).tolist() == [0, 0]


def test_queries_far_from_their_box(spark):
    """Hot boxes of several parts, boxes with fewer rows than k, and queries that have no bound from their own box."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 3, (300, 2)) + rng.uniform(0, 1e-6, (300, 2)), rng.uniform(0, 1e5, (40, 2)), [[1e5, 1e5]] * 3])
    known = [(k, row.tolist(), float(k % 3)) for k, row in enumerate(x)]
    asked = [*rng.uniform(-10, 1.1e5, (80, 2)).tolist(), *x[:50].tolist()]
    got = neighbours.nearest(spark.createDataFrame([(a,) for a in asked], ASKED), spark.createDataFrame(known, KNOWN), "x", "id", "y", 9, 8, 8, 16)
    assert told(got) == brute(asked, known, 9)
