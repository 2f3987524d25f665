"""Extremely randomised trees against a small local version, and on any partitioning."""

import numpy as np

from spacerlake.operators import trees


def local_trees(x, y, n_trees, depth, seed):
    """The same by recursion, a tree and a node at a time."""
    size = 2 << depth
    feature, threshold, value = np.full((n_trees, size), -1), np.zeros((n_trees, size)), np.full((n_trees, size), 0.5)

    def grow(tree, place, rows, level):
        ones, n = int(y[rows].sum()), len(rows)
        if not n:
            return
        value[tree, place] = ones / n
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        if level == depth or n < 2 or ones in (0, n) or (low == high).all():
            return
        rng = np.random.default_rng([seed, tree, place])
        order, at = rng.permutation(x.shape[1]), rng.random(x.shape[1])
        draws = sorted([(k, low[k] + at[k] * (high[k] - low[k])) for k in order if low[k] < high[k]][: max(1, round(x.shape[1] ** 0.5))])
        best = min(draws, key=lambda d: (sum(2 * b * (len(s) - b) / len(s) for s in (rows[x[rows, d[0]] <= d[1]], rows[x[rows, d[0]] > d[1]]) if len(s) for b in [y[s].sum()]), d[0]))
        feature[tree, place], threshold[tree, place] = best
        grow(tree, 2 * place, rows[x[rows, best[0]] <= best[1]], level + 1)
        grow(tree, 2 * place + 1, rows[x[rows, best[0]] > best[1]], level + 1)

    for tree in range(n_trees):
        grow(tree, 1, np.arange(len(x)), 0)
    return feature, threshold, value


def test_trees_equal_a_local_version(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((400, 5)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0) ^ (rng.random(400) < 0.05)).astype(int)
    rows = [([float(v) for v in a], int(b), k) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (None, 1, 900), ([1.0] * 5, None, 901)], "x array<double>, y int, k int")
    want = local_trees(x, y, 8, 4, 3)
    models = [trees.fit_extra_trees(df.repartition(p), "x", "y", trees=8, depth=4, seed=3) for p in (1, 7)]
    for m in models:
        assert (m.feature == want[0]).all() and (m.threshold == want[1]).all() and (m.value == want[2]).all()
    deep = trees.fit_extra_trees(df, "x", "y", trees=20, depth=6, seed=4)
    fresh = np.round(rng.standard_normal((500, 5)), 2)
    right = (deep.chances(fresh) >= 0.5) == (fresh[:, 0] + fresh[:, 1] * fresh[:, 2] > 0)
    local = local_trees(x, y, 20, 6, 4)
    other = trees.ExtraTrees(*local, 6).chances(fresh) >= 0.5
    assert right.mean() > 0.75 and abs(right.mean() - (other == (fresh[:, 0] + fresh[:, 1] * fresh[:, 2] > 0)).mean()) <= 0.02
    scored = df.where("x IS NOT NULL").select("k", deep.probability("x").alias("p")).collect()
    assert all(abs(r["p"] - deep.chances(x[r["k"] : r["k"] + 1])[0]) < 1e-12 for r in scored if r["k"] < 400)


def test_trees_without_rows_or_choice(spark):
    schema = "x array<double>, y int"
    assert trees.fit_extra_trees(spark.createDataFrame([], schema), "x", "y", trees=2).chances(np.zeros((1, 3))).tolist() == [0.5]
    same = trees.fit_extra_trees(spark.createDataFrame([([1.0, 2.0], k % 4 == 0) for k in range(8)], "x array<double>, y boolean").selectExpr("x", "int(y) AS y"), "x", "y", trees=2)
    assert same.chances(np.array([[1.0, 2.0]])).tolist() == [0.25] and (same.feature == -1).all()
