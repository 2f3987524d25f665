"""Extremely randomised trees, grown level by level on a DataFrame.

Every tree sees all rows. A node draws some features and, for each, a threshold between the feature's least and greatest value in the node; the draws depend on the seed, tree, node and feature
only, and what is added up is counts and extremes, so the same rows give the same trees on any partitioning. A level takes two passes over the rows for all trees together: the nodes' extremes,
then both sides' counts for the thresholds. Tasks add up their rows before anything is shuffled, to one row for each (node, feature).

The driver holds the nodes of a level, at most trees * 2^depth of them, and the trees, which go to the tasks with the code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMS = "node bigint, feature int, n bigint, ones bigint, low double, high double"


@dataclass
class ExtraTrees:
    """trees x nodes: node k's children are 2 k and 2 k + 1, from 1 on; feature is -1 where a node isn't split. value: the share of ones in the node."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node that each row (rows x features) comes to in each tree, as far as the trees are grown."""
        tree = np.arange(len(self.feature))[None, :]
        node = np.ones((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            feature = self.feature[tree, node]
            right = x[np.arange(len(x))[:, None], np.maximum(feature, 0)] > self.threshold[tree, node]
            node = np.where(feature >= 0, 2 * node + right, node)
        return node

    def chances(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.arange(len(self.feature))[None, :], self.nodes(x)].mean(axis=1)

    def probability(self, features: Column) -> Column:
        """The mean share of ones of a row's leaves, of an array of features without nulls."""

        def score(xs: pd.Series) -> pd.Series:
            return pd.Series(self.chances(np.stack(xs.to_numpy())) if len(xs) else np.zeros(0))

        return F.pandas_udf(score, "double")(features)


def _added(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], pd.DataFrame]) -> pd.DataFrame:
    """work(features, labels) of batches, added up by (node, feature)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: pd.DataFrame | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = some.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                found = work(x, some.column(1).to_numpy())
                total = found if total is None else _grouped(pd.concat([total, found]))
        if total is not None:
            yield pa.RecordBatch.from_pandas(total, schema=pa.schema([("node", pa.int64()), ("feature", pa.int32()), ("n", pa.int64()), ("ones", pa.int64()), ("low", pa.float64()), ("high", pa.float64())]), preserve_index=False)

    parts = rows.mapInArrow(add, SUMS)
    return parts.groupBy("node", "feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()


def _grouped(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby(["node", "feature"], as_index=False).agg(n=("n", "sum"), ones=("ones", "sum"), low=("low", "min"), high=("high", "max"))


def fit_extra_trees(rows: DataFrame, features: str, label: str, trees: int = 30, depth: int = 6, tried: int | None = None, least: int = 2, seed: int = 1) -> ExtraTrees:
    """Trees of rows (features: an array of numbers without nulls, all of one length; label: 0 or 1; rows with a null in either go). tried: features that a node draws, the root of their number if not given.

    Of a node's draws the one with the least Gini impurity is taken, of equal ones the least feature. Nodes of one class, of fewer than `least` rows, without a feature that varies, or at the depth are leaves.
    """
    known = rows.where(F.col(features).isNotNull() & F.col(label).isNotNull() & (F.size(features) > 0)).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("bigint").alias("y")).persist()  # read twice a level; what is lost with an executor is made again
    size = 2 << depth
    model = ExtraTrees(np.full((trees, size), -1), np.zeros((trees, size)), np.full((trees, size), 0.5), 0)
    growing = {t * size + 1 for t in range(trees)}
    for level in range(depth + 1):

        def extremes(x: np.ndarray, y: np.ndarray, model: ExtraTrees = model, growing: frozenset = frozenset(growing)) -> pd.DataFrame:
            node = (model.nodes(x) + np.arange(trees)[None, :] * size).ravel()
            row = np.repeat(np.arange(len(x)), trees)
            keep = np.isin(node, np.fromiter(growing, np.int64))
            node, row = node[keep], row[keep]
            wide = pd.DataFrame({"node": np.tile(node, x.shape[1]), "feature": np.repeat(np.arange(x.shape[1], dtype=np.int32), len(node)), "n": 1, "ones": np.tile(y[row], x.shape[1]), "low": x[row].T.ravel()})
            return _grouped(wide.assign(high=wide["low"]))

        found = _added(known, extremes) if growing else pd.DataFrame(columns=["node", "feature", "n", "ones", "low", "high"])
        drawn: dict[int, list[tuple[int, float]]] = {}
        for node, own in found.sort_values(["node", "feature"]).groupby("node"):
            n, ones = int(own["n"].iloc[0]), int(own["ones"].iloc[0])
            tree, place = divmod(int(node), size)
            model.value[tree, place] = ones / n
            varying = own[own["low"] < own["high"]]
            if level == depth or n < least or ones in (0, n) or varying.empty:
                continue
            rng = np.random.default_rng([seed, tree, place])
            order, at = rng.permutation(len(own)), rng.random(len(own))
            chosen = [k for k in order if own["low"].iloc[k] < own["high"].iloc[k]][: tried or max(1, round(len(own) ** 0.5))]
            drawn[int(node)] = sorted((int(own["feature"].iloc[k]), float(own["low"].iloc[k] + at[k] * (own["high"].iloc[k] - own["low"].iloc[k]))) for k in chosen)
        if not drawn:
            break

        def sides(x: np.ndarray, y: np.ndarray, model: ExtraTrees = model, drawn: dict = drawn) -> pd.DataFrame:
            node = model.nodes(x) + np.arange(trees)[None, :] * size
            parts = []
            for at in np.unique(node):
                if int(at) in drawn:
                    row = np.unique(np.nonzero(node == at)[0])
                    for feature, threshold in drawn[int(at)]:
                        left = x[row, feature] <= threshold
                        parts.append((int(at), feature, int(left.sum()), int(y[row][left].sum()), 0.0, 0.0))
            return pd.DataFrame(parts, columns=["node", "feature", "n", "ones", "low", "high"])

        left = {(int(r.node), int(r.feature)): (int(r.n), int(r.ones)) for r in _added(known, sides).itertuples()}
        whole = {int(r.node): (int(r.n), int(r.ones)) for r in found.itertuples()}
        growing = set()
        for node, draws in drawn.items():
            n, ones = whole[node]

            def impurity(feature: int, node: int = node, n: int = n, ones: int = ones) -> float:
                m, k = left.get((node, feature), (0, 0))
                return sum(2 * b * (a - b) / a for a, b in ((m, k), (n - m, ones - k)) if a)

            feature, threshold = min(draws, key=lambda d: (impurity(d[0]), d[0]))
            tree, place = divmod(node, size)
            model.feature[tree, place], model.threshold[tree, place] = feature, threshold
            growing |= {tree * size + 2 * place, tree * size + 2 * place + 1}
        model.depth = level + 1
    known.unpersist()
    return model
