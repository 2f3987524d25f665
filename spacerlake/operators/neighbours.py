"""Exact k nearest neighbours by boxes.

Known points are dealt to cells by a tree of splits at medians of a bounded sample of them, and queries to the same cells. A cell's points make parts of about BLOCK points, and its queries chunks of as many. Each query is
compared with a part of its own cell first, which bounds the k-th neighbour's distance; then only with the parts of cells whose box of points isn't farther away. A chunk's queries lie together, so most cells are left out
for all of them at once. Parts and chunks are rows of joins and compared by Arrow arrays; what is found farther away than the bound is dropped at once.

Equal known points are one point with its k least ids, and equal queries are one query, so copies make no group larger. The driver and the tasks' code hold the sample's tree and a row for each cell, at most
PIVOTS * RINGS of them, whatever the number of points. In many dimensions boxes are hardly farther away than points, and most cells are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, RINGS, BLOCK = 64, 32, 2048
#: Known points that the tree is made from.
SAMPLE = 1 << 15
#: Queries of a chunk that are compared at a time.
_SLICE = 128
#: Bounds are widened by this share, as distances are rounded.
_SLACK = 1e-9


def least_rows(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The k first rows of each key. Tasks leave k rows a key before the shuffle."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= k).drop("_place")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not (column.value_lengths().to_numpy() == width).all():
        raise ValueError(f"points have other lengths than {width}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, dimension after dimension: the sum is the same however points are dealt."""
    total = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        total += (x[:, k, None] - y[None, :, k]) ** 2
    return total


def _usable(rows: DataFrame, features: str) -> DataFrame:
    x = F.col(features).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col(features).isNotNull() & (F.size(features) > 0) & finite).withColumn("x", F.transform(x, lambda v: v + F.lit(0.0)))  # -0.0 and 0.0 are one value


def near_rings(away: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """queries x rings: which rings may hold one of the k nearest of their n points; away: the distance from a ring's pivot, low and high: its points' least and greatest distance from it."""
    upper, lower = (away + high) * (1 + _SLACK), np.maximum(low - away, away - high)
    order = np.argsort(upper, axis=1)
    enough = np.argmax(np.cumsum(n[order], axis=1) >= min(k, n.sum()), axis=1)
    bound = np.take_along_axis(upper, np.take_along_axis(order, enough[:, None], axis=1), axis=1)
    return lower <= bound + _SLACK * (away + high)


ROWS, NEAR = "array<struct<id: bigint, value: double>>", "struct<distance: double, id: bigint, value: double>"


def split_tree(sample: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, place) of the splits of a binary tree of at most so many leaves: node k's halves are 2 k + 1 (up to the place) and 2 k + 2; -1 is a leaf. Each splits its points' widest dimension at their median."""
    depth = max(1, leaves).bit_length() - 1
    dims, cuts = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1)
    own = {0: sample}
    for node in range(2**depth - 1):
        x = own.pop(node, sample[:0])
        if len(x) < 2:
            continue
        d = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        at = np.sort(x[:, d])
        smaller = at[at < at[-1]]
        if not len(smaller):
            continue
        dims[node], cuts[node] = d, min(at[(len(at) - 1) // 2], smaller[-1])
        left = x[:, d] <= cuts[node]
        own[2 * node + 1], own[2 * node + 2] = x[left], x[~left]
    return dims, cuts


def cell_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(x), np.int64)
    for _ in range(len(dims).bit_length() - 1):
        d = dims[node]
        node = np.where(d >= 0, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(d, 0)] > cuts[node]), node)
    return node


def _from_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """points x boxes: the least squared distance of a point from those in a box."""
    total = np.zeros((len(x), len(low)))
    for k in range(x.shape[1]):
        total += np.maximum(0, np.maximum(low[None, :, k] - x[:, k, None], x[:, k, None] - high[None, :, k])) ** 2
    return total


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """points x boxes: the greatest one."""
    total = np.zeros((len(x), len(low)))
    for k in range(x.shape[1]):
        total += np.maximum(np.abs(low[None, :, k] - x[:, k, None]), np.abs(x[:, k, None] - high[None, :, k])) ** 2
    return total


class _Known:
    """A part's rows: points, each with its ids and values."""

    def __init__(self, part: pa.StructArray, width: int):
        self.points, rows = _matrix(part.field("x"), width), part.field("rows")
        flat = rows.flatten()
        self.of_point = np.repeat(np.arange(len(self.points)), rows.value_lengths().to_numpy())
        self.id, self.value = flat.field("id").to_numpy(), flat.field("value")

    def distances(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, self.points)[:, self.of_point]

    def least(self, d: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of each query's k first rows, by distance and id, of those within its bound."""
        query, row = np.nonzero(d <= bound[:, None])
        order = np.lexsort((row, self.id[row], d[query, row], query))
        query, row = query[order], row[order]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[first], row[first]

    def structs(self, distance: np.ndarray, row: np.ndarray) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(distance), pa.array(self.id[row]), self.value.take(pa.array(row))], names=["distance", "id", "value"])


def nearest(queries: DataFrame, known: DataFrame, features: str, id_: str, value: str, k: int = 7, pivots: int = PIVOTS, rings: int = RINGS, block: int = BLOCK) -> DataFrame:
    """(x, neighbours): each different point of queries and its k nearest rows of known as structs (distance, id, value), sorted by distance (squared) and then id.

    features: arrays of numbers, all of one length in both tables; another length in queries is an error. id_ is a bigint that tells rows of known apart (of rows with equal point and id the least value counts first); value a number.
    Points that are null or empty or hold null, NaN or infinite numbers are left out on both sides, and so are rows without an id. With fewer than k known rows all of them are neighbours; with none there are no rows.
    pivots * rings: the most cells; block: about how many points or queries are a row. known is read three times, queries twice: what is dear to compute is better stored before.
    """
    points = _usable(known, features).where(F.col(id_).isNotNull()).select("x", F.col(id_).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"))
    points = least_rows(points, ["x"], ["id", "value"], k).groupBy("x").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("rows"))
    asked = _usable(queries, features).select("x").distinct()
    result = f"x array<double>, neighbours array<{NEAR}>"
    chosen = points.select("x", F.xxhash64("x").alias("h")).orderBy("h", "x").limit(SAMPLE).collect()
    if not chosen:
        return queries.sparkSession.createDataFrame([], result)
    dims, cuts = split_tree(np.array([r["x"] for r in chosen]), pivots * rings)
    width = len(chosen[0]["x"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(cell_of(_matrix(batch.column(0), width), dims, cuts)))

    in_cell = points.mapInArrow(placed, f"x array<double>, rows {ROWS}, cell bigint")
    box = [f(F.col("x")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(width)]
    table = in_cell.groupBy("cell").agg(F.count("*").alias("points"), F.sum(F.size("rows")).alias("n"), *box).orderBy("cell").collect()
    cell, n = np.array([r["cell"] for r in table]), np.array([r["n"] for r in table])
    low, high = np.array([list(r[3 : 3 + width]) for r in table]), np.array([list(r[3 + width :]) for r in table])
    blocks = np.array([-(-r["points"] // block) for r in table])
    offset = np.cumsum(blocks) - blocks
    asked_cell = asked.mapInArrow(placed, "x array<double>, cell bigint")
    chunks = {r["cell"]: -(-r["count"] // block) for r in asked_cell.groupBy("cell").count().collect()}

    # known points by part: a cell's points are dealt by their hash; queries by a part of their cell and chunk
    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cell, batch.column("cell").to_numpy())
            part = offset[at] + batch.column("h").to_numpy() % blocks[at]
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("x"), batch.column("rows")], names=["part", "x", "rows"])

    def home_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, h = batch.column("cell").to_numpy(), batch.column("h").to_numpy()
            at = np.minimum(np.searchsorted(cell, own), len(cell) - 1)  # a cell without known points has the next one's
            chunk = h % np.array([chunks[c] for c in own.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("x"), pa.array(offset[at] + chunk % blocks[at]), pa.array(own), pa.array(chunk)], names=["x", "part", "cell", "chunk"])

    known_parts = in_cell.select("x", "rows", "cell", F.xxhash64("x").alias("h")).mapInArrow(part_of, f"part bigint, x array<double>, rows {ROWS}").groupBy("part").agg(
        F.collect_list(F.struct("x", "rows")).alias("known")
    )
    at_home = asked_cell.select("x", "cell", F.xxhash64("x").alias("h")).mapInArrow(home_of, "x array<double>, part bigint, cell bigint, chunk bigint")
    home = at_home.groupBy("part", "cell", "chunk").agg(F.collect_list("x").alias("asked"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query what its first part holds (part -1), and the other parts that it may reach, with its bound."""
        for batch in batches:
            for at in range(batch.num_rows):
                part, known_ = batch.column("part")[at].as_py(), _Known(batch.column("known")[at].values, width)
                lists = batch.column("asked")[at].values
                x = _matrix(lists, width)
                bound, found = np.full(len(x), np.inf), []
                for begin in range(0, len(x), _SLICE):
                    d = known_.distances(x[begin : begin + _SLICE])
                    if d.shape[1] >= k:
                        bound[begin : begin + _SLICE] = np.partition(d, k - 1, axis=1)[:, k - 1]
                    query, row = known_.least(d, bound[begin : begin + _SLICE], k)
                    found.append((query + begin, d[query, row], row))
                query, d, row = (np.concatenate(f) for f in zip(*found, strict=True))
                # cells within reach of any of them, then of each
                apart = np.maximum(0, np.maximum(low - x.max(axis=0), x.min(axis=0) - high))
                some = np.flatnonzero((apart**2).sum(axis=1) * (1 - _SLACK) <= bound.max())
                reached, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for begin in range(0, len(x), _SLICE):
                    own, most = x[begin : begin + _SLICE], bound[begin : begin + _SLICE, None]
                    near = _from_boxes(own, low[some], high[some]) * (1 - _SLACK) <= most
                    open_ = np.flatnonzero(np.isinf(most[:, 0]))
                    if len(open_):
                        near[open_] = near_rings(0.0, np.sqrt(_from_boxes(own[open_], low, high)), np.sqrt(_to_boxes(own[open_], low, high)), n, k)[:, some]
                    q, c = np.nonzero(near)
                    c = some[c]
                    many = blocks[c]
                    reached.append(begin + np.repeat(q, many))
                    parts.append(np.repeat(offset[c], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                reached, parts = np.concatenate(reached), np.concatenate(parts)
                reached, parts = reached[parts != part], parts[parts != part]
                rows = known_.structs(d, row)
                sizes = np.concatenate([np.bincount(query, minlength=len(x)), np.zeros(len(reached), np.int64)])
                take = np.concatenate([np.arange(len(x)), reached])
                yield pa.RecordBatch.from_arrays([
                    lists.take(pa.array(take)), pa.array(np.concatenate([np.full(len(x), -1), parts])), batch.column("cell").take(pa.array(np.full(len(take), at))), batch.column("chunk").take(pa.array(np.full(len(take), at))),
                    pa.array(bound[take]), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), rows),
                ], names=["x", "part", "cell", "chunk", "bound", "found"])

    near = f"array<{NEAR}>"
    reached = home.join(known_parts, "part").select("part", "cell", "chunk", "asked", "known").mapInArrow(first, f"x array<double>, part bigint, cell bigint, chunk bigint, bound double, found {near}")
    groups = reached.groupBy("part", "cell", "chunk").agg(F.collect_list(F.struct("x", "bound", "found")).alias("asked"))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a chunk's queries found first, and what they find in another part, of each query one row at most."""
        for batch in batches:
            for at in range(batch.num_rows):
                asked_, part = batch.column("asked")[at].values, batch.column("known")[at].values
                if part is None:
                    yield pa.RecordBatch.from_arrays([asked_.field("x"), asked_.field("found")], names=["x", "found"])
                    continue
                known_ = _Known(part, width)
                x, bound = _matrix(asked_.field("x"), width), asked_.field("bound").to_numpy()
                for begin in range(0, len(x), _SLICE):
                    d = known_.distances(x[begin : begin + _SLICE])
                    query, row = known_.least(d, bound[begin : begin + _SLICE], k)
                    own = np.unique(query)
                    sizes = np.bincount(query, minlength=len(d))[own]
                    yield pa.RecordBatch.from_arrays([
                        asked_.field("x").take(pa.array(own + begin)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), known_.structs(d[query, row], row)),
                    ], names=["x", "found"])

    every = groups.join(known_parts, "part", "left").select("asked", "known").mapInArrow(further, f"x array<double>, found {near}")
    return every.groupBy("x").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("neighbours"))


def vote(neighbours: str = "neighbours"):
    """The mean value of the neighbours: for labels of 0 and 1, the share of ones."""
    return F.aggregate(neighbours, F.lit(0.0), lambda a, x: a + F.coalesce(x["value"], F.lit(0.0))) / F.size(neighbours)
