"""Links between rows that hashing brings together: shared by the near-duplicate operators.

Rows are dealt out under keys; those of one key are compared by their sketches, which may find too much but hardly ever
too little. The connected components of what is alike are then compared pair by pair on the rows themselves. So each
pair is verified in one component, counted once, and no table holds pairs.

A large group is cut into blocks of BLOCK rows, and each pair of blocks is a group of its own, compared side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

BLOCK = 512
#: Rows compared at once, in whole groups.
CHUNK = 4096
#: Bits of a value in a trie's path.
LEVEL_BITS = 20


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) of every id in an edge between different ids (bigint): root is the smallest id reachable.

    Large-star and small-star steps by turns, each a grouping and a join, until nothing changes. Each round is kept as a table, and so is
    each id's least neighbour, so that the join back reads two tables and Spark can split an id with very many neighbours over several tasks.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(moved, "edges")
        discard(before, least)
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if after == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        mark = after


def in_blocks(rows: DataFrame, key: str, row_id: str, weight: Column | None = None, most: int = BLOCK) -> DataFrame:
    """The rows whose key has several, once for each pair of blocks they take part in, as (group, side, all other columns).

    side is 0 where a block meets itself, else 1 and 2. weight: rows that a row counts as.
    """
    size = F.count("*") if weight is None else F.greatest(F.count("*"), F.sum(weight))
    counted = rows.groupBy(key).agg(F.ceil(size / most).cast("int").alias("blocks"), F.count("*").alias("members")).where("members > 1").drop("members")
    own = F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("blocks")).cast("int")
    dealt = rows.join(counted, key).withColumn("own_block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own_block", "other"), F.greatest("own_block", "other")
    side = F.when(low == high, 0).when(F.col("own_block") == low, 1).otherwise(2).cast("int")
    return dealt.withColumns({"group": F.xxhash64(key, low, high), "side": side}).drop("blocks", "own_block", "other", key)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows, but for the last, cut where the column group changes; batches come sorted by it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held)
            groups = table.column("group").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))
            if cut:
                yield table.slice(0, cut)
                held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if size:
        yield pa.Table.from_batches(held)


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of n numbers by the pairs."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bytes_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of equal length, as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def joined_roots(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The roots, once the components of left and right are joined."""
    return roots_of(len(root), root[left], root[right])[root]


def _open_rows(group: np.ndarray, prefix: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The rows of the runs of one group and prefix that aren't one component yet."""
    starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (prefix[1:] != prefix[:-1])]))
    several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    return np.flatnonzero(np.repeat(several, np.diff(np.append(starts, len(group)))))


def sketch_edges(groups: DataFrame, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], levels: int = 0) -> DataFrame:
    """(id, other): a spanning forest, in each group (group, side, id, sketch), of the pairs that alike(sketches, sketches) finds.

    With levels, a group is a trie of so many levels below its key: the column path packs a row's values there, LEVEL_BITS each. Rows are sorted by path,
    so that those of a node stand together. Nodes are compared from the deepest on, each with its prefix shortened by one value at a time up to the key; rows that are
    connected already are not compared again, and a node that is one component is left.
    """
    names = ["group", "side", "id", "sketch", *(["path"] if levels else [])]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CHUNK):
            group, side, ids = (table.column(x).to_numpy() for x in ("group", "side", "id"))
            paths = table.column("path").to_numpy() if levels else np.zeros(len(ids), np.int64)
            sketches = bytes_matrix(table.column("sketch"))
            root = np.arange(len(ids))
            for level in range(levels, -1, -1):
                prefix = paths >> (LEVEL_BITS * (levels - level))
                rows = _open_rows(group, prefix, root)
                step = 1
                while step < len(rows):
                    near, far = rows[:-step], rows[step:]
                    same = (group[near] == group[far]) & (prefix[near] == prefix[far])
                    if not same.any():
                        break
                    same &= (root[near] != root[far]) & ((side[near] == 0) | (side[near] != side[far]))
                    near, far = near[same], far[same]
                    for at in range(0, len(near), CHUNK):
                        a, b = near[at : at + CHUNK], far[at : at + CHUNK]
                        found = alike(sketches[a], sketches[b])
                        if found.any():
                            root = joined_roots(root, a[found], b[found])
                    step += 1
            moved = np.flatnonzero(root != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["id", "other"])

    return groups.select(*names).repartition("group").sortWithinPartitions("group", *names[4:]).mapInArrow(edges, "id bigint, other bigint")


def verified_links(groups: DataFrame, linked: Callable[[pa.Table], tuple[pa.Table, np.ndarray]]) -> DataFrame:
    """(id, other, n_links) of the groups (group, side, id, copies, ...): rows linked with the id, and a spanning forest of the links.

    linked(table of a group) gives the rows it takes and their symmetric matrix of links. n_links counts copies.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            group = table.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end - start < 2:
                    continue
                own, links = linked(table.slice(start, end - start))
                ids, side, copies = (own.column(x).to_numpy() for x in ("id", "side", "copies"))
                links = links & ((side[:, None] != side[None, :]) | (side[:, None] == 0)) & ~np.eye(len(ids), dtype=bool)
                left, right = np.nonzero(links)
                if len(left):
                    root = roots_of(len(ids), left, right)
                    has = np.flatnonzero(links.any(axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[root[has]]), pa.array((links[has] * copies[None, :]).sum(axis=1).astype(np.int64))], names=["id", "other", "n_links"])

    return groups.repartition("group").sortWithinPartitions("group", "side").mapInArrow(verify, "id bigint, other bigint, n_links bigint")


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, n_links, root) of the members (id, copies): links to rows of other members and to copies; root is null without links to others."""
    links = stored(links, "links")
    counts = links.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    roots = connected_components(links, "id", "other")
    return members.join(counts, "id", "left").join(roots, "id", "left").select("id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("root"))
