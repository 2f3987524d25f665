"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, distributed components.

Vectors of one label are compared by cosine in double precision. Equal vectors of a label count as copies and are hashed once. A
vector's signs at random hyperplanes, some bits for each of several tables, are its sketch; each table's signs are a key. Keys get SPARE bits more than number
the vectors of the largest label, so that few meet by chance in a table of any size. Of two vectors with a cosine of
THRESHOLD, the chance to share no key is (1 - p^bits)^tables, p = 1 - arccos(THRESHOLD) / pi; there are as many tables as bring it to MISSED. Vectors that
share a key and whose sketches differ in at most MOST_SIGNS of the signs (six standard deviations above the mean at THRESHOLD) go
to one component, and all pairs in a component are verified.

Defined results: a vector that is null, of no components, zero, or holds null or non-finite components links with nothing, and so
does one with a null label; vectors of different length don't link; repeated rows are vectors of their own; an empty table gives no rows.
A row without links is its own component and kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import classes, connected_components, in_blocks, sketch_edges, verified_links
from .shared import stored, table

THRESHOLD = 0.93
LEAST_BITS, MOST_BITS, SPARE, MISSED = 10, 40, 1, 4e-5
SEED = 20


def key_bits(rows: int) -> int:
    """Bits of a key for the rows of the largest label."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, rows) - 1).bit_length() + SPARE))


def key_tables(bits: int, threshold: float = THRESHOLD, missed: float = MISSED) -> int:
    p = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(missed) / math.log1p(-(p**bits)))


def _most_signs(threshold: float, signs: int) -> int:
    p = math.acos(threshold) / math.pi
    return math.ceil(signs * p + 6 * math.sqrt(signs * p * (1 - p)))


def _sketches(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """(id, bucket, sketch, codes) of (id, bucket, vector)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for n in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == n))
                if n not in planes:
                    planes[n] = np.random.default_rng([SEED, n]).standard_normal((n, bits * tables))
                for at in range(0, rows.num_rows, 1024):
                    some = rows.slice(at, 1024)
                    x = some.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                    signs = x / np.abs(x).max(axis=1, keepdims=True) @ planes[n] > 0
                    codes = signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                    packed = np.packbits(signs, axis=1)
                    yield pa.RecordBatch.from_arrays([
                        some.column("id"), some.column("bucket"), pa.array([r.tobytes() for r in packed], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables, pa.int32()), pa.array(codes.ravel())),
                    ], names=["id", "bucket", "sketch", "codes"])

    return vectors.select("id", "bucket", "vector").mapInArrow(sign, "id bigint, bucket bigint, sketch binary, codes array<bigint>")


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, bits: int | None = None, missed: float = MISSED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, label, embedding). bits: of a key; by the rows if not given."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    comparable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    own = rows.select("vec_id", "label", "embedding").select("vec_id", F.xxhash64("label", F.size("embedding")).alias("bucket"), F.when(comparable, F.xxhash64("label", F.size("embedding"), "embedding")).alias("id"), "embedding")
    reps = own.where("id IS NOT NULL").groupBy("id").agg(F.first("bucket").alias("bucket"), F.first("embedding").alias("vector"), F.count("*").alias("copies"))
    reps = stored(reps, "vectors")
    bits = bits or key_bits(reps.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1)
    tables = key_tables(bits, threshold, missed)
    sketches = stored(_sketches(reps, bits, tables), "sketches")

    keys = sketches.select("id", "bucket", F.posexplode("codes").alias("table", "code")).select("id", F.xxhash64("bucket", "table", "code").alias("key"))
    most = _most_signs(threshold, bits * tables)
    dealt = in_blocks(keys, "key", "id").join(sketches.select("id", "sketch"), "id")
    alike = sketch_edges(dealt, lambda a, b: np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= most)
    coarse = connected_components(alike, "id", "other")

    def linked(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
        x = np.stack([np.asarray(v, np.float64) for v in group.column("vector").to_pylist()])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        return group, x @ x.T >= threshold

    members = coarse.join(reps.select("id", "vector", "copies"), "id")
    links = verified_links(in_blocks(members, "root", "id"), linked)
    found = classes(links, reps.select("id", "copies")).withColumnRenamed("root", "class")
    named = stored(own.select("vec_id", "id").join(found, "id", "left").select("vec_id", "id", "n_links", "class"), "named")
    names = named.where("id IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("least"))
    component = F.coalesce(F.col("least"), F.col("vec_id"))
    return named.join(names, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))


#: Cosines from components divided by the largest, as the operator has them.
OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""
