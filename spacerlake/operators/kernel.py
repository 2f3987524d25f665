"""Similarity of the sequences of a group by a neighbourhood kernel.

A sequence is a path. Two of its places at a distance of up to DISTANCE, seen with everything within a RADIUS of each,
are a feature; so is each of the two alone at that distance. A neighbourhood is the letters at each step to both sides, unordered, so a sequence and its
reversal are the same. Counts have unit norm within each radius and distance, and overall. The mean similarity of n different sequences is then
(|sum of vectors|^2 - n) / (n^2 - n): one sum for each feature, and no pairs of sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS, DISTANCE = 3, 4
END = "$"


def _around(radius: int, most: int) -> Column:
    """What each place of a sequence sees within the radius; `padded` has `most` ends on both sides."""
    pairs = ", ".join(f"least(padded[k - {step}], padded[k + {step}]), greatest(padded[k - {step}], padded[k + {step}])" for step in range(radius + 1))
    return F.expr(f"if(n > 0, transform(sequence({most}, n - 1 + {most}), k -> concat({pairs})), cast(array() AS array<string>))")


def _features(radius: int, distance: int) -> Column:
    tag, seen = f"{radius}/{distance}", f"seen_{radius}"
    if distance == 0:
        made = f"array(named_struct('g', '{tag}', 'f', concat('P', {seen}[i], '-', {seen}[i]), 'w', 1), named_struct('g', '{tag}', 'f', concat('H', {seen}[i]), 'w', 1))"
    else:
        a, b = f"{seen}[i]", f"{seen}[i + {distance}]"
        made = (
            f"array(named_struct('g', '{tag}', 'f', concat('P', least({a}, {b}), '-', greatest({a}, {b})), 'w', 2), "
            f"named_struct('g', '{tag}', 'f', concat('H', {a}), 'w', 1), named_struct('g', '{tag}', 'f', concat('H', {b}), 'w', 1))"
        )
    none = "cast(array() AS array<array<struct<g:string,f:string,w:int>>>)"
    return F.expr(f"if(n > {distance}, transform(sequence(0, n - 1 - {distance}), i -> {made}), {none})")


def vectors(rows: DataFrame, keys: list[str], seq: str, radius: int = RADIUS, distance: int = DISTANCE) -> DataFrame:
    """(keys, seq_id, feature, value) of each row, of unit norm; seq_id tells a group's sequences apart."""
    own = rows.select(*keys, F.col(seq).alias("seq_id"), F.filter(F.split(seq, ""), lambda c: c != "").alias("cs")).withColumn("n", F.size("cs"))
    # a short row makes a thousand: dealt out by number, not by bytes
    own = own.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "seq_id")
    ends = F.array_repeat(F.lit(END), radius)
    own = own.withColumn("padded", F.concat(ends, "cs", ends)).withColumns({f"seen_{r}": _around(r, radius) for r in range(radius + 1)})
    lists = F.flatten(F.concat(*(_features(r, d) for r in range(radius + 1) for d in range(distance + 1))))
    counts = own.select(*keys, "seq_id", "n", F.explode(lists).alias("x")).groupBy(*keys, "seq_id", "n", "x.g", "x.f").agg(F.sum("x.w").cast("double").alias("count"))
    norm = F.sqrt(F.sum(F.col("count") * F.col("count")).over(Window.partitionBy(*keys, "seq_id", "g")))
    groups = F.sqrt((radius + 1) * F.least(F.col("n"), F.lit(distance + 1)).cast("double"))  # the distances that a sequence has
    return counts.select(*keys, "seq_id", F.concat_ws(":", "g", "f").alias("feature"), (F.col("count") / norm / groups).alias("value"))


def mean_similarity(rows: DataFrame, keys: list[str], seq: str, radius: int = RADIUS, distance: int = DISTANCE) -> DataFrame:
    """(keys, n_sequences, similarity) of each group's different, non-empty sequences; 1 for a single one."""
    own = rows.where(F.length(seq) > 0).select(*keys, seq).distinct()
    sums = vectors(own, keys, seq, radius, distance).groupBy(*keys, "feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("own"))
    # a vector's squares add up to 1, so all squares add up to the number of sequences
    totals = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.round(F.sum("own")).cast("bigint").alias("n_sequences"))
    n = F.col("n_sequences")
    return totals.select(*keys, "n_sequences", F.when(n == 1, 1.0).otherwise((F.col("q") - n) / (n * n - n)).alias("similarity"))
