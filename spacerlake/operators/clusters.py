"""Clusters of repeat pairs: islands, merging of neighbours, windows around them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLUSTER_GAP, FLANK = 100, 100


def islands(rows: DataFrame, keys: list[str], order: list[str], starts_new: Column, name: str) -> DataFrame:
    """Numbers runs of rows from 1: a row starts a new one where starts_new holds, and at the first row of its keys.

    starts_new may use lag() over the same window; null counts as false.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).when(starts_new, 1).otherwise(0))
    return marked.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def number_pairs(pairs: DataFrame, gap: int = CLUSTER_GAP) -> DataFrame:
    """A new cluster starts gap or more bases after the pair before."""
    w = Window.partitionBy("contig_id").orderBy("begin_first")
    return islands(pairs, ["contig_id"], ["begin_first"], F.col("begin_first") - F.lag("begin_first").over(w) >= gap, "cluster_id")


def cluster_summary(numbered: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """(contig_id, cluster_id, begin, end, n_pairs, repeats): end is the last pair's end; repeats are the different ones, sorted.

    Pairs and sequences meet on contig_id.
    """
    whole = numbered.join(contigs.select("contig_id", "seq"), "contig_id").withColumn("repeat", F.expr(f"substring(seq, cast(begin_first AS int) + 1, {k})"))
    return whole.groupBy("contig_id", "cluster_id").agg(
        F.min("begin_first").alias("begin"), (F.max_by("begin_second", "begin_first") + k).alias("end"),
        F.count("*").alias("n_pairs"), F.array_sort(F.collect_set("repeat")).alias("repeats"),
    )


def cluster_windows(clusters: DataFrame, contigs: DataFrame, flank: int = FLANK) -> DataFrame:
    """Adds window_start, window_end, window and wraps: the cluster with its flanks, inside the contig, and whether its end lies beyond it. Clusters that begin beyond it are dropped."""
    joined = clusters.join(contigs.select("contig_id", "seq"), "contig_id").where(F.col("begin") < F.length("seq"))
    start = F.greatest(F.col("begin") - flank, F.lit(0))
    end = F.least(F.col("end") + flank, F.length("seq").cast("bigint"))
    return joined.withColumns({"window_start": start, "window_end": end, "wraps": F.col("end") > F.length("seq")}).withColumn("window", F.expr("substring(seq, cast(window_start AS int) + 1, cast(window_end - window_start AS int))")).drop("seq")


#: The gaps and sizes of the rule below.
NEAR_GAP, FAR_GAP, SIZES_OF_ONE, SIZES_OF_MORE = 100, 500, [(0, 160)], [(1, 160), (2, 180)]


def _absorbs(left: dict, right: dict) -> bool:
    """Whether the cluster on the left takes in its right neighbour."""
    gap = right["begin"] - left["end"]
    if gap <= 0 or gap < NEAR_GAP and set(left["repeats"]) & set(right["repeats"]):
        return True
    if gap >= FAR_GAP:
        return False
    between = right["before"][-gap:]
    tests = SIZES_OF_ONE + (SIZES_OF_MORE if right["n_pairs"] > 3 else [])
    cores = [(right["repeats"][at][3:-3], size) for at, size in tests if at < len(right["repeats"])]
    return any(core and between.count(core) >= max(1, gap / size) for core, size in cores)


def merge_neighbours(clusters: DataFrame, contigs: DataFrame) -> DataFrame:
    """Merges neighbouring clusters of a contig until no two merge; a merge tests the new cluster's left neighbour again.

    A cluster carries the FAR_GAP letters before it, which is all of the sequence that the rule looks at; state is one contig's clusters at a time.
    """

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        done: list[dict] = []
        for row in rows.sort_values(["begin", "end"]).to_dict("records"):
            new = {**row, "repeats": list(row["repeats"])}
            while done and _absorbs(done[-1], new):
                old = done.pop()
                new = {**old, "end": max(old["end"], new["end"]), "n_pairs": old["n_pairs"] + new["n_pairs"], "repeats": sorted({*old["repeats"], *new["repeats"]})}
            done.append(new)
        return pd.DataFrame(done)[["contig_id", "cluster_id", "begin", "end", "n_pairs", "repeats"]]

    first = F.greatest(F.col("begin") - FAR_GAP, F.lit(0))
    cut = F.substr("seq", (first + 1).cast("int"), (F.col("begin") - first).cast("int"))
    whole = clusters.join(contigs.select("contig_id", "seq"), "contig_id").select("contig_id", "cluster_id", "begin", "end", "n_pairs", "repeats", F.coalesce(cut, F.lit("")).alias("before"))
    return whole.groupBy("contig_id").applyInPandas(merge, "contig_id bigint, cluster_id bigint, begin bigint, end bigint, n_pairs bigint, repeats array<string>")


def summary_of(numbered: DataFrame) -> DataFrame:
    """(contig_id, cluster_id, begin, end, n_pairs, repeats) of numbered maximal pairs, which carry their repeats: no sequence is needed. end is that of the last pair's second copy."""
    last = F.struct("begin_first", "begin_second", "length_second")
    return numbered.groupBy("contig_id", "cluster_id").agg(
        F.min("begin_first").alias("begin"), F.max_by(F.col("begin_second") + F.col("length_second"), last).alias("end"), F.count("*").alias("n_pairs"), F.array_sort(F.collect_set("repeat")).alias("repeats"),
    )
