"""Ranking of candidates, fallbacks, and routing into categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BONA_FIDE, ALTERNATIVE, POSSIBLE, DISCARDED, LOW = "bona_fide", "alternative", "possible", "possible_discarded", "low_score"
ORDER = [BONA_FIDE, ALTERNATIVE, POSSIBLE, DISCARDED, LOW]


def best_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def filter_or_best(rows: DataFrame, keys: list[str], passes: Column, order: list[Column]) -> DataFrame:
    """Rows that pass; of a key without any, the first in order."""
    w = Window.partitionBy(*keys)
    marked = rows.withColumns({"_passes": F.coalesce(passes, F.lit(False)), "_rank": F.row_number().over(w.orderBy(*order))})
    return marked.withColumn("_any", F.max("_passes").over(w)).where("_passes OR (NOT _any AND _rank = 1)").drop("_passes", "_rank", "_any")


def route(rows: DataFrame, region: list[str], score: str, passes: str, tie: str, high: float = 0.75, middle: float = 0.6, low: float = 0.5, keep_all: bool = False) -> DataFrame:
    """Adds category. Of a region's candidates of `high` or more that pass, the best is bona fide and the others are alternatives.

    Where there is a bona fide one, those of `middle` or more are alternatives, and those from `low` to `middle` are dropped
    (kept as low_score with keep_all). Elsewhere the best of `low` or more is possible if it passes, else low_score, and the others are
    possible_discarded. Candidates that should pass and don't, and those below `low`, are low_score.
    """
    w = Window.partitionBy(*region)
    strong = (F.col(score) >= high) & F.col(passes)
    between = (F.col(score) >= low) & (F.col(score) < high)
    ranked = rows.withColumn("_strong", F.when(strong, 1).otherwise(0)).withColumn("_between", F.when(between, 1).otherwise(0))
    best = [F.desc(score), F.col(tie)]
    ranked = ranked.withColumns({
        "_any": F.max("_strong").over(w), "_first": F.row_number().over(Window.partitionBy(*region, "_strong").orderBy(*best)),
        "_first_between": F.row_number().over(Window.partitionBy(*region, "_between").orderBy(*best)),
    })
    has, good = F.col("_any") == 1, F.col(passes)
    category = (
        F.when(strong, F.when(F.col("_first") == 1, BONA_FIDE).otherwise(ALTERNATIVE))
        .when(F.col(score) >= high, LOW)
        .when(between & has & (F.col(score) >= middle), F.when(good, ALTERNATIVE).otherwise(LOW))
        .when(between & has, LOW if keep_all else None)
        .when(between & (F.col("_first_between") == 1), F.when(good, POSSIBLE).otherwise(LOW))
        .when(between, DISCARDED)
        .otherwise(LOW)
    )
    return ranked.withColumn("category", category).where("category IS NOT NULL").drop("_strong", "_between", "_any", "_first", "_first_between")


def refiltered(rows: DataFrame, passes: Column) -> DataFrame:
    """After refinement, what no longer passes is low_score; scores stay."""
    return rows.withColumn("category", F.when(passes, F.col("category")).otherwise(F.lit(LOW)))


def region_index(rows: DataFrame, contig: str, start: str, end: str) -> DataFrame:
    """Adds region_index from 1: regions with bona fide arrays first, by place, then those with possible, discarded and low ones."""
    rank = F.when(F.col("category").isin(BONA_FIDE, ALTERNATIVE), 0).when(F.col("category") == POSSIBLE, 1).when(F.col("category") == DISCARDED, 2).otherwise(3)
    best = F.min(rank).over(Window.partitionBy(contig, start, end))
    return rows.withColumn("_best", best).withColumn("region_index", F.dense_rank().over(Window.partitionBy(contig).orderBy("_best", start, end))).drop("_best")
