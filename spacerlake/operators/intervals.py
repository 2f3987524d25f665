"""Joins of intervals: containment, exclusion, gaps and nearest neighbours.

A range join has an equality on its key and on bins of positions, so pairs meet in hash joins and never as all pairs of a key. Bins come in levels, each FACTOR times as
wide as the one below: an interval stands once, in the least bin that holds all of it, and a point is looked for in its bin of each level, of which there are at most LEVELS. So a long interval is
one row, however narrow the bins are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A level's bins are 2^FACTOR_BITS times as wide as those of the level below; the last level has one bin for all that no other holds whole.
FACTOR_BITS, LEVELS = 3, 20


def _bin(x: Column, width: int, level: int) -> Column:
    return F.lit(0).cast("bigint") if level == LEVELS else F.shiftright(F.floor(x / width).cast("bigint"), FACTOR_BITS * level)


def _placed(intervals: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Adds the level and bin of the least bin that holds an interval; intervals that end before they start hold nothing and go."""
    level, bin_ = F.lit(LEVELS), _bin(F.col(start), width, LEVELS)
    for k in reversed(range(LEVELS)):
        own = _bin(F.col(start), width, k)
        whole = own == _bin(F.col(end), width, k)
        level, bin_ = F.when(whole, k).otherwise(level), F.when(whole, own).otherwise(bin_)
    return intervals.where(F.col(start) <= F.col(end)).withColumns({"_level": level, "_bin": bin_})


def points_in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """points ⋈ intervals with equal keys and start <= at <= end; how: inner, left_semi or left_anti. width: of the least bins, best near the usual interval's length.

    Which levels occur is asked first, at most LEVELS + 1 numbers; points are looked for in these only. Semi and anti joins go from level to level, so a point is told once.
    """
    placed = _placed(intervals, start, end, width)
    levels = sorted(r["_level"] for r in placed.select("_level").distinct().collect())
    if how == "inner":
        bins = F.array(*(F.struct(F.lit(k).alias("_level"), _bin(F.col(at), width, k).alias("_bin")) for k in levels)) if levels else F.lit(None).cast("array<struct<_level:int,_bin:bigint>>")
        own = points.withColumn("_own", F.explode(bins)).alias("p")
        hit = (F.col(f"p.{key}") == F.col(f"i.{key}")) & (F.col("p._own._level") == F.col("i._level")) & (F.col("p._own._bin") == F.col("i._bin")) & F.col(f"p.{at}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
        return own.join(placed.alias("i"), hit).select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"i.{c}") for c in intervals.columns if c != key))
    rest, found = points, points.limit(0)
    for k in levels:
        hit = (F.col(f"p.{key}") == F.col(f"i.{key}")) & (_bin(F.col(f"p.{at}"), width, k) == F.col("i._bin")) & F.col(f"p.{at}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
        of_level = placed.where(F.col("_level") == k).alias("i")
        if how == "left_semi":
            found = found.unionByName(rest.alias("p").join(of_level, hit, "left_semi"))
        rest = rest.alias("p").join(of_level, hit, "left_anti")
    return found if how == "left_semi" else rest


def gaps_between(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, gap_ix, gap_start, gap_end): before, between and after the intervals of a key; the last has no end (null)."""
    w = Window.partitionBy(key).orderBy(start, end)
    ahead = intervals.select(key, F.row_number().over(w).alias("gap_ix"), F.lag(end, 1).over(w).alias("gap_start"), F.col(start).alias("gap_end"))
    last = intervals.groupBy(key).agg((F.count("*") + 1).cast("int").alias("gap_ix"), F.max_by(end, F.struct(start, end)).alias("gap_start")).withColumn("gap_end", F.lit(None))
    return ahead.unionByName(last.withColumn("gap_end", F.col("gap_end").cast(intervals.schema[start].dataType)))


def nearest_within(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_order: str, bound: int) -> DataFrame:
    """Each row of left with the nearest of right at most bound away (ties: least right_order), or nulls; adds distance.

    Bins are bound wide, so the nearest lies in a point's own bin or one beside it.
    """
    own = left.withColumn("_bin", F.explode(F.array(*(F.floor(F.col(left_at) / bound) + d for d in (-1, 0, 1)))))
    other = right.withColumn("_bin", F.floor(F.col(right_at) / bound))
    names = {c: f"_r_{c}" for c in right.columns}
    joined = own.join(other.withColumnsRenamed(names | {"_bin": "_rbin"}), (F.col(key) == F.col(f"_r_{key}")) & (F.col("_bin") == F.col("_rbin")))
    distance = F.abs(F.col(left_at) - F.col(f"_r_{right_at}"))
    best = joined.withColumn("distance", distance).where(F.col("distance") <= bound)
    found = best.groupBy(*left.columns).agg(F.min_by(F.struct("distance", *(F.col(f"_r_{c}").alias(c) for c in right.columns if c != key)), F.struct("distance", f"_r_{right_order}")).alias("near"))
    return left.join(found, left.columns, "left")


def nearest_interval(left: DataFrame, right: DataFrame, key: str, own: tuple[str, str], other: tuple[str, str], order: str, bound: int) -> DataFrame:
    """Each row of left with the nearest of right as near, or null: the distance is the lesser of start to the other's end and end to the other's start, at most bound.

    Ties go to the least of right's column order. Both distances are looked for in bins as wide as the bound.
    """
    sides = [(own[0], other[1]), (own[1], other[0])]
    probes = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(a).cast("bigint").alias("at"), (F.floor(F.col(a) / bound) + d).alias("bin")) for k, (a, _) in enumerate(sides) for d in (-1, 0, 1))))
    points = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(b).cast("bigint").alias("at"), F.floor(F.col(b) / bound).alias("bin")) for k, (_, b) in enumerate(sides))))
    kept = [c for c in right.columns if c != key]
    a = left.select(*left.columns, probes.alias("_p"))
    b = right.select(F.col(key).alias("_key"), F.struct(*kept).alias("_row"), points.alias("_q"))
    joined = a.join(b, (F.col(key) == F.col("_key")) & (F.col("_p.side") == F.col("_q.side")) & (F.col("_p.bin") == F.col("_q.bin"))).withColumn("distance", F.abs(F.col("_p.at") - F.col("_q.at")))
    near = F.min_by(F.struct("distance", "_row.*"), F.struct("distance", f"_row.{order}")).alias("near")
    return left.join(joined.where(F.col("distance") <= bound).groupBy(*left.columns).agg(near), left.columns, "left")


def with_scores(candidates: DataFrame, keys: list[str], tables: dict[str, DataFrame]) -> DataFrame:
    """Adds a column for each table (keys, score): the greatest score of the key, 0.0 without one. The tables are added up together, so there is one grouping and one join."""
    rows = None
    for name, table in tables.items():
        own = table.select(*keys, F.lit(name).alias("_name"), F.col("score").cast("double").alias("_score"))
        rows = own if rows is None else rows.unionByName(own)
    wide = rows.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_score"))).alias(name) for name in tables))
    return candidates.join(wide, keys, "left").fillna(0.0, list(tables))


def best_in_interval(intervals: DataFrame, points: DataFrame, key: str, interval_id: str, start: str, end: str, at: str, value: str, width: int) -> DataFrame:
    """(key, interval_id, best): the greatest value of the points in each interval, 0.0 without one."""
    # on the minus strand the places of points are to be turned first, as length minus end: see from_end
    hits = points_in_intervals(points.select(key, at, value), intervals.select(key, interval_id, start, end), key, at, start, end, width)
    best = hits.groupBy(key, interval_id).agg(F.max(value).alias("best"))
    return intervals.select(key, interval_id).join(best, [key, interval_id], "left").select(key, interval_id, F.coalesce("best", F.lit(0.0)).alias("best"))


def from_end(rows: DataFrame, start: str, end: str, length: Column, complement: Column) -> DataFrame:
    """Places that count along the strand read: where complement holds, start becomes length - end, and end length - start."""
    own, far = F.col(start), F.col(end)
    return rows.withColumns({start: F.when(complement, length - far).otherwise(own), end: F.when(complement, length - own).otherwise(far)})


def flanks(rows: DataFrame, key: str, start: str, end: str, flank: Column, far: Column) -> DataFrame:
    """Adds left_bound and right_bound: a whole flank towards a far neighbour, half the gap towards a near one, none where they overlap."""
    w = Window.partitionBy(key).orderBy(start, end)
    before, after = F.col(start) - F.lag(end).over(w), F.lead(start).over(w) - F.col(end)
    return rows.withColumns({"left_bound": F.col(start) - share_of_gap(before, flank, far), "right_bound": F.col(end) + share_of_gap(after, flank, far)})


def share_of_gap(gap: Column, flank: Column, far: Column) -> Column:
    return F.when(gap.isNull() | (gap > far), flank).when(gap <= 0, F.lit(0)).otherwise(F.floor(gap / 2))


def group_flanks(rows: DataFrame, key: str, group: list[str], start: str, end: str, counts: Column, flank: Column, far: Column) -> DataFrame:
    """Adds left_bound and right_bound of each row's group: the flanks of the groups' extents, of the rows that count; null for the others. Windows only, so rows are made once.

    A group's neighbours are the farthest end of those that begin before it and the nearest begin of those behind.
    """
    w = Window.partitionBy(*group)
    marked = rows.withColumns({"_first": F.when(counts, F.min(F.when(counts, F.col(start))).over(w)), "_last": F.when(counts, F.max(F.when(counts, F.col(end))).over(w))})
    ahead, behind = (Window.partitionBy(key).orderBy(o).rangeBetween(Window.unboundedPreceding, -1) for o in (F.asc("_first"), F.desc("_first")))
    near = marked.withColumns({"_before": F.col("_first") - F.max("_last").over(ahead), "_after": F.min("_first").over(behind) - F.col("_last")})
    return near.withColumns({"left_bound": F.col("_first") - share_of_gap(F.col("_before"), flank, far), "right_bound": F.col("_last") + share_of_gap(F.col("_after"), flank, far)}).drop("_first", "_last", "_before", "_after")
