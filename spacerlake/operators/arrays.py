"""Candidate arrays: rows with repeats and spacers as arrays of strings. Features and filters, all in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


@dataclass(frozen=True)
class Limits:
    """Bounds of the array filters; `compatible` takes the mean spacer's upper bound from the repeats, over spacers without the outer two."""

    min_repeats: int = 3
    min_repeat: float = 21
    max_repeat: float = 55
    min_spacer: float = 18
    max_spacer: float = 78
    long_spacer: int = 140
    long_share: float = 0.3
    long_most: int = 3
    edge_share: float = 0.8
    most_equal: int = 4
    most_in_row: int = 3
    compatible: bool = False


def features(arrays: DataFrame) -> DataFrame:
    """Adds the numbers that scores are made from: repeats and spacers are array<string>."""
    repeats, spacers = F.col("repeats"), F.col("spacers")
    told = F.when(F.element_at(spacers, -1) == "", F.slice(spacers, 1, F.size(spacers) - 1)).otherwise(spacers)
    shown = F.when(F.size(spacers) > 0, told).otherwise(spacers)
    return arrays.withColumns({
        "number_repeats": F.size(repeats), "repeat_len": F.coalesce(F.array_max(F.transform(repeats, F.length)), F.lit(0)),
        "avg_spacer_len": F.coalesce(S.mean_length(shown), F.lit(0.0)), "at_richness": S.at_richness(F.array_join(repeats, "")),
        "spacer_evenness": S.evenness(F.transform(spacers, F.length)),
    })


def checks(limits: Limits = Limits()) -> dict[str, Column]:
    """The filters of one array, by name. A null counts as a failure."""
    repeats, spacers = F.col("repeats"), F.col("spacers")
    long_ = F.size(F.filter(spacers, lambda x: F.length(x) > limits.long_spacer))
    filled = F.filter(spacers, lambda x: x != "")
    mean_spacer, mean_repeat = S.mean_length(spacers), S.mean_length(repeats)
    if limits.compatible:
        inner = F.when(F.size(spacers) > 4, F.slice(spacers, 2, F.size(spacers) - 2)).otherwise(spacers)
        upper = F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)) / F.size(spacers) <= limits.max_repeat
    else:
        upper = mean_spacer <= limits.max_spacer
    conserved = [S.mode_share(F.transform(filled, edge)) for edge in (lambda x: F.substring(x, 1, 1), lambda x: F.substring(x, -1, 1))]
    equal = S.longest_run(F.array_sort(filled))  # equal ones stand together
    few_equal = F.lit(True) if not limits.most_equal else F.coalesce(equal, F.lit(0)) <= limits.most_equal
    few_in_row = F.lit(True) if not limits.most_in_row else S.longest_run(filled) <= limits.most_in_row
    found = {
        "min_repeats": F.size(repeats) >= limits.min_repeats, "repeat_max": mean_repeat <= limits.max_repeat, "repeat_min": mean_repeat >= limits.min_repeat,
        "spacer_min": mean_spacer > limits.min_spacer, "spacer_max": upper,
        "long_spacers": (F.size(spacers) == 0) | ((long_ <= limits.long_most) & (long_ <= limits.long_share * F.size(spacers))),
        "spacer_edges": (F.size(filled) < 2) | ((conserved[0] <= limits.edge_share) & (conserved[1] <= limits.edge_share)), "equal_spacers": few_equal & few_in_row,
    }
    return {name: F.coalesce(check, F.lit(False)) for name, check in found.items()}


def passes(limits: Limits = Limits()) -> Column:
    both = F.lit(True)
    for check in checks(limits).values():
        both = both & check
    return both


def reversed_array(arrays: DataFrame) -> DataFrame:
    """The array read on the other strand; start and end stay in the contig's order."""
    turn = {c: F.reverse(F.transform(c, S.reverse_complement)) for c in ("repeats", "spacers")}
    return arrays.withColumns(turn)


def neighbour_outliers(spacers: DataFrame, keys: list[str], at: str, length: str) -> DataFrame:
    """Adds suspicious: a spacer whose two neighbours on each side (at the ends, the two on the one side there are) agree in length, and differ from it.

    In arrays of at most two spacers every spacer is suspicious.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(at)
    l1, l2, r1, r2 = (f(length, n).over(w) for f, n in ((F.lag, 1), (F.lag, 2), (F.lead, 1), (F.lead, 2)))
    own, n = F.col(length), F.count("*").over(Window.partitionBy(*keys))
    around = F.when(l2.isNotNull() & r2.isNotNull(), (l1 == l2) & (l1 == r1) & (l1 == r2) & (own != l1))
    at_start = F.when(l1.isNull(), (r1 == r2) & (own != r1)).when(l2.isNull(), (l1 == r1) & (r1 == F.coalesce(r2, r1)) & (own != r1))
    at_end = F.when(r1.isNull(), (l1 == l2) & (own != l1)).when(r2.isNull(), (l1 == l2) & (l1 == r1) & (own != l1))
    return spacers.withColumn("suspicious", F.when(n <= 2, True).otherwise(F.coalesce(around, at_start, at_end, F.lit(False))))


def surroundings(arrays: DataFrame, contigs: DataFrame, size: int = 200) -> DataFrame:
    """Adds leader and downstream: `size` bases before and behind (start, end), or less at the contig's ends; on the reverse strand the other way round and complemented."""
    joined = arrays.join(contigs.select("contig_id", "seq"), "contig_id")
    before = F.expr(f"substring(seq, cast(greatest(start - {size}, 0) AS int) + 1, cast(start - greatest(start - {size}, 0) AS int))")
    behind = F.expr(f"substring(seq, cast(end AS int) + 1, {size})")
    forward = F.col("strand") == "Forward"
    return joined.withColumns({
        "leader": F.when(forward, before).otherwise(S.reverse_complement(behind)), "downstream": F.when(forward, behind).otherwise(S.reverse_complement(before)),
    }).drop("seq")


def repeat_intervals(parts: DataFrame, keys: list[str], at: str, repeat: str, spacer: str) -> DataFrame:
    """(keys, at, start, end) of each repeat within its array, from rows with a repeat and the spacer behind it: running sums of their lengths."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce(repeat, F.lit("")))
    start = F.coalesce(F.sum(size + F.length(F.coalesce(spacer, F.lit("")))).over(w), F.lit(0)).cast("bigint")
    return parts.select(*keys, at, start.alias("start"), (start + size).alias("end"))
