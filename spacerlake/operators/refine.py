"""Refinement of candidate arrays: the consensus matched again, extension into the flanks, and letters that moved between repeat and spacer.

All keep the state of one array, a row; the consensus strings of a batch are matched in their flanks together (operators.matching).
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import Matches, match_all
from .search import dealt

#: Letters looked at in a step, added to the longest spacer, and around an array when it is matched again.
STEP, MARGIN, AROUND = 150, 30, 5
ARRAY = "struct<repeats:array<string>,spacers:array<string>,starts:array<int>>"


def rematched(found: Matches, seq: str, repeats: list[str], spacers: list[str], starts: list[int], around: int = AROUND) -> tuple[list[str], list[str], list[int]]:
    """The array as the consensus' matches in it and `around` letters on either side show it; as it was, if there are none."""
    hits = found.apart(max(0, starts[0] - around), starts[-1] + len(repeats[-1]) + around)
    if not hits:
        return list(repeats), list(spacers), list(starts)
    begins, ends = ([x[k] for k in hits] for x in found.lists[:2])
    return [seq[a:b] for a, b in zip(begins, ends, strict=True)], [seq[a:b] for a, b in zip(ends, begins[1:], strict=False)], begins


def extend(seq: str, consensus: str, repeats: list[str], spacers: list[str], starts: list[int], left: int, right: int, margin: int = MARGIN, found: Matches | None = None) -> tuple[list[str], list[str], list[int]]:
    """Adds copies of the consensus on either side while the best one of a step lies within reach: a spacer of the longest one's length and the margin more.

    left and right bound the search in the sequence; found: the consensus' matches in it.
    """
    repeats, spacers, starts = list(repeats), list(spacers), list(starts)
    found = match_all([seq], [[consensus]])[0][0] if found is None else found
    places, behind, _ = found.lists
    longest = max(map(len, spacers), default=0) + margin
    while True:
        end = starts[-1] + len(repeats[-1])
        k = found.best_within(end, min(right, end + STEP))
        if k is None or not 0 < places[k] - end <= longest:
            break
        at = places[k]
        spacers.append(seq[end:at])
        repeats.append(seq[at : behind[k]])
        starts.append(at)
    while True:
        k = found.best_within(max(left, starts[0] - STEP), starts[0])
        if k is None or not 0 < starts[0] - behind[k] <= longest:
            break
        at, end = places[k], behind[k]
        spacers.insert(0, seq[end : starts[0]])
        repeats.insert(0, seq[at:end])
        starts.insert(0, at)
    return repeats, spacers, starts


def suspicious(sizes: list[int]) -> list[int]:
    """The numbers of spacers whose two neighbours on each side (at the ends, those there are) agree in length, and differ from it; of at most two spacers, all."""
    if len(sizes) <= 2:
        return [*range(len(sizes))]
    found = []
    for k, own in enumerate(sizes):
        near = {0: sizes[1:3], 1: [sizes[0], sizes[2], *sizes[3:4]]}.get(k)
        if near is None:
            near = {1: sizes[-3:-1], 2: [*sizes[-4:-2], sizes[-1]]}.get(len(sizes) - k) or [*sizes[k - 2 : k], *sizes[k + 1 : k + 3]]
        if len({*near}) == 1 and near[0] != own:
            found.append(k)
    return found


@lru_cache(1 << 16)
def _edits(a: str, b: str) -> int:
    """The least edits between two strings; what they begin or end with in common needs none."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def settle(consensus: str, repeats: list[str], spacers: list[str], starts: list[int]) -> tuple[list[str], list[str], list[int]]:
    """Beside a suspicious spacer, gives an end letter of a repeat longer than the consensus back to the spacer, where this doesn't add edits: the array's total doesn't grow."""
    repeats, spacers, starts = list(repeats), list(spacers), list(starts)
    for k in suspicious([len(x) for x in spacers]):
        left, right = repeats[k], repeats[k + 1]
        if len(left) > len(consensus) and _edits(left[:-1], consensus) <= _edits(left, consensus):
            repeats[k], spacers[k] = left[:-1], left[-1] + spacers[k]
        if len(right) > len(consensus) and _edits(right[1:], consensus) <= _edits(right, consensus):
            repeats[k + 1], spacers[k], starts[k + 1] = right[1:], spacers[k] + right[0], starts[k + 1] + 1
    return repeats, spacers, starts


def _refined(rows: pd.DataFrame) -> pd.DataFrame:
    flanks: dict[str, dict[str, int]] = {}  # arrays of one region have one flank
    for flank, consensus in zip(rows["flank"], rows["consensus"], strict=True):
        if flank is not None:
            own = flanks.setdefault(flank, {})
            own.setdefault(consensus, len(own))
    matches = dict(zip(flanks, match_all(list(flanks), [list(x) for x in flanks.values()]), strict=True))
    out = []
    for r in rows.itertuples(index=False):
        if r.flank is None:
            out.append((list(r.repeats), list(r.spacers), list(r.starts)))
            continue
        found, shift = matches[r.flank][flanks[r.flank][r.consensus]], int(r.flank_start)
        own = rematched(found, r.flank, r.repeats, r.spacers, [int(x) - shift for x in r.starts])
        repeats, spacers, starts = settle(r.consensus, *extend(r.flank, r.consensus, *own, int(r.left), int(r.right), found=found))
        out.append((repeats, spacers, [x + shift for x in starts]))
    return pd.DataFrame(out, columns=["repeats", "spacers", "starts"])


def refine(arrays: DataFrame) -> DataFrame:
    """Replaces repeats, spacers and starts of rows (consensus, flank, flank_start, left, right, repeats, spacers, starts): flank is the sequence around, from flank_start; left and right bound the extension in it. Rows without a flank stay as they are."""
    own = F.struct("consensus", "flank", F.col("flank_start").cast("int").alias("flank_start"), "left", "right", "repeats", "spacers", "starts")
    found = dealt(arrays, "flank", F.right("consensus", F.lit(8))).withColumn("_found", F.pandas_udf(_refined, ARRAY)(own))
    rest = [c for c in arrays.columns if c not in ("repeats", "spacers", "starts")]
    return found.select(*rest, "_found.repeats", "_found.spacers", "_found.starts")
