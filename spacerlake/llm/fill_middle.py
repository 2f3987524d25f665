"""Fill-in-middle: texts cut at two random places and put in another order, the cuts found by a learned rank index.

A text's boundaries are the byte offsets of its code points and of its end. A rank index holds them as straight segments (first rank, first
offset, slope), each within ERROR bytes of every boundary in it, and a residual of one byte for each boundary, so that a
predicted offset plus its residual is the exact one. A cut asks for the offsets of two ranks; no text is decoded. Segments are grown as cones: between
two changes of width the boundaries are a line, so only the places where the width changes bound a cone. A text is indexed PIECE bytes
at a time, so besides its bytes a task holds a byte for each code point.

What depends on chance comes from the sha256 of `1:` and the decimal doc_id: no state, and the same on every run.

Defined results: a null text is empty; an empty text, and one that holds a marker, stays plain, as does a share of the others; a null
doc_id counts as the empty string in the hash; rows are formatted one by one, so repeated ones give equal outputs; an empty table gives no rows; other columns are
ignored unless asked for with keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Of 100: texts that stay plain, and of the others those with the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20
ERROR = 120
PIECE = 1 << 20
#: Changes of width looked at together while a cone is grown, at first.
LOOK = 64


@dataclass
class RankIndex:
    """Byte offsets by rank: segment k starts at rank first[k] and offset base[k] and rises by slope[k]; residuals make predictions exact."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residuals: np.ndarray

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        ranks = np.asarray(ranks, np.int64)
        k = np.searchsorted(self.first, ranks, side="right") - 1
        return _predicted(self.base[k], self.slope[k], ranks - self.first[k]) + self.residuals[ranks]


def _predicted(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return base + np.rint(slope * steps).astype(np.int64)


def _segments(ranks: np.ndarray, offsets: np.ndarray, error: int) -> list[tuple[int, int, float]]:
    """(rank, offset, slope) of the segments over knots of a line of straight pieces: from each start as far as one slope stays within error of all knots."""
    found, at = [], 0
    last = len(ranks) - 1
    while True:
        low, high, end, look = 0.0, np.inf, at, LOOK
        while end < last:
            x, y = (v[end + 1 : end + 1 + look] - v[at] for v in (ranks, offsets))
            lows = np.maximum(low, np.maximum.accumulate((y - error) / x))
            highs = np.minimum(high, np.minimum.accumulate((y + error) / x))
            fits = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(x)
            if fits:
                low, high, end = lows[fits - 1], highs[fits - 1], end + fits
            if fits < len(x):
                break
            look *= 2
        found.append((int(ranks[at]), int(offsets[at]), float((low + high) / 2) if end > at else 1.0))
        if end >= last:
            return found
        at = end


def rank_index(data: bytes | memoryview | np.ndarray, error: int = ERROR, piece: int = PIECE) -> RankIndex:
    """The index of the boundaries of UTF-8 text; error is at most 126, so that residuals take one byte."""
    bytes_ = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    segments: list[tuple[int, int, float]] = []
    residuals, done = [], 0
    for at in range(0, len(bytes_), piece):
        starts = np.flatnonzero((bytes_[at : at + piece] & 0xC0) != 0x80) + at
        if not len(starts):
            continue
        turns = np.flatnonzero(np.diff(starts, n=2)) + 1  # the widths before and after differ
        knots = np.unique(np.concatenate([[0], turns, [len(starts) - 1]]))
        own = _segments(knots, starts[knots], error)
        first, base, slope = (np.array(v) for v in zip(*own, strict=True))
        ranks = np.arange(len(starts))
        k = np.searchsorted(first, ranks, side="right") - 1
        residuals.append((starts - _predicted(base[k], slope[k], ranks - first[k])).astype(np.int8))
        segments += [(a + done, b, s) for a, b, s in own]
        done += len(starts)
    segments.append((done, len(bytes_), 1.0))  # the end of the text
    residuals.append(np.zeros(1, np.int8))
    first, base, slope = zip(*segments, strict=True)
    return RankIndex(np.array(first, np.int64), np.array(base, np.int64), np.array(slope, np.float64), np.concatenate(residuals))


def _hashed(doc_id: str | Column) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row, and the columns of keep."""
    own = F.coalesce(F.col(text), F.lit(""))
    h = _hashed(doc_id)
    n = F.length(own).cast("bigint")
    marked = F.contains(own, F.lit(PREFIX)) | F.contains(own, F.lit(SUFFIX)) | F.contains(own, F.lit(MIDDLE))
    form = F.when((n == 0) | marked | (h[2] % 100 >= 100 - PLAIN_SHARE), PLAIN).when(h[3] % 100 < SPM_SHARE, SPM).otherwise(PSM)
    cuts = [x % (n + 1) for x in h[:2]]
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), n.alias("n"), form.alias("form"), F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"), own.alias("text"), *(F.col(c).alias(f"_{c}") for c in keep))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms, low, high = (batch.column(k).to_pylist() for k in (2, 3, 4))
            outputs = []
            for k, whole in enumerate(batch.column(5).cast(pa.binary())):
                data = memoryview(whole.as_buffer())
                if forms[k] == PLAIN:
                    outputs.append(bytes(data))
                    continue
                a, b = rank_index(data).offsets([low[k], high[k]])
                prefix, middle, suffix = data[:a], data[a:b], data[b:]
                parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if forms[k] == SPM else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
                outputs.append(b"".join(x.encode() if isinstance(x, str) else x for x in parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(outputs, pa.binary()).cast(pa.string()), *batch.columns[6:]], names=["doc_id", "n", "form", "low", "high", "output", *(f"_{c}" for c in keep)])

    extra = "".join(f", `_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    done = rows.mapInArrow(cut, f"doc_id bigint, n bigint, form string, low bigint, high bigint, output string{extra}")
    moved = F.col("form") != PLAIN
    return done.select("doc_id", "n", "form", F.when(moved, F.col("low")).alias("prefix_chars"), F.when(moved, F.col("high") - F.col("low")).alias("middle_chars"), "output", *(F.col(f"_{c}").alias(c) for c in keep))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from, from the output and its form: markers stand in it once each, as texts that hold one stay plain."""
    o, n = F.col(output), len(PREFIX)
    first, second = F.when(F.col(form) == SPM, PREFIX).otherwise(SUFFIX), F.lit(MIDDLE)
    rest = F.substr(o, F.lit(n + 1))
    one = F.substring_index(rest, SUFFIX, 1)
    one = F.when(F.col(form) == SPM, F.substring_index(rest, PREFIX, 1)).otherwise(one)
    behind = F.substr(rest, F.instr(rest, first) + n)
    two = F.substring_index(behind, MIDDLE, 1)
    three = F.substr(behind, F.instr(behind, second) + n)
    return F.when(F.col(form) == PLAIN, o).when(F.col(form) == SPM, F.concat(two, three, one)).otherwise(F.concat(one, three, two))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


_H = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, len(t) AS n, {_H} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, t[1:a] AS p, t[a + 1:b] AS m, t[b + 1:] AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
