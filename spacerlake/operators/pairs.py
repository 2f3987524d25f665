"""Repeats of a contig: pairs of equal or nearly equal k-mers close to each other.

A contig is a row and its pairs lie inside it, so no shuffle is needed: each task works on the contigs it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, NEAREST, FARTHEST = 21, 11, 121
#: Of maximal pairs: letters between the first copy's end and the second's begin, letters from begin to begin, and letters of a copy that are searched for.
GAP, REACH, LONGEST = (-10, 100), 300, 55
#: Letters of short contigs that are looked at together.
TOGETHER = 1 << 19
PAIRS = "contig_id bigint, begin_first bigint, begin_second bigint"
_CODES = np.full(256, -1, np.int64)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def kmer_codes(seq: str, k: int) -> np.ndarray:
    """Two bits a base; -1 where the k-mer holds another letter. k is at most 31."""
    data = _CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    n = max(0, len(data) - k + 1)
    if not n:
        return np.zeros(0, np.int64)
    odd = np.concatenate([[0], np.cumsum(data < 0)])
    own, size, codes, done = np.maximum(data, 0), 1, np.zeros(len(data), np.int64), 0
    while size <= k:  # codes of 1, 2, 4, ... bases, put together by the bits of k
        if k & size:
            codes = (codes[: len(own) - done if done else None] << 2 * size | own[done : done + len(codes)]) if done else own
            done += size
        own = own[:-size] << 2 * size | own[size:]
        size *= 2
    return np.where(odd[k : k + n] > odd[:n], -1, codes[:n])


def repeat_pairs(contigs: DataFrame, k: int = K, nearest: int = NEAREST, farthest: int = FARTHEST) -> DataFrame:
    """(contig_id, begin_first, begin_second), 0-based: each k-mer of (contig_id, seq) and its next copy, if that starts nearest to farthest bases on."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = kmer_codes(seq or "", k)
                order = np.argsort(codes, kind="stable")
                first, second = order[:-1], order[1:]
                ok = (codes[first] == codes[second]) & (codes[first] >= 0) & (second - first >= nearest) & (second - first <= farthest)
                first, second = first[ok], second[ok]
                yield pa.RecordBatch.from_arrays([pa.array([contig] * len(first), pa.int64()), pa.array(first), pa.array(second)], names=["contig_id", "begin_first", "begin_second"])

    return contigs.select("contig_id", "seq").mapInArrow(pairs, PAIRS)


MAXIMAL = "contig_id bigint, begin_first bigint, begin_second bigint, length_first int, length_second int, edits int, repeat string"


class _Runs:
    """Maximal runs of equal letters on the diagonals 1 to reach (first begin, end, diagonal), of `size` letters or more, sorted by diagonal and begin; none goes over a border."""

    def __init__(self, seq: str, size: int, reach: int, borders: np.ndarray):
        self.data, self.size, self.n = _CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)], size, len(seq)
        codes = kmer_codes(seq, size)
        order, step, found = np.argsort(codes, kind="stable"), 1, [np.zeros((2, 0), np.int64)]
        going = np.flatnonzero(codes[order] >= 0)
        while len(going := going[going + step < len(order)]):  # copies of a seed, the next, the one after it, ... of those that had all before in reach
            a, b = order[going], order[going + step]
            near = (codes[a] == codes[b]) & (b - a <= reach)
            going = going[near]
            found.append(np.stack([a[near], (b - a)[near]]))
            step += 1
        at, diagonal = np.concatenate(found, axis=1)
        inside = np.searchsorted(borders, at, side="right") == np.searchsorted(borders, at + diagonal, side="right")
        at, diagonal = at[inside], diagonal[inside]
        self.width = self.n + 2
        keys = np.sort(diagonal * self.width + at)
        first = np.flatnonzero(np.diff(keys, prepend=-2) != 1)
        self.keys = keys[first]
        self.diagonal, self.begin = np.divmod(self.keys, self.width)
        lengths = np.diff(np.append(first, len(keys)))
        self.end = self.begin + lengths - 1 + size

    def alike(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many letters are equal from the places x and y on (step 1), or up to before them (step -1)."""
        n, going, shift = np.zeros(len(x), np.int64), y > x, min(step, 0)
        for _ in range(self.size):
            a, b = x + step * n + shift, y + step * n + shift
            inside = going & (a >= 0) & (b < self.n)
            own, other = self.data[np.where(inside, a, 0)], self.data[np.where(inside, b, 0)]
            going = inside & (own == other) & (own >= 0)
            n += going
        if going.any():  # these are inside a run
            at = x[going] + shift
            run = np.searchsorted(self.keys, (y - x)[going] * self.width + at, side="right") - 1
            n[going] = self.end[run] - at if step > 0 else at + 1 - self.begin[run]
        return n


def grown_pairs(seq: str, least: int = K, gap: tuple[int, int] = GAP, reach: int = REACH, borders: np.ndarray | None = None) -> np.ndarray:
    """Rows (begin_first, begin_second, length_first, length_second, edits): what maximal_pairs tells of one sequence, or of several with two letters that equal nothing between them, which begin at the borders."""
    if len(seq) < least:
        return np.zeros((0, 5), np.int64)
    runs = _Runs(seq, max(1, (least - 1) // 2), reach + 1, np.zeros(1, np.int64) if borders is None else borders)
    s, e, d, size = runs.begin, runs.end, runs.diagonal, runs.end - runs.begin
    zero = np.zeros(len(s), np.int64)
    grown = [(s, s + d, size, size, zero, zero + 1)]
    # a letter replaced, one more in the second copy, one more in the first: behind the run, then before it
    for more_first, more_second in ((1, 1), (0, 1), (1, 0)):
        n = runs.alike(e + more_first, e + d + more_second, 1)
        grown.append((s, s + d, size + more_first + n, size + more_second + n, zero + 1, n))
        n = runs.alike(s - more_first, s + d - more_second, -1)
        grown.append((s - more_first - n, s + d - more_second - n, size + more_first + n, size + more_second + n, zero + 1, n))
    rows = np.stack([np.stack(g) for g in grown])  # way x value x run
    first, second, one, two, _, n = rows.transpose(1, 0, 2)
    between = second - first - one
    good = (n > 0) & (np.minimum(one, two) >= least) & (between >= gap[0]) & (between <= gap[1]) & (second - first >= 1) & (second - first <= reach)
    total = np.where(good, one + two, -1)
    way = total.argmax(axis=0)
    run = np.flatnonzero(total.max(axis=0, initial=-1) > 0) if len(s) else zero
    return np.unique(rows[way[run], :5, run], axis=0) if len(run) else np.zeros((0, 5), np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[tuple[list, list[str]]]:
    """(names, sequences) of contigs of about so many letters together, as short ones are not worth a kernel's calls each."""
    names, seqs, size = [], [], 0
    for batch in batches:
        for name, seq in zip(batch.column(0), batch.column(1), strict=True):
            names.append(name.as_py())
            seqs.append(seq.as_py() or "")
            size += len(seqs[-1])
            if size >= most:
                yield names, seqs
                names, seqs, size = [], [], 0
    if names:
        yield names, seqs


def maximal_pairs(contigs: DataFrame, least: int = K, gap: tuple[int, int] = GAP, reach: int = REACH, longest: int = LONGEST) -> DataFrame:
    """(contig_id, begin_first, begin_second, length_first, length_second, edits, repeat): repeats that can't be longer with at most one edit.

    Of two copies of `least` letters with one edit, (least - 1) // 2 letters on one side of it are equal; such seeds, chained along their diagonal, are maximal runs of equal letters. Each run
    grows over one letter replaced, put in or left out, at either end, as far as letters go on to be equal on the run's own diagonal or the one beside it; a letter or more must follow the edit. The longest
    (of equally long ones: no edit, then a letter replaced, more in the second, more in the first, behind before before) of those with `gap` letters between the copies and at most `reach` from begin to begin is the run's pair; runs that
    grow to the same pair give it once. repeat is the first copy, cut to `longest` letters. Letters other than ACGT equal nothing.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, seqs in _gathered(batches):
            begins = np.cumsum([0] + [len(x) + 2 for x in seqs])[:-1]
            found = grown_pairs("NN".join(seqs), least, gap, reach, begins)  # an edit goes over one letter, not over two
            owner = np.searchsorted(begins, found[:, 0], side="right") - 1
            first, second = found[:, 0] - begins[owner], found[:, 1] - begins[owner]
            text = [seqs[k][a : a + min(n, longest)] for k, a, n in zip(owner.tolist(), first.tolist(), found[:, 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([names[k] for k in owner.tolist()], pa.int64()), pa.array(first), pa.array(second), *(pa.array(found[:, k].astype(np.int32)) for k in (2, 3, 4)), pa.array(text, pa.string()),
            ], names=["contig_id", "begin_first", "begin_second", "length_first", "length_second", "edits", "repeat"])

    return contigs.select("contig_id", "seq").mapInArrow(pairs, MAXIMAL)


def repeat_pairs_by_window(contigs: DataFrame, k: int = K, nearest: int = NEAREST, farthest: int = FARTHEST) -> DataFrame:
    """The same by a shuffle on (contig, k-mer): for contigs that don't fit into one row of a task's memory, cut beforehand with overlaps."""
    starts = F.sequence(F.lit(0), F.length("seq") - k)
    kmers = contigs.where(F.length("seq") >= k).select("contig_id", "seq", F.explode(starts).alias("begin_first")).select("contig_id", "begin_first", F.expr(f"substring(seq, begin_first + 1, {k})").alias("kmer"))
    following = F.lead("begin_first").over(Window.partitionBy("contig_id", "kmer").orderBy("begin_first"))
    return kmers.where(~F.col("kmer").rlike("[^ACGT]")).withColumn("begin_second", following).where((F.col("begin_second") - F.col("begin_first")).between(nearest, farthest)).select(
        "contig_id", F.col("begin_first").cast("bigint"), F.col("begin_second").cast("bigint")
    )


def near_repeat_pairs(contigs: DataFrame, k: int = K, nearest: int = NEAREST, farthest: int = FARTHEST) -> DataFrame:
    """Pairs of k-mers that differ in at most one base, each with the next such copy in reach.

    Of two k-mers with one base replaced, the first or the last k // 2 bases are equal; such halves are the seeds.
    """
    half = k // 2

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = kmer_codes(seq or "", k)
                best = np.full(len(codes), np.iinfo(np.int64).max)
                for part in (codes >> 2 * (k - half), np.where(codes < 0, -1, codes & (1 << 2 * half) - 1)):
                    order = np.argsort(part, kind="stable")
                    step = 1
                    while step < len(order):  # copies of a seed, the next, the one after it, ... while any is in reach
                        a, b = order[:-step], order[step:]
                        reach = (part[a] == part[b]) & (part[a] >= 0) & (b - a <= farthest)
                        if not reach.any():
                            break
                        a, b = a[reach], b[reach]
                        diff = codes[a] ^ codes[b]
                        ok = (np.bitwise_count((diff | diff >> 1) & 0x1555555555555555) <= 1) & (codes[a] >= 0) & (codes[b] >= 0) & (b - a >= nearest)
                        np.minimum.at(best, a[ok], b[ok])
                        step += 1
                first = np.flatnonzero(best < np.iinfo(np.int64).max)
                yield pa.RecordBatch.from_arrays([pa.array([contig] * len(first), pa.int64()), pa.array(first), pa.array(best[first])], names=["contig_id", "begin_first", "begin_second"])

    return contigs.select("contig_id", "seq").mapInArrow(pairs, PAIRS)
