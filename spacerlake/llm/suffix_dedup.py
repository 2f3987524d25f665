"""Suffix-array dedup with a run-length index: bytes covered by a LENGTH-byte string that starts more than once.

A text is a run of symbols: its UTF-8 bytes, or (find_passages) the 64-bit hashes of its words. A window is LENGTH symbols of one document. Equal windows
have equal anchors, the least hash of their GRAM-symbol strings (the first of equals), at the same offset. So windows are found together as follows.

1. Each text gives its anchors, each with the run of windows that have it. Documents with equal texts are one text with several copies.
2. Texts with anchors that recur are kept in a table; the others hold no repeated window.
3. A text's windows of one anchor are cut into units of STEP offsets. All windows of a unit hold the same LENGTH - STEP + 1
   bytes, whose hash is the unit's key. Units that are equal throughout are one unit with a count, as copies add no run to a run-length
   index; those that count more than one match their copies to their ends.
4. Different units of one key are joined, with those of other keys, into a text of TOGETHER_UNITS units or so, for which a run-length index is built: the Burrows-Wheeler
   transform as runs, with the suffix positions at both ends of each run. Match statistics of each position, the length to which another
   suffix agrees with its own, are streamed from these: at a run's end the neighbour's length is compared on the text, and
   everywhere else it is one less than at the position before. Positions of LENGTH or more are marked.
5. A key with more than INDEX_UNITS different units is not put into one index: each of its windows goes under its own hash, and those that recur are marked.

A window that equals the one PERIODS or fewer symbols before it (a byte repeated over and over) is known to be repeated from the text alone; only the
first two periods of such a stretch are dealt out, so that its rows don't grow with its length. Texts are told apart by 128 bits of hash; units by 64
bits besides those of the key that they share.

Defined results: a null text is empty; a text of less than LENGTH bytes loses nothing; repeated rows are documents of their own, and so all of their
windows recur; null doc_ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import word_hashes_of_all
from .shared import discard, doc_row, slices, stored, table

LENGTH, GRAM, STEP = 400, 32, 64
INDEX_UNITS = 1024
#: Words of a passage, of the strings hashed in it, and of a unit's offsets.
PASSAGE, PASSAGE_GRAM, PASSAGE_STEP = 51, 8, 8
#: Symbols of a text looked at together; longer texts are taken in pieces that overlap.
PIECE = 8 << 20
#: Longest period of stretches that are taken from the text alone; they are looked for in texts with over DENSE / 2 times the anchors of a random text.
PERIODS, DENSE = 64, 8
_PLACE_BITS = 24
#: Symbols of short texts looked at together, and different units in an index of several keys.
TOGETHER, TOGETHER_UNITS = 1 << 15, 128

_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_STEPS = {1 << k: np.uint64(x | 1) for k, x in enumerate(np.random.default_rng(12).integers(1, 1 << 63, 10, np.uint64).tolist())}

_LAST = np.uint64(0x9E3779B97F4A7C15)  # odd: its product has the anchors' order in its upper bits


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the string of that length, a power of two, at each place."""
    found, have = _BYTES[data] if data.dtype == np.uint8 else _mixed(data), 1
    while have < length:
        ahead = found[have:]
        found = found[:-have] * _STEPS[have]
        found += ahead
        found ^= found >> np.uint64(32)
        have *= 2
    return found


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n, have = len(values) - width + 1, 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def periodic(data: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches in which windows equal those one period later, for periods up to PERIODS."""
    out = []
    for period in range(1, min(PERIODS, len(data) - length) + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (data[period:] == data[:-period]).astype(np.int8), [0]])))
        out += [(a, b + period, period) for a, b in zip(same[::2].tolist(), same[1::2].tolist(), strict=True) if b - a >= length]
    return out


def anchors(data: np.ndarray, length: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(hash, place, first window, last window) of each run of windows with one anchor, as offsets in the text, and whether periodic stretches were looked for.

    Of periodic stretches only the windows of the first two periods are there.
    """
    out: list[tuple[np.ndarray, ...]] = []
    dense = False
    for start in range(0, max(0, len(data) - length + 1), piece):
        own = data[start : start + piece + length - 1]
        hashes = string_hashes(own, gram) * _LAST
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = _sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        firsts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        lasts = np.concatenate([firsts[1:], [len(least)]]) - 1
        if len(firsts) * (length - gram + 2) > DENSE * len(own):  # a random text has one for each half of a window's places
            dense = True
            skip = np.zeros(len(least) + 1, np.int64)
            for a, b, period in periodic(own, length):
                if b - length >= a + 2 * period:
                    skip[a + 2 * period] += 1
                    skip[b - length + 1] -= 1
            left = np.concatenate([[0], np.cumsum(np.cumsum(skip[:-1]) == 0)])  # windows that stay, before each
            begin = np.searchsorted(left, left[firsts], "right") - 1  # the first window from there on that stays
            stay = left[lasts + 1] > left[firsts]
            end = np.searchsorted(left, left[lasts + 1], "left") - 1
            firsts, lasts, whole = begin[stay], end[stay], firsts[stay]
        else:
            whole = firsts
        places = (least[whole] & low).astype(np.int64)
        out.append((hashes[places], places + start, firsts + start, lasts + start))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), dense
    return *(np.concatenate(x) for x in zip(*out, strict=True)), dense


def anchors_of_all(texts: list[np.ndarray], length: int, gram: int, together: int = TOGETHER) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """anchors() of each text; short ones are looked at together, in runs of about that many symbols, without the windows that reach into the next text."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), False)
    out = [none] * len(texts)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    held: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        if len(text) >= length and len(text) < together:
            held.append(k)
            size += len(text)
        elif len(text) >= length:
            out[k] = anchors(text, length, gram)
        if not held or (size < together and k < len(texts) - 1):
            continue
        sizes = np.array([len(texts[x]) for x in held])
        begins, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        before = np.cumsum(counts) - counts
        hashes = string_hashes(np.concatenate([texts[x] for x in held]), gram) * _LAST
        least = _sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        least = least[np.arange(int(counts.sum())) + np.repeat(begins - before, counts)]  # places of two texts differ, so no run spans them
        firsts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        lasts = np.concatenate([firsts[1:], [len(least)]]) - 1
        places = (least[firsts] & low).astype(np.int64)
        cuts = np.append(np.searchsorted(firsts, before), len(firsts))
        runs = np.diff(cuts)
        own = hashes[places], places - np.repeat(begins, runs), firsts - np.repeat(before, runs), lasts - np.repeat(before, runs)
        for x, a, b in zip(held, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            dense = (b - a) * (length - gram + 2) > DENSE * len(texts[x])
            out[x] = anchors(texts[x], length, gram) if dense else (*(c[a:b] for c in own), False)
        held, size = [], 0
    return out


def text_id(data: np.ndarray) -> bytes:
    return hashlib.blake2b(data.tobytes(), digest_size=16).digest()


def units_of(data: np.ndarray, hashes: np.ndarray, places: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, length: int, step: int) -> tuple[np.ndarray, ...]:
    """(key, content, first window, windows) of the units of the anchors given."""
    half = 1 << ((length - 1).bit_length() - 1)  # a string of half to twice that many symbols is hashed as two that overlap
    spans = string_hashes(data, half)
    low, high = places - lasts, places - firsts
    cells = high // step - low // step + 1
    which = np.repeat(np.arange(len(places)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells) + (low // step)[which]
    common = places[which] - cell * step
    shared = length - step + 1
    key = _mixed(hashes[which] + _mixed(spans[common] * _STEPS[1] + spans[common + shared - half]) * _STEPS[2] + cell.astype(np.uint64))
    near, far = np.maximum(low[which], cell * step), np.minimum(high[which], cell * step + step - 1)
    first, windows = places[which] - far, far - near + 1
    content = _mixed(key + _mixed(spans[first] * _STEPS[4] + spans[first + windows - 1 + length - half]) * _STEPS[8] + (far * 1024 + windows).astype(np.uint64))
    return key, content, first, windows


class RunLengthIndex:
    """Burrows-Wheeler transform of some texts as runs, with the suffix positions at the ends of each run."""

    def __init__(self, texts: list[np.ndarray]):
        n = len(texts)
        sizes = np.array([len(x) + 1 for x in texts])
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        data = np.concatenate(texts)
        kinds, data = (256, data) if data.dtype == np.uint8 else (lambda x: (len(x[0]), x[1]))(np.unique(data, return_inverse=True))
        self.symbols = np.empty(int(ends[-1]), np.int64)
        inside = np.ones(len(self.symbols), bool)
        inside[ends - 1] = False
        self.symbols[inside] = data.astype(np.int64) + n
        self.symbols[ends - 1] = np.arange(n)  # each text ends with a symbol of its own
        bits = int(n + kinds).bit_length()
        self.packed_symbols = 62 // bits
        padded = np.concatenate([self.symbols, np.zeros(self.packed_symbols, np.int64)])
        self.packed = np.zeros(len(self.symbols), np.int64)
        for k in range(self.packed_symbols):
            self.packed = (self.packed << bits) | padded[k : k + len(self.symbols)]
        suffixes = self._sorted_suffixes()
        before = self.symbols[suffixes - 1]
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_starts = np.concatenate([[0], change])
        self.run_symbols = before[self.run_starts]
        self.first_suffixes = suffixes[self.run_starts]
        self.last_suffixes = suffixes[np.concatenate([change - 1, [len(suffixes) - 1]])]

    def _sorted_suffixes(self) -> np.ndarray:
        """By prefix doubling, from the packed symbols on."""
        n, width, key = len(self.symbols), self.packed_symbols, self.packed
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[order[-1]] == n - 1:
                return order
            behind = np.zeros(n, np.int64)
            behind[:-width] = rank[width:] + 1
            key = rank * (n + 1) + behind
            width *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length to which the suffixes at a and b agree."""
        found, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(self.symbols)
        at_a, at_b = a.copy(), b.copy()
        while len(live):
            same = self.packed[at_a] == self.packed[at_b]  # the last symbols of two texts differ, so none runs over the end
            live, at_a, at_b = live[same], at_a[same] + self.packed_symbols, at_b[same] + self.packed_symbols
            found[live] += self.packed_symbols
        at_a, at_b, live = a + found, b + found, np.arange(len(a))
        for _ in range(self.packed_symbols):
            same = (at_a < n) & (at_b < n)
            same[same] = self.symbols[at_a[same]] == self.symbols[at_b[same]]
            live, at_a, at_b = live[same], at_a[same] + 1, at_b[same] + 1
            found[live] += 1
        return found

    def match_lengths(self) -> np.ndarray:
        """For each position, the longest agreement of its suffix with any other's."""
        n = len(self.symbols)
        longest = np.zeros(n, np.int64)
        # the least suffix has none before it, the greatest none behind it
        for own, other, alone in ((self.first_suffixes[1:], self.last_suffixes[:-1], self.first_suffixes[0]), (self.last_suffixes[:-1], self.first_suffixes[1:], self.last_suffixes[-1])):
            known = np.full(n, -1, np.int64)
            known[[0, alone]] = 0
            known[own] = self._common(own, other)
            last = np.maximum.accumulate(np.where(known >= 0, np.arange(n), 0))
            longest = np.maximum(longest, known[last] - (np.arange(n) - last))
        return longest


def marked_windows(texts: list[np.ndarray], windows: list[int], length: int) -> list[np.ndarray]:
    """Which of the first windows of each text match elsewhere."""
    index = RunLengthIndex(texts)
    found = index.match_lengths() >= length
    return [found[s : s + n] for s, n in zip(index.starts.tolist(), windows, strict=True)]


def _runs(marked: np.ndarray, length: int) -> list[dict]:
    """[start, end) bytes covered by the marked windows, windows that follow each other as one."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b) - 1 + length} for a, b in zip(edges[::2], edges[1::2], strict=True)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, index_units: int = INDEX_UNITS) -> DataFrame:
    """(doc_id, sha256, n_bytes, spans, n_removed, kept_sha256) of every row of docs (doc_id, text): spans are the maximal removed byte ranges, sha256 is the text's."""
    found, per_text = _repeats(docs, bytes_of_all, length, gram, step, index_units)
    whole = (F.col("copies") > 1) & (F.col("size") >= length)
    return found.join(per_text, "text_id").select(
        "doc_id", "sha256", F.col("size").alias("n_bytes"), _all_spans(whole).alias("spans"), _all_removed(whole).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def find_passages(docs: DataFrame, length: int = PASSAGE, gram: int = PASSAGE_GRAM, step: int = PASSAGE_STEP, index_units: int = INDEX_UNITS) -> DataFrame:
    """(doc_id, sha256, n_words, spans, n_repeated) of every row of docs (doc_id, text), in words: those in a passage of length words that starts more than once."""
    found, per_text = _repeats(docs, words_of_all, length, gram, step, index_units)
    whole = (F.col("copies") > 1) & (F.col("size") >= length)
    return found.join(per_text, "text_id").select("doc_id", "sha256", F.col("size").alias("n_words"), _all_spans(whole).alias("spans"), _all_removed(whole).alias("n_repeated"))


def bytes_of_all(texts: list[str]) -> list[np.ndarray]:
    return [bytes_of(x) for x in texts]


def words_of_all(texts: list[str]) -> list[np.ndarray]:
    return word_hashes_of_all(texts, TOGETHER)


def _all_spans(whole: Column) -> Column:
    all_of = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end")))
    return F.when(whole, all_of).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")))


def _all_removed(whole: Column) -> Column:
    return F.when(whole, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint")


def _repeats(docs: DataFrame, symbols: Callable[[list[str]], list[np.ndarray]], length: int, gram: int, step: int, index_units: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id, size, sha256) of every row of docs, and (text_id, copies, spans, n_removed, kept_sha256) of every text: spans in symbols, null without any."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = symbols([""])[0].dtype
    by_bytes = kind == np.uint8

    def symbols_of(column: pa.Array) -> list[np.ndarray]:
        if by_bytes:
            return [np.frombuffer(x, kind) for x in column.cast(pa.binary()).to_pylist()]
        return symbols(column.to_pylist())

    four = ["anchors", "places", "firsts", "lasts"]

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            texts = symbols_of(some.column(1))
            digests = [hashlib.sha256(x).hexdigest() for x in some.column(1).cast(pa.binary()).to_pylist()]
            found = anchors_of_all(texts, length, gram)
            arrays = [pa.array([x[0].view(np.int64) for x in found], pa.list_(pa.int64())), *(pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array([text_id(x) for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64()), pa.array(digests, pa.string()), pa.array([x[4] for x in found], pa.bool_()), *arrays],
                names=["doc_id", "text_id", "size", "sha256", "dense", *four],
            )

    found = docs.mapInArrow(find_anchors, "doc_id bigint, text_id binary, size bigint, sha256 string, dense boolean, anchors array<bigint>, places array<int>, firsts array<int>, lasts array<int>")
    found = stored(found, "anchors")
    one = found.select("text_id", F.explode(F.arrays_zip(*four)).alias("a")).select("text_id", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("place"), F.col("a.firsts").alias("first"), F.col("a.lasts").alias("last"))
    where = F.xxhash64("text_id", "place")
    again = one.groupBy("anchor").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("anchor")
    again = stored(again, "recurring")  # a join of two tables, so that Spark can split a very frequent anchor over several tasks
    wanted = one.join(again, "anchor", "left_semi").groupBy("text_id").agg(F.collect_set(F.struct("anchor", "place", "first", "last")).alias("wanted"))
    row = F.concat_ws(":", F.col("doc_id").cast("string"), "sha256")  # a text is fetched from one row that has it; doc_ids may be null or repeated
    named = found.groupBy("text_id").agg(F.min(row).alias("row"), F.first("dense").alias("dense"), F.count("*").alias("copies"))
    named = stored(named, "texts")
    holders = wanted.join(named, "text_id").select("text_id", "wanted", "row", "dense")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([write(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["row", "packed"])

    packed = docs.select(doc_row().alias("row"), "text").mapInArrow(pack, "row string, packed binary")  # texts travel compressed
    texts = packed.join(holders, "row").select("text_id", "packed", "wanted", "dense")

    def unpacked(column: pa.Array) -> Iterator[np.ndarray]:
        read = zstandard.ZstdDecompressor().decompress
        return (np.frombuffer(read(x), kind) for x in column.to_pylist())

    def as_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, write = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches):
            yield batch.set_column(1, "packed", pa.array([write(y.tobytes()) for y in symbols([read(x).decode() for x in batch.column(1).to_pylist()])], pa.binary()))

    # a row that is repeated whole may be here twice; it has copies then, and its windows do recur
    texts = stored(texts if by_bytes else texts.mapInArrow(as_symbols, texts.schema), "repetitive")

    def find_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = batch.column(2)
            cuts = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            cols = [x.to_numpy().astype(np.int64) for x in wanted.flatten().flatten()]
            ids, held, size = batch.column(0), [], 0
            for k, data in enumerate(unpacked(batch.column(1))):
                held.append(data)
                size += len(data)
                if size < TOGETHER and k < batch.num_rows - 1:
                    continue
                since, sizes = k + 1 - len(held), np.array([len(x) for x in held])
                begins, a, b = np.cumsum(sizes) - sizes, cuts[since], cuts[k + 1]
                shift = np.repeat(begins, np.diff(cuts[since : k + 2]))  # all that is hashed lies inside its text
                key, content, first, windows = units_of(np.concatenate(held), cols[0][a:b].view(np.uint64), *(x[a:b] + shift for x in cols[1:]), length, step)
                own = np.searchsorted(begins, first, "right") - 1
                first = first - begins[own]
                for at in range(0, len(key), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[some] + since)), pa.array(key[some].view(np.int64)), pa.array(content[some].view(np.int64)), pa.array(first[some], pa.int32()), pa.array(windows[some], pa.int32())], names=["text_id", "key", "content", "first", "windows"])
                held, size = [], 0

    every = stored(texts.select("text_id", "packed", "wanted").mapInArrow(find_units, "text_id binary, key bigint, content bigint, first int, windows int"), "units")
    several = every.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    units = stored(every.join(stored(several, "recurring-keys"), "key", "left_semi"), "shared-units")
    discard(every, again)
    kinds = units.groupBy("key", "content").agg(F.min(F.struct("text_id", "first", "windows")).alias("one"), F.count("*").alias("n"))
    kinds = stored(kinds, "kinds")
    shared = kinds.join(kinds.groupBy("key").agg(F.count("*").alias("of_key")), "key")
    all_of = kinds.where("n > 1").select("key", "content", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), (F.col("one.windows") - 1 + length).cast("bigint").alias("end"))).alias("runs"))

    def cut_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for data, own in zip(unpacked(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                columns = [pa.array([x[k] for x in own], pa.int64()) for k in ("key", "content", "n", "of_key", "windows")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data[x["first"] : x["first"] + x["windows"] - 1 + length].tobytes() for x in own], pa.binary())], names=["key", "content", "n", "of_key", "windows", "bytes"])

    of_texts = shared.where("of_key > 1").groupBy("one.text_id").agg(F.collect_list(F.struct("key", "content", "n", "of_key", "one.first", "one.windows")).alias("units"))
    cut = of_texts.join(texts.select("text_id", "packed"), "text_id").select("packed", "units").mapInArrow(cut_slices, "key bigint, content bigint, n bigint, of_key bigint, windows bigint, bytes binary")
    cut = stored(cut, "slices")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def marks() -> pa.RecordBatch:
            found = marked_windows([np.frombuffer(x["bytes"], kind) for x in held], [x["windows"] for x in held], length)
            out = [(x["key"], x["content"], runs) for x, m in zip(held, found, strict=True) if x["n"] == 1 and (runs := _runs(m, length))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], _SPANS)], names=["key", "content", "runs"])

        for batch in slices(batches):
            for row in batch.to_pylist():
                if len(held) >= min(TOGETHER_UNITS, index_units) and row["key"] != held[-1]["key"]:
                    yield marks()
                    held = []
                held.append(row)
        if held:
            yield marks()

    marks_schema = "key bigint, content bigint, runs array<struct<start:bigint,end:bigint>>"
    indexed = cut.where(F.col("of_key") <= index_units).repartition("key").sortWithinPartitions("key").mapInArrow(mark, marks_schema)

    def windows_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for row in batch.to_pylist():
                half = 1 << ((length - 1).bit_length() - 1)
                spans = string_hashes(np.frombuffer(row["bytes"], kind), half)
                at = np.arange(row["windows"])
                own = _mixed(np.uint64(row["key"] & 0xFFFFFFFFFFFFFFFF) + _mixed(spans[at] * _STEPS[16] + spans[at + length - half]))
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(at), pa.int64()), pa.array([row["content"]] * len(at), pa.int64()), pa.array(at), pa.array(own.view(np.int64))], names=["key", "content", "at", "window"])

    apart = cut.where(F.col("of_key") > index_units).mapInArrow(windows_apart, "key bigint, content bigint, at bigint, window bigint")
    recur = apart.groupBy("key", "window").agg(F.count("*").alias("n")).where("n > 1").select("key", "window")
    crowded = apart.join(recur, ["key", "window"], "left_semi").groupBy("key", "content").agg(F.transform(F.array_sort(F.collect_list("at")), lambda a: F.struct(a.alias("start"), (a + length).alias("end"))).alias("runs"))

    runs = all_of.unionByName(indexed).unionByName(crowded)
    covered = units.join(runs, ["key", "content"]).select("text_id", F.transform("runs", lambda r: F.struct((r["start"] + F.col("first")).alias("start"), (r["end"] + F.col("first")).alias("end"))).alias("runs"))
    by_text = covered.groupBy("text_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, removed, digests = [], [], []
            lists = batch.column(1)
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            starts, ends = (x.to_numpy() for x in lists.flatten().flatten())
            for data, dense, a, b in zip(unpacked(batch.column(2)), batch.column(3).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                size = len(data)
                edges = np.bincount(starts[a:b], minlength=size + 1) - np.bincount(ends[a:b], minlength=size + 1)
                gone = np.cumsum(edges[:-1]) > 0
                for start, end, _ in periodic(data, length) if dense else ():
                    gone[start:end] = True
                spans.append(_runs(gone, 1))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest() if by_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=["text_id", "spans", "n_removed", "kept_sha256"])

    kept = by_text.join(texts.select("text_id", "packed", "dense"), "text_id").mapInArrow(keep, "text_id binary, spans array<struct<start:bigint,end:bigint>>, n_removed bigint, kept_sha256 string").dropDuplicates(["text_id"])
    per_text = named.join(kept, "text_id", "left").select("text_id", "copies", "spans", "n_removed", "kept_sha256")
    return found.select("doc_id", "text_id", "size", "sha256"), per_text


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: a document's words in passages of PASSAGE words (over 50) that start more than once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    row = F.concat_ws(":", F.col("doc_id").cast("string"), "sha256").alias("row")
    passages = find_passages(docs).select(row, F.col("n_repeated").alias("n_passage_words")).dropDuplicates(["row"])
    return find_repeats(docs).select(row, "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256").join(passages, "row").drop("row")
