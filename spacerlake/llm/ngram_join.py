"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document's set holds the hashes of its SHINGLE consecutive words (of all words, if it has fewer; words as for
decontamination, in lower case). Documents with equal sets are copies and are indexed once. In each of TREES trees a
document's path is a run of LONGEST MinHash values, so a tree is a prefix trie of paths. The root prefix is as long as documents
of the least similarity share one in some tree with a chance of RECALL or more: this is as far as prefixes are shortened. Rows are dealt out by
(tree, root prefix) and sorted by the rest of their paths; those that share a longest prefix are compared first, by the share of equal values with a
margin of six standard deviations, then prefixes are shortened value by value, where a node holds documents that aren't connected yet, up to the root. What is
alike makes up a component, and all pairs in it are verified on the sets of their texts; so an early end in a connected node loses no link.
Rows are told apart by doc_id and text, so a doc_id may be null or stand for several texts.

Defined results: null and empty texts, and texts without words, have no set and link with nothing; repeated rows are
copies of each other; a null doc_id never names a class unless all of its members are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linkage import BLOCK, LEVEL_BITS, classes, connected_components, in_blocks, sketch_edges, verified_links
from .shared import discard, doc_row, slices, stored, table

SHINGLE = 5
THRESHOLD = 0.8
TREES, LONGEST, RECALL = 24, 8, 0.9999
#: Shingles of a block of documents, at most about.
BLOCK_SHINGLES = 1 << 19
COLUMNS = 1 << 13

_LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))
_PLACES = np.random.default_rng(6).integers(1, 1 << 63, 1024, np.uint64) | np.uint64(1)
_BLANK = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of some bytes start, and their hashes."""
    blank = _BLANK[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    lengths = ends - starts
    letters = _LETTERS[data[~blank]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return starts, _mixed(np.add.reduceat(letters * _POWERS[place & 0xFFF] + (place >> 12).astype(np.uint64), first) + lengths.astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    return _words(np.frombuffer(text.lower().encode(), np.uint8))[1]


def word_hashes_of_all(texts: list[str], together: int) -> list[np.ndarray]:
    """word_hashes of each text; short ones are hashed together, in runs of about that many bytes."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        held.append(text.lower().encode())
        size += len(held[-1]) + 1
        if size >= together or k == len(texts) - 1:
            starts, hashes = _words(np.frombuffer(b"\n".join(held), np.uint8))
            ends = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held]))
            out += np.split(hashes, ends[:-1])
            held, size = [], 0
    return out


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles."""
    words = word_hashes(text or "")
    n = min(size, len(words))
    if not n:
        return words
    joined = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        joined += _mixed(words[k : len(words) - n + 1 + k] ^ _PLACES[k % 1024])  # another function of the word for each place
    return np.unique(_mixed(joined))


def content_id(shingles: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def prefix_length(threshold: float, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> int:
    """The longest root prefix with which the forest finds pairs of the threshold's similarity with at least that chance."""
    length = longest
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _paths(docs: DataFrame, trees: int, longest: int, root: int, size: int) -> DataFrame:
    """(doc_id, doc_row, id, shingles, nodes, sketch): id is null without words; nodes has the root's key and the rest of the path in each tree."""
    factors = np.random.default_rng(8).integers(1, 1 << 63, trees * longest, np.uint64) | np.uint64(1)
    node = pa.struct([("key", pa.int64()), ("path", pa.int64())])

    def path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, counts, keys, rests, sketches = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, size)
                ids.append(content_id(shingles))
                counts.append(len(shingles))
                if not len(shingles):
                    sketches.append(None)
                    continue
                least = np.full(trees * longest, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(shingles), 2048):
                    np.minimum(least, (factors[:, None] * shingles[None, at : at + 2048]).min(axis=1), out=least)
                values = _mixed(least).reshape(trees, longest)
                key = np.arange(trees, dtype=np.uint64)
                for step in values[:, :root].T:
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + step)
                rest = np.zeros(trees, np.uint64)
                for step in values[:, root:].T:
                    rest = (rest << np.uint64(LEVEL_BITS)) | (step & np.uint64((1 << LEVEL_BITS) - 1))
                keys.append(key.view(np.int64))
                rests.append(rest.view(np.int64))
                sketches.append((values[:, :root] & np.uint64(0xFFFF)).astype("<u2").tobytes())
            some = np.array(counts) > 0
            ends = np.concatenate([[0], np.cumsum(some)]) * trees
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (keys, rests)], fields=list(node))
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), nodes, pa.array(sketches, pa.binary())], names=["doc_id", "doc_row", "id", "shingles", "nodes", "sketch"])

    return docs.select("doc_id", "text", doc_row().alias("doc_row")).mapInArrow(path, "doc_id bigint, doc_row string, id bigint, shingles bigint, nodes array<struct<key:bigint,path:bigint>>, sketch binary")


def jaccard_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs of sets whose similarity is at least the threshold."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    common = np.zeros((n, n), np.int64)
    if n <= 16:
        for i in range(n):
            for j in range(i + 1, n):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]):
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        known, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = np.repeat(np.arange(n), sizes)[order], column[order]
        shared = np.bincount(column, minlength=len(known)) > 1
        keep = shared[column]
        row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
        for at in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [at, at + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            common += (part @ part.T).astype(np.int64)
    return common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9


def join_similar(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_id, n_links, kept) of every row of docs (doc_id, text).

    class_id: least doc_id reachable by links, itself included. copy_id: least doc_id of an equal set. n_links: other
    documents linked directly, copies included. kept: the document that names its class.
    """
    return similar_rows(docs, threshold, size, trees, longest, recall).drop("doc_row", "leads")


def similar_rows(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, longest: int = LONGEST, recall: float = RECALL) -> DataFrame:
    """What join_similar gives, and (doc_row, leads): leads holds for one doc_row of each class, and for all rows without a set."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    root = prefix_length(threshold, trees, longest, recall)
    levels = min(longest - root, 63 // LEVEL_BITS)
    paths = stored(_paths(docs, trees, root + levels, root, size), "paths")
    own = stored(paths.select("doc_id", "doc_row", "id"), "rows")
    sets = paths.where("id IS NOT NULL").groupBy("id").agg(
        F.min("doc_id").alias("copy_id"), F.min_by("doc_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_row")).alias("row"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"), F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch")
    )
    sets = stored(sets, "sets")
    discard(paths)
    one, reps = sets.select("id", "nodes", "sketch"), stored(sets.select("id", "copy_id", "row", "copies", "shingles"), "set-counts")
    keys = one.select("id", F.explode("nodes").alias("node")).select("id", "node.key", "node.path")
    values = trees * root
    equal = math.floor(values * threshold - 6 * math.sqrt(values * threshold * (1 - threshold)))
    dealt = in_blocks(keys, "key", "id").join(one.select("id", "sketch"), "id")
    alike = sketch_edges(dealt, lambda a, b: (a.view("<u2") == b.view("<u2")).sum(axis=1) >= equal, levels)
    coarse = stored(connected_components(alike, "id", "other").join(reps, "id"), "coarse")
    discard(sets)  # what is alike is known: paths and sketches, two thirds of a kilobyte a set, go before the texts are moved

    def linked(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
        sets = [shingle_set(x, size) for x in group.column("text").to_pylist()]
        keep = np.array([content_id(x) == i for x, i in zip(sets, group.column("id").to_pylist(), strict=True)])
        group = group.filter(pa.array(keep))
        return group, jaccard_links([x for x, k in zip(sets, keep, strict=True) if k], threshold)

    weight = F.ceil(F.col("shingles") * (BLOCK / BLOCK_SHINGLES))
    dealt = in_blocks(coarse.select("id", "root", "copies", "copy_id", "shingles"), "root", "id", weight)
    # merged at every size: broadcasting the ids while they are few would only make small runs unlike large ones
    texts = docs.select(doc_row().alias("row"), "text").join(coarse.select("id", "row").hint("merge"), "row").select("id", "text").dropDuplicates(["id"])
    links = verified_links(dealt.select("group", "side", "id", "copies").join(texts, "id"), linked)
    found = classes(links, reps.select("id", "copies")).join(reps.select("id", "copy_id", "row"), "id")
    named = stored(found, "named")
    names = named.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min_by("id", F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "id")).alias("leader"))
    by_id = named.join(names, "root").select("id", "class_id", "copy_id", "n_links", F.when(F.col("id") == F.col("leader"), F.col("row")).alias("leading_row"))
    own = own.join(by_id, "id", "left")
    class_id = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    copy_id = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("copy_id"))
    return own.select("doc_id", class_id.alias("class_id"), copy_id.alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"), "doc_row", (F.col("id").isNull() | F.col("doc_row").eqNullSafe(F.col("leading_row"))).alias("leads"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(table(spark, sf_dir, "documents"))
