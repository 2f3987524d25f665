"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans each text once.

Normalised: A-Z in lower case, words of digits, a-z and all characters from U+0080. The automaton's symbols are words. Its patterns are an item's
stretches of CHUNK words that start at multiples of CHUNK, so that it has a node for each word of the items, and every window of WINDOW = 2 CHUNK - 1
words holds a pattern; items of fewer words are a pattern as a whole. A match is extended to both sides by the item's words; a run of
WINDOW words or more holds windows, and all its words are hit. Hit words are mapped to character offsets of the original text.

The items are a test set, read into one automaton behind a check of its size: beyond MAX_ITEM_BYTES of text it is
dealt into several automata, each with its own scan of the texts, and the hit words of all scans are put together, with the same result.

Defined results: null or empty texts have no words and no hits; rows that repeat an item_id are one item; a null
item_id counts as "" (an empty string); repeated document rows are each scanned; empty tables give no rows or no hits.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import doc_row, held_by_worker, slices, table

WINDOW = 13
MAX_ITEM_BYTES = 32 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _WORD.fullmatch(bytes([b])) else 32 for b in range(256))
_HITS = "doc_row string, doc_id bigint, n_words bigint, hits array<struct<word:int,start:bigint,end:bigint>>, item_ids array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Scanner:
    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.window, self.chunk = window, (window + 1) // 2
        self.known: dict[bytes, int] = {}
        self.items = [(item, array("I", [self.known.setdefault(w, len(self.known) + 1) for w in words((text or "").encode())])) for item, text in items]
        patterns: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, own) in enumerate(self.items):
            size = self.chunk if len(own) >= window else len(own)
            for at in range(0, len(own) - size + 1, size) if size else ():
                patterns.setdefault(tuple(own[at : at + size]), []).append((k, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, places in patterns.items():
            self.automaton.add_word(key, (len(key), places))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: bytes) -> tuple[int, list[int], list[str]]:
        """Number of words, numbers of the hit words, items."""
        split = words(text)
        if self.empty or not split:
            return len(split), [], []
        get = self.known.get
        own = tuple([get(x, 0) for x in split])
        edges, found, done = np.zeros(len(own) + 1, np.int64), set(), {}
        for last, (size, places) in self.automaton.iter(own):
            first = last - size + 1
            for k, at in places:
                item = self.items[k][1]
                if len(item) >= self.window:
                    if first < done.get((k, first - at), 0):
                        continue  # in a run that is known
                    a, b = first, last + 1
                    while a and a - first + at and own[a - 1] == item[a - 1 - first + at]:
                        a -= 1
                    while b < len(own) and b - first + at < len(item) and own[b] == item[b - first + at]:
                        b += 1
                    done[k, first - at] = b
                    if b - a < self.window:
                        continue
                elif size < len(item):  # a whole shorter item of the same words as a part of this one
                    continue
                else:
                    a, b = first, last + 1
                edges[a] += 1
                edges[b] -= 1
                found.add(self.items[k][0])
        return len(own), np.flatnonzero(np.cumsum(edges[:-1]) > 0).tolist(), sorted(found)


def word_places(text: bytes, hit: list[int]) -> list[dict]:
    """The hit words with their [start, end) in characters of the original text."""
    wanted, out, at, chars = set(hit), [], 0, 0
    for k, m in enumerate(_WORD.finditer(text)):
        if k in wanted:
            start = chars + len(text[at : m.start()].decode())
            chars, at = start + len(m[0].decode()), m.end()
            out.append({"word": k, "start": start, "end": chars})
    return out


def spans(hits: list[dict]) -> list[dict]:
    """Runs of hit words that follow each other, from the first's start to the last's end."""
    runs: list[dict] = []
    before = None
    for x in hits:
        if runs and x["word"] == before + 1:
            runs[-1]["end"] = x["end"]
        else:
            runs.append({"start": x["start"], "end": x["end"]})
        before = x["word"]
    return runs


def _scan_with(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    own, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    place = pa.struct([("word", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, f"scanner {key}"):
            scanner = held_by_worker(f"scanner {key}", lambda: Scanner(own.value, window))
            texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
            found = [scanner.scan(x) for x in texts]
            hits = [word_places(t, x[1]) if x[1] else [] for t, x in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array(hits, pa.list_(place)), pa.array([x[2] for x in found], pa.list_(pa.string()))],
                names=["doc_row", "doc_id", "n_words", "hits", "item_ids"],
            )

    return docs.mapInArrow(scan, _HITS)


def _with_spans(found: DataFrame) -> DataFrame:
    """Adds hit_spans to hits, sorted by word."""
    names = found.columns

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [spans(x) for x in batch.column(names.index("hits")).to_pylist()]
            yield batch.append_column("hit_spans", pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return found.mapInArrow(join, T.StructType([*found.schema.fields, T.StructField("hit_spans", T.ArrayType(span))]))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES, with_rows: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, hit_spans, contaminated) of every row of docs (doc_id, text); items (item_id, text).

    hit_spans are the runs of hit words as [start, end) in characters of the original text. with_rows: also doc_row, as documents may share a doc_id.
    """
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-size // max_item_bytes) or 1
    docs = docs.select((doc_row() if with_rows or parts > 1 else F.lit(None).cast("string")).alias("doc_row"), "doc_id", "text")
    if parts == 1:
        found = _scan_with(docs, [tuple(x) for x in items.collect()], window)
    else:
        scans = [_scan_with(docs.dropDuplicates(["doc_row"]), [tuple(x) for x in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()], window) for k in range(parts)]
        found = scans[0]
        for x in scans[1:]:
            found = found.unionByName(x)
        found = found.groupBy("doc_row", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
        )
        found = docs.groupBy("doc_row").count().join(found, "doc_row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    n_hit = F.size("hits").cast("bigint")
    return _with_spans(found).select(*["doc_row"][: int(with_rows)], "doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("item_ids").alias("item_ids"), "hit_spans", ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM benchmark),
bn AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM bn)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n AS n, k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
