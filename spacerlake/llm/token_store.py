"""Token ids of a corpus in directly addressable codes.

A segment holds the ids of whole documents. Each id is cut into chunks of 8 bits, lowest first. Level k holds the
k-th chunks of the ids that have one, a bitmap with one bit for each of them (set: a higher chunk follows), and a
rank directory with the number of set bits before each 512 bits of the bitmap. The place of an id's next chunk is
the rank of its bit, so one id is found by one rank for each level, without decoding its neighbours.

Segments are rows of a Parquet table (Spark's commit protocol keeps it whole when tasks are repeated), ascending in
the order of the documents: (shard, segment, doc_ids, lengths, n_tokens, chunks, bitmaps, ranks). tokens_at looks up
single ids by document and place in these files; read_index reads whole documents.

Defined results: a null text is an empty one; repeated rows are kept, each as a document; null doc_ids come first;
ties of doc_id are put in an order of the text's hash; an empty table makes no segments.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import held_by_worker, scratch, stored, table

#: Ids after which a segment is closed at the end of its document.
SEGMENT_TOKENS = 1 << 20
END_ID = 2
#: Characters encoded together; a longer text is taken alone.
ENCODE_CHARS = 1 << 23
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
SEGMENT_SCHEMA = (
    "shard int, segment int, doc_ids array<bigint>, lengths array<bigint>, n_tokens bigint, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def encode_ids(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, bitmaps and rank directories of the levels."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint64)
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        padded[: len(bits)] = bits
        counts = np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32)
        chunks.append((rest & np.uint64(0xFF)).astype(np.uint8).tobytes())
        bitmaps.append(bits.tobytes())
        ranks.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes())
        rest = rest[more] >> np.uint64(8)
    return chunks, bitmaps, ranks


def decode_ids(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    higher = np.zeros(0, np.uint64)
    for chunk, bitmap in zip(reversed(chunks), reversed(bitmaps), strict=True):
        ids = np.frombuffer(chunk, np.uint8).astype(np.uint64)
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(ids), bitorder="little").astype(bool)
        ids[more] |= higher << np.uint64(8)
        higher = ids
    return higher.astype(np.uint32)


def id_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], place: int) -> int:
    """One id of a segment, by a rank in each level."""
    found = 0
    for level, chunk in enumerate(chunks):
        found |= chunk[place] << (8 * level)
        if not bitmaps[level][place >> 3] >> (place & 7) & 1:
            break
        block = place // RANK_BITS
        before = int.from_bytes(bitmaps[level][block * RANK_BITS // 8 : place // 8 + 1], "little")
        before &= (1 << (place - block * RANK_BITS)) - 1
        place = int.from_bytes(ranks[level][4 * block : 4 * block + 4], "little") + before.bit_count()
    return found


class UnitEncoder:
    """Encodes texts with the tokenizers library, each different unit once.

    A unit is a part of a text that ends where the tokenizer's pre-tokens end whatever follows, so that a text's ids
    are those of its units, one after the other: before one space between other characters, at line ends, and before
    a full stop or comma after a letter or digit. Texts with other blanks or with marks before such a mark are only cut
    before single spaces. This holds for byte-level tokenizers without a normalizer that split as GPT-2's; for others
    the texts are encoded whole.

    Units and their ids are kept in two dictionaries of at most about KNOWN_BYTES each: when the newer is full it takes the older's
    place, and what is met again moves to the newer.
    """

    KNOWN_BYTES = 48 << 20
    #: Bytes that a unit takes besides its letters and ids.
    UNIT_BYTES = 170
    #: Units that the library encodes at once.
    LEARN = 1000
    SPLIT = re.compile(r"(?<=\S)(?= \S)")
    #: Texts with blanks besides space and line end (or the mark used here), blanks side by side or at an end, or marks that a full stop or comma may join.
    ODD = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]|[ \n][ \n]|\A[ \n]|[ \n]\z|[^\pL\pN][.,]|\A[.,]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        split = str(self.tokenizer.pre_tokenizer)
        self.by_unit = self.tokenizer.normalizer is None and split.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in split
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of units, those without line ends encoded as the lines of one text: a line end is a pre-token of its own there."""
        found: dict[str, bytes] = {}
        lines = [x for x in new if x and "\n" not in x and x.strip() == x.removeprefix(" ")] if self.by_unit and len(self.line_end) == 1 else []
        if lines:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.append(np.flatnonzero(ids == self.line_end[0]), len(ids))
            if len(ends) == len(lines):
                data, size = ids.tobytes(), self.kind.itemsize
                starts = np.append(0, ends[:-1] + 1) * size
                found = {x: data[a:b] for x, a, b in zip(lines, starts.tolist(), (ends * size).tolist(), strict=True)}
        rest = [x for x in new if x not in found]
        for unit, encoded in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[unit] = np.array(encoded.ids, self.kind).tobytes()
        return found

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of different units."""
        found = list(map(self.known.get, units))
        missing = [k for k, x in enumerate(found) if x is None]
        again = [self.older.get(units[k]) for k in missing]
        new = [k for k, x in zip(missing, again, strict=True) if x is None]
        for k, x in zip(missing, again, strict=True):
            found[k] = x
        for at in range(0, len(new), self.LEARN):
            some = new[at : at + self.LEARN]
            learnt = self._learn([units[k] for k in some])
            for k in some:
                found[k] = learnt[units[k]]
        for k in missing:
            self.known[units[k]] = found[k]
            self.size += len(units[k]) + len(found[k]) + self.UNIT_BYTES
            if self.size > self.KNOWN_BYTES:
                self.known, self.older, self.size = {}, self.known, 0
        return found

    def _joined(self, units: pa.ListArray) -> list[np.ndarray]:
        """Ids of the texts that lists of units make up."""
        coded = units.flatten().dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        known = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), self.kind)))
        codes = coded.indices
        values = known.take(codes).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes.to_numpy()])]) if len(codes) else np.zeros(1, np.int64)
        offsets = units.offsets.to_numpy() - units.offsets[0].as_py()
        places = ends[offsets]
        return [values[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an array of strings without nulls."""
        odd = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False).astype(bool) if self.by_unit else np.ones(len(texts), bool)
        plain = texts.filter(pa.array(~odd))
        for mark, apart in ((" ", "\x00 "), ("\n", "\x00\n\x00"), (".\x00", "\x00.\x00"), (",\x00", "\x00,\x00")):
            plain = pc.replace_substring(plain, mark, apart)
        others = [self.SPLIT.split(x) if self.by_unit else [x] for x in texts.filter(pa.array(odd)).to_pylist()]
        found = iter(self._joined(pc.split_pattern(plain, "\x00"))), iter(self._joined(pa.array(others, pa.list_(pa.string()))))
        return [next(found[int(x)]) for x in odd]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS, order: Sequence[str] = (), encode_chars: int = ENCODE_CHARS) -> None:
    """Writes the segments of all documents to path, ascending by the columns of order, if any, and then by id.

    The texts are range-partitioned by (order, id, hash of the text), so equal ids do not meet in one task. A shard is a
    partition; each is encoded and written by one task, segment by segment.
    """
    first = [F.col(x).alias(f"order_{k}") for k, x in enumerate(order)]
    by = [*(f"order_{k}" for k in range(len(first))), "doc_id", "tie"]
    ordered = (
        docs.select(*first, F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .select("doc_id", "text")
    )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = held_by_worker(f"encoder {tokenizer}", lambda: UnitEncoder(tokenizer))  # later tasks use what it has encoded
        shard, segment, end = TaskContext.get().partitionId(), 0, np.array([end_id], np.uint32)
        doc_ids, parts, size = [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([y for x in parts for y in (x, end)])
            chunks, bitmaps, ranks = encode_ids(ids)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "lengths": pa.array([[len(x) + 1 for x in parts]], pa.list_(pa.int64())),
                "n_tokens": pa.array([len(ids)], pa.int64()), "chunks": pa.array([chunks], pa.list_(pa.binary())),
                "bitmaps": pa.array([bitmaps], pa.list_(pa.binary())), "ranks": pa.array([ranks], pa.list_(pa.binary())),
            })

        for batch in batches:
            chars = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            at = 0
            while at < batch.num_rows:
                most = encode_chars + (chars[at - 1] if at else 0)
                some = batch.slice(at, max(1, int(np.searchsorted(chars, most, "right")) - at))
                at += some.num_rows
                for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(ids)
                    size += len(ids) + 1
                    if size >= segment_tokens:
                        yield row()
                        doc_ids, parts, size, segment = [], [], 0, segment + 1
        if parts:
            yield row()

    # levels are not compressed: a lookup reads its bytes as they stand
    ordered.mapInArrow(segments, SEGMENT_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, place, id): the ids at the places asked for (doc_id, place), from the files, each by a rank in each level.

    Places outside a document give no row, nor does a null doc_id; of several documents under one doc_id each answers. Lookups of one segment
    meet in one row with its levels.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3)
            sizes = lengths.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lengths.value_lengths().to_numpy())
            ends = np.cumsum(sizes)
            before = np.concatenate([[0], ends])[lengths.offsets.to_numpy()[:-1] - lengths.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).flatten(), pa.array(ends - sizes - before[row]), pa.array(sizes)], names=["shard", "segment", "doc_id", "first", "n"])

    index = segments.select("shard", "segment", "doc_ids", "lengths").mapInArrow(documents, "shard int, segment int, doc_id bigint, first bigint, n bigint")
    hits = wanted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("place").cast("bigint").alias("place")).join(index, "doc_id").where("place >= 0 AND place < n")
    hits = hits.groupBy("shard", "segment").agg(F.collect_list(F.struct("doc_id", "place", (F.col("first") + F.col("place")).alias("at"))).alias("hits"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunks, bitmaps, ranks, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found = [id_at(chunks, bitmaps, ranks, x["at"]) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"] for x in own], pa.int64()), pa.array([x["place"] for x in own], pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "place", "id"])

    levels = segments.select("shard", "segment", "chunks", "bitmaps", "ranks").join(hits, ["shard", "segment"])
    return levels.select("chunks", "bitmaps", "ranks", "hits").mapInArrow(look_up, "doc_id bigint, place bigint, id bigint")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: (doc_id, start, n_tokens, ids_crc32).

    Starts add up in two steps: over the segments of a shard, and over the shards, of which there are as many as
    tasks wrote them.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    by_shard = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    of_segment = segments.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(by_shard), F.lit(0)).alias("in_shard"))
    all_shards = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(all_shards), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["chunks"], row["bitmaps"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row["shard"]] * len(ends), pa.int32()), "segment": pa.array([row["segment"]] * len(ends), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "in_segment": pa.array(starts, pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                })

    found = segments.select("shard", "segment", "doc_ids", "lengths", "chunks", "bitmaps").mapInArrow(documents, "shard int, segment int, doc_id bigint, in_segment bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(of_segment, ["shard", "segment"]).join(F.broadcast(of_shard), "shard").select(
        "doc_id", (F.col("before") + F.col("in_shard") + F.col("in_segment")).alias("start"), "n_tokens", "ids_crc32"
    )


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer_path())
    return read_index(spark, path)


def with_starts(index: DataFrame, *order: str) -> DataFrame:
    """The rows of an index with start: n_tokens of all rows before it in that order, added up in two steps, over ranges and inside them."""
    dealt = index.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(all_parts), F.lit(0)).alias("before"))
    in_part = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("in_part", F.coalesce(in_part, F.lit(0))).join(F.broadcast(parts), "part").select(*index.columns, (F.col("before") + F.col("in_part")).alias("start"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(spark, table(spark, sf_dir, "documents"))
