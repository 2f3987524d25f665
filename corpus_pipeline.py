"""From the table `documents` to token ids, in five stages: each takes the documents that the one before kept.

Stages are functions of (spark, docs, sf_dir); all but the last return the columns of documents. run() writes each
result as Parquet in the shared folder and reads it again. Documents are told apart by doc_id and text (doc_row): documents that share a doc_id, or
have none, are decided on one by one, and only rows with both equal are one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spacerlake.llm.decontamination import find_contamination
from spacerlake.llm.language_id import identify, learn_likelihoods
from spacerlake.llm.mixing import mix_sources
from spacerlake.llm.ngram_join import similar_rows
from spacerlake.llm.shared import DOCUMENT_COLUMNS, doc_row, scratch, stored, table
from spacerlake.llm.token_store import read_index, tokenizer_path, with_starts, write_tokens

#: The near-copy and token stages have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
#: Characters that the token stage encodes together: fewer than op5 takes, as its tasks share an executor's memory with what the other stages have left.
ENCODED_TOGETHER = 1 << 20


def _with_rows(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Documents with the column doc_row, joined on it with found: those in it (left_semi), those not in it (left_anti), or all with its columns (left)."""
    return docs.select(*DOCUMENT_COLUMNS, doc_row().alias("doc_row")).join(found, "doc_row", how)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: lang is what a document declares, source its host."""
    whole_row = F.concat_ws(":", doc_row(), F.to_json(F.struct("lang", "source", "n_chars")))  # rows that share it are equal, and so is what is decided on them
    docs = docs.select(*DOCUMENT_COLUMNS, whole_row.alias("whole_row"))
    rows = docs.withColumns({"declared": F.col("lang"), "host": F.col("source"), "domain": F.lit(""), "suffix": F.lit("")})
    found = identify(rows, learn_likelihoods(docs.select("doc_id", "text", "lang")), ["whole_row"])
    return docs.join(found.where("rejected"), "whole_row", "left_anti").select(DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each class of near copies."""
    kept = similar_rows(docs.select("doc_id", "text")).where("leads")
    return _with_rows(docs, kept, "left_semi").dropDuplicates(["doc_row"]).select(DOCUMENT_COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold test items."""
    found = find_contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_rows=True)
    return _with_rows(docs, found.where("contaminated"), "left_anti").select(DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, in the order of their slots: the target weights, square roots of the sources' sizes, hold up to the horizon, and nothing behind it is dropped.

    A table that is written and read has no order, so the slots are kept as a table of their own, which the metadata of the column source names.
    """
    slots = mix_sources(docs.select(doc_row().alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias("doc_row")).agg(F.min("slot").alias("slot"))
    slots = stored(slots, "slots")
    placed = _with_rows(docs, slots, "left")
    ordered = placed.repartitionByRange(F.asc_nulls_last("slot"), "doc_row").sortWithinPartitions(F.asc_nulls_last("slot"), "doc_row").select(DOCUMENT_COLUMNS)
    return ordered.withColumn("source", F.col("source").alias("source", metadata={"slots": slots.stored_at}))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, mixed_start) of the documents' token ids, from the files written.

    The files hold the documents as they were mixed: by slot and doc_row, documents without a slot last. mixed_start is the number of ids before a document there, start that of all
    documents before it in the order of doc_id. A table that wasn't mixed is written in the order of doc_id.
    """
    named = docs.schema["source"].metadata.get("slots")
    slots = spark.read.schema("doc_row string, slot bigint").parquet(named) if named else None
    placed = docs.select("doc_id", "text", doc_row().alias("doc_row")).join(slots, "doc_row", "left").withColumn("slot", F.coalesce("slot", F.lit((1 << 63) - 1))) if named else docs
    path = scratch(spark, "tokens")
    write_tokens(placed, path, tokenizer_path(), order=["slot", "doc_row"] if named else [], encode_chars=ENCODED_TOGETHER)
    found = read_index(spark, path).withColumnRenamed("start", "mixed_start")
    return with_starts(found, "doc_id", "mixed_start").select("doc_id", "start", "n_tokens", "ids_crc32", "mixed_start")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix),
    ("token ids", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
