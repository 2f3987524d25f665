"""FASTA and the text formats of outside tools, as DataFrames. Files are split by Spark, record by record."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, header, seq) of each record under a path (file, folder or pattern): seq is in upper case, without blanks and line ends."""
    records = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file"))
    body = F.regexp_replace("value", r"^>", "")
    header = F.trim(F.regexp_replace(F.substring_index(body, "\n", 1), "\r", ""))
    rest = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise("")
    return records.where(F.trim("value") != "").select("file", header.alias("header"), F.upper(F.regexp_replace(rest, r"\s", "")).alias("seq"))


_BASES = bytes(S.BASES.encode()[(b & 0xDF) - 65] if 65 <= b & 0xDF <= 90 else b for b in range(256))
_NO_LETTERS = bytes(b for b in range(256) if not 65 <= b & 0xDF <= 90 or b >= 128)


def letters_as_bases(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(contig_id, seq): what dna_of gives, by one pass over the bytes of Arrow batches."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(x or b"").translate(_BASES, _NO_LETTERS) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary()).cast(pa.string())], names=["contig_id", "seq"])

    return rows.select(F.col(key).cast("bigint"), F.col(text).cast("string")).mapInArrow(read, "contig_id bigint, seq string")


def single_record(records: DataFrame) -> DataFrame:
    """One contig per file: its first header, and the sequences of all its records, one after the other (ordered by header)."""
    parts = records.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("header", "seq"))).alias("parts"))
    return parts.select("file", F.element_at("parts", 1)["header"].alias("header"), F.array_join(F.transform("parts", lambda x: x["seq"]), "").alias("seq"))


def named(records: DataFrame, style: str = "accession", keep: str = "all") -> DataFrame:
    """Adds name from the header, by accession or in full. Records of one name get an ordinal behind it, or (keep="last") only the last stays."""
    name = S.accession_name(F.col("header")) if style == "accession" else S.full_name(F.col("header"))
    order = Window.partitionBy("name").orderBy("file", "header", "seq")
    numbered = records.withColumn("name", name).withColumns({"_n": F.row_number().over(order), "_of": F.count("*").over(Window.partitionBy("name"))})
    if keep == "last":
        return numbered.where("_n = _of").drop("_n", "_of")
    return numbered.withColumn("name", F.when(F.col("_of") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", "_n"))).drop("_n", "_of")


def record_counts(records: DataFrame) -> DataFrame:
    """(file, n_records, is_multi)"""
    return records.groupBy("file").agg(F.count("*").alias("n_records")).withColumn("is_multi", F.col("n_records") != 1)


#: Lines of a file that are put in order together.
CHUNK = 1 << 16


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, m, line): the lines that aren't empty, with their numbers from 1 in their file, and from 1 in all files by name.

    Files are read in blocks, by as many tasks as Spark cuts them into. A line's number in its block is that of its task less the block's first; the blocks before it, of which there are
    few, are counted and added up.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r", "").alias("line"))
    lines = read.where("line <> ''").withColumn("at", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("lines").over(own), F.lit(0)).alias("own"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("all"))
    place = F.col("at") - F.col("first") + 1
    return lines.join(starts, ["file", "block"]).select("file", (place + F.col("own")).alias("n"), (place + F.col("all")).alias("m"), "line")


def _with_next(lines: DataFrame) -> DataFrame:
    """Adds after: the line behind, or null. A join on the number, so a long file is not one task."""
    behind = lines.select("file", (F.col("n") - 1).alias("n"), F.col("line").alias("after"))
    return lines.join(behind, ["file", "n"], "left")


def _with_last(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the last value that isn't null of the line and those before it in its file: within chunks of CHUNK lines, and from the chunks before."""
    marked = lines.withColumns({"_chunk": F.floor((F.col("n") - 1) / CHUNK), "_value": value})
    w = Window.partitionBy("file", "_chunk").orderBy("n")
    inside = marked.withColumn(name, F.last("_value", ignorenulls=True).over(w))
    ends = marked.where("_value IS NOT NULL").groupBy("file", "_chunk").agg(F.max_by("_value", "n").alias("_end"))
    # a row for each chunk
    chunks = marked.select("file", "_chunk").distinct().join(ends, ["file", "_chunk"], "left")
    earlier = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("file", "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return inside.join(carried, ["file", "_chunk"]).withColumn(name, F.coalesce(name, "_carried")).drop("_chunk", "_value", "_carried")


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """(id, consensus) of a list of repeats by the file's ending: .txt (one a line, ids SAMPLE_n), .tsv or .tab (id, consensus), else FASTA (first line of each sequence)."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "txt":
        return _numbered_lines(spark, path).select(F.concat(F.lit("SAMPLE_"), F.col("m")).alias("id"), F.trim("line").alias("consensus"))
    if end in ("tsv", "tab"):
        return spark.read.csv(path, sep="\t", schema="id string, consensus string")
    first = F.substring_index(F.regexp_replace("value", "^>[^\n]*\n|^[^\n>]*\n", ""), "\n", 1)
    lines = spark.read.option("lineSep", "\n>").text(path)
    return lines.where(F.trim("value") != "").select(F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "").alias("id"), F.upper(F.trim(first)).alias("consensus"))


def read_pairs(spark: SparkSession, path: str, longest: int = 55) -> DataFrame:
    """(file, begin_first, begin_second, length, sequence): a line of `>` and fields (1: length, 2 and 5: starts), the sequence in the next line."""
    lines = _with_next(_numbered_lines(spark, path)).withColumnRenamed("after", "sequence")
    fields = F.split(F.trim("line"), r"\s+")
    return lines.where("line LIKE '>%'").select(
        "file", F.get(fields, F.lit(2)).cast("bigint").alias("begin_first"), F.get(fields, F.lit(5)).cast("bigint").alias("begin_second"),
        F.least(F.get(fields, F.lit(1)).cast("int"), F.lit(longest)).alias("length"), F.substring("sequence", 1, longest).alias("sequence"),
    )


def read_orfs(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, start, end, complement, confidence): CDS lines under the last DEFINITION, confidence on the line behind."""
    lines = _with_last(_with_next(_numbered_lines(spark, path)), F.when(F.col("line").startswith("DEFINITION"), F.col("line")), "definition")
    return lines.where("line RLIKE '^ *CDS '").select(
        "file", F.regexp_extract("definition", 'seqhdr="([^"]*)"', 1).alias("id"), F.regexp_extract("line", r"<?(\d+)\.\.", 1).cast("bigint").alias("start"), F.regexp_extract("line", r"\.\.>?(\d+)", 1).cast("bigint").alias("end"),
        F.col("line").contains("complement").alias("complement"), F.regexp_extract("after", r"conf=([0-9.]+)", 1).cast("double").alias("confidence"),
    )


def read_hmm_scores(spark: SparkSession, path: str) -> DataFrame:
    """(target, score, e_value): the best score of each target in tables whose other lines start with #."""
    fields = F.split(F.trim("line"), r"\s+")
    rows = _numbered_lines(spark, path).where("line NOT LIKE '#%'").select(F.get(fields, F.lit(0)).alias("target"), F.get(fields, F.lit(5)).cast("double").alias("score"), F.get(fields, F.lit(4)).cast("double").alias("e_value"))
    return rows.groupBy("target").agg(F.max("score").alias("score"), F.min("e_value").alias("e_value"))


def read_alignment_scores(spark: SparkSession, path: str, queries: DataFrame | None = None) -> DataFrame:
    """(query, score): the last field of the first line of each query; 0.0 for the others of `queries`."""
    fields = F.split(F.trim("line"), r"\t")
    lines = _numbered_lines(spark, path).select(F.get(fields, F.lit(0)).alias("query"), F.element_at(fields, -1).cast("double").alias("score"), "file", "n")
    first = lines.groupBy("query").agg(F.min_by("score", F.struct("file", "n")).alias("score"))
    return first if queries is None else queries.select("query").join(first, "query", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """(id, sequence, energy) of records of three lines: the first number of the third line."""
    lines = _numbered_lines(spark, path).withColumns({"record": F.floor((F.col("n") - 1) / 3), "part": F.pmod(F.col("n") - 1, F.lit(3))})
    wide = lines.groupBy("file", "record").agg(*(F.max(F.when(F.col("part") == k, F.col("line"))).alias(x) for k, x in enumerate(("id", "sequence", "structure"))))
    return wide.select(F.regexp_replace("id", "^>", "").alias("id"), "sequence", F.regexp_extract("structure", r"(-?\d+(?:\.\d+)?)", 1).cast("double").alias("energy"))


def read_genes(spark: SparkSession, path: str, holds: str = "cas") -> DataFrame:
    """(start, end, kind) of annotated proteins whose annotation (column 6) holds a word."""
    rows = spark.read.csv(path, schema="c0 string, start bigint, end bigint, c3 string, c4 string, kind string").where("start IS NOT NULL")
    return rows.where(F.lower("kind").contains(holds)).select("start", "end", "kind")


def read_cassettes(spark: SparkSession, genes: str, labels: str) -> DataFrame:
    """(id, start, end, kind): the extent of each cassette's genes (columns 2, 3 and 7), with its label (columns 2 and 5)."""
    rows = spark.read.csv(genes, schema="c0 string, start bigint, end bigint, c3 string, c4 string, c5 string, id string").where("start IS NOT NULL")
    extents = rows.groupBy("id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return extents.join(spark.read.csv(labels, schema="c0 string, id string, c2 string, c3 string, kind string").select("id", "kind"), "id")


CANDIDATE = "struct<repeat_begins:array<int>,repeats:array<string>,repeats_gaped:array<string>,spacers:array<string>>"


def read_candidates(lines: DataFrame, column: str = "value") -> DataFrame:
    """Candidates from their JSON, one a row."""
    return lines.select(F.from_json(column, CANDIDATE).alias("c")).select("c.*")


def as_rna(records: DataFrame) -> DataFrame:
    return records.withColumn("seq", S.to_rna(F.col("seq")))


def parse_id(sample: Column) -> Column:
    """accession-program_start_end-strand as a struct."""
    parts = F.split(sample, "-")
    middle = F.split(F.get(parts, F.lit(1)), "_")
    return F.struct(F.get(parts, F.lit(0)).alias("accession"), F.get(middle, F.lit(0)).alias("program"), F.get(middle, F.lit(1)).cast("int").alias("start"), F.get(middle, F.lit(2)).cast("int").alias("end"), F.get(parts, F.lit(2)).alias("strand"))
