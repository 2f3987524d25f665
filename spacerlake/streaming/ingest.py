"""A folder of FASTA files as a stream: each file's contigs are worked on once, as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """(header, seq) of the records of files that appear in the folder."""
    records = spark.readStream.format("text").option("lineSep", "\n>").load(folder)
    body = F.regexp_replace("value", r"^>", "")
    rest = F.when(F.instr(body, "\n") > 0, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise("")
    return records.where(F.trim("value") != "").select(F.trim(F.substring_index(body, "\n", 1)).alias("header"), F.upper(F.regexp_replace(rest, r"\s", "")).alias("seq"))


def run_available(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies work to what is there and stops; each batch is its own folder, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
