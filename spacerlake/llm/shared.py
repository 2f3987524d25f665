"""Reading the given tables, keeping intermediate tables, and the columns of `documents`."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_row() -> Column:
    """What tells rows (doc_id, text) apart, never null: documents may share a doc_id, or have none."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and the master is local, as in
    tests, it is set to a new temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_llm_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="llm-")
        atexit.register(shutil.rmtree, own, True)
        base = spark._llm_scratch = f"file://{own}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() has written and that nothing reads any more: what was made from them has been stored."""
    for x in tables:
        jvm, conf = x.sparkSession._jvm, x.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(x.stored_at)
        path.getFileSystem(conf).delete(path, True)


_HELD: dict[str, object] = {}


def held_by_worker(key: str, make: Callable[[], object]) -> object:
    """What make() gives, kept in this Python worker for its later tasks, until another key is asked for: a worker holds one such thing."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(batches: Iterator[pa.RecordBatch], held: str | None = None, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches' rows, so many at a time, for functions that turn them into Python values. What the worker holds for other work than the key held goes first."""
    if held not in _HELD:
        _HELD.clear()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
