"""The library's functions for SQL text: scalar ones as SQL functions, which Spark inlines, and table functions in Python, by name.

register(spark) makes them temporary functions of a session; scalar ones can be added with scalar(), table functions with table().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

#: name: (arguments, type, what it returns)
SCALAR: dict[str, tuple[str, str, str]] = {}
#: name: (handler, schema)
TABLE: dict[str, tuple[type, str]] = {}


def scalar(name: str, arguments: str, kind: str, returns: str) -> None:
    SCALAR[name] = (arguments, kind, returns)


def table(name: str, schema: str):
    def add(handler: type) -> type:
        TABLE[name] = (handler, schema)
        return handler

    return add


scalar("reverse_complement", "seq STRING", "STRING", "reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))")
scalar("base_share", "seq STRING, bases STRING", "DOUBLE", "CASE WHEN length(seq) > 0 THEN (length(seq) - length(translate(seq, bases, ''))) / length(seq) ELSE 0.0D END")
scalar("core_place", "seq STRING", "INT", "CAST(length(seq) DIV 2 - 9 AS INT)")


@table("substrings_holding", "w string")
class SubstringsHolding:
    """The different substrings of more than `size` letters that hold the `size` letters at the place `at` (from 1)."""

    def eval(self, seq: str, at: int, size: int) -> Iterator[tuple[str]]:
        if seq is None or at < 1 or len(seq) < at + size - 1:
            return
        found = {seq[i:j] for i in range(at) for j in range(at + size - 1, len(seq) + 1) if j - i > size}
        for w in sorted(found):
            yield (w,)


@table("hits_in_windows", "contig_id bigint, cluster_id bigint, pattern string, hit int, start int, end int, text string, substitutions int, insertions int, deletions int")
class HitsInWindows:
    """Of rows (contig_id, cluster_id, window, pattern), partitioned by (contig_id, cluster_id): each pattern's hits in its window. The patterns of a window are matched together when the partition ends."""

    def __init__(self):
        self.rows: dict[tuple, list[str]] = {}

    def eval(self, row: Row) -> None:
        self.rows.setdefault((row["contig_id"], row["cluster_id"], row["window"]), []).append(row["pattern"])

    def terminate(self) -> Iterator[tuple]:
        from ..operators import matching

        keys = list(self.rows)
        for w, k, found in matching.matches([x[2] or "" for x in keys], [[p or "" for p in self.rows[x]] for x in keys]):
            contig, cluster, window = keys[w]
            for n, at in enumerate(found.apart()):
                start, end, (i, d, s) = int(found.starts[at]), int(found.ends[at]), found.counts[at].tolist()
                yield contig, cluster, self.rows[keys[w]][k], n, start, end, window[start:end], s, i, d


def register(spark: SparkSession) -> None:
    for name, (arguments, kind, returns) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {returns}")
    for name, (handler, schema) in TABLE.items():
        spark.udtf.register(name, udtf(handler, returnType=schema))
