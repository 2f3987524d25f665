"""Queries over the given tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import arrays as A
from ..operators import clusters, columns, intervals, pairs, routing
from ..sources import writers
from ..sources.fasta import letters_as_bases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig_id, seq): the documents' letters as bases."""
    return letters_as_bases(read(spark, sf_dir, "documents"), "doc_id", "text")


def _dna(text: str) -> str:
    return f"translate(upper(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g')), '{S.LETTERS}', '{S.BASES}')"


CONTIGS = f"contigs AS (SELECT doc_id AS contig_id, {_dna('text')} AS seq FROM documents)"
K, NEAR, FAR = pairs.K, pairs.NEAREST, pairs.FARTHEST
PAIRS = f"""{CONTIGS},
km AS (SELECT contig_id, b, substr(seq, b + 1, {K}) AS kmer FROM (SELECT contig_id, seq, unnest(range(0, len(seq) - {K - 1})) AS b FROM contigs WHERE len(seq) >= {K})),
nx AS (SELECT contig_id, b AS begin_first, lead(b) OVER (PARTITION BY contig_id, kmer ORDER BY b) AS begin_second, kmer FROM km),
pairs AS (SELECT * FROM nx WHERE begin_second - begin_first BETWEEN {NEAR} AND {FAR})"""
CLUSTERS = f"""{PAIRS},
fl AS (SELECT *, CASE WHEN begin_first - lag(begin_first) OVER (PARTITION BY contig_id ORDER BY begin_first) < {clusters.CLUSTER_GAP} THEN 0 ELSE 1 END AS f FROM pairs),
num AS (SELECT *, CAST(sum(f) OVER (PARTITION BY contig_id ORDER BY begin_first ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_id FROM fl),
clusters AS (SELECT contig_id, cluster_id, min(begin_first) AS b, max_by(begin_second, begin_first) + {K} AS e, count(*) AS n_pairs, list_sort(list(DISTINCT kmer)) AS repeats FROM num GROUP BY ALL)"""


# sequence scalars


@query(f"""WITH {CONTIGS} SELECT contig_id, CAST(len(seq) AS INT) AS n_bases, md5(seq) AS digest,
  round(CASE WHEN len(seq) > 0 THEN len(regexp_replace(seq, '[^AT]', '', 'g')) / CAST(len(seq) AS DOUBLE) ELSE 0 END, 9) AS at_richness FROM contigs""")
def contig_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("contig_id", F.length("seq").alias("n_bases"), F.md5("seq").alias("digest"), F.round(S.at_richness(F.col("seq")), 9).alias("at_richness"))


@query(f"""WITH {CONTIGS} SELECT contig_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS reverse_digest, md5(replace(seq, 'T', 'U')) AS rna_digest,
  md5(regexp_replace(coalesce(text, ''), '[^ACGT]', 'N', 'g')) AS canonical_digest FROM contigs JOIN documents ON doc_id = contig_id""")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    seq = S.dna_of(F.col("text"))
    return docs.select(
        F.col("doc_id").alias("contig_id"), F.md5(S.reverse_complement(seq)).alias("reverse_digest"), F.md5(S.to_rna(seq)).alias("rna_digest"),
        F.md5(S.canonical(F.coalesce("text", F.lit("")))).alias("canonical_digest"),
    )


@query(r"""SELECT page_id, translate(regexp_replace(split_part(url, ' ', 1), '\.[0-9]+$', ''), ',.|', '---') AS accession, translate(url, ',.| ', '____') AS full_name FROM pages""")
def header_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.accession_name(F.col("url")).alias("accession"), S.full_name(F.col("url")).alias("full_name"))


@query(f"""WITH s AS (SELECT item_id, {_dna('text')} AS seq FROM benchmark)
SELECT DISTINCT item_id, substr(seq, i + 1, len(seq) - i - j) AS trimmed FROM s, range(4) a(i), range(4) b(j) WHERE len(seq) > i + j""")
def end_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", S.dna_of(F.col("text")).alias("seq"))
    return items.select("item_id", F.explode(S.end_trims(F.col("seq"))).alias("trimmed"))


@query(f"""WITH s AS (SELECT item_id, {_dna('text')} AS seq FROM benchmark),
c AS (SELECT item_id, seq, len(seq) // 2 - 9 AS pos FROM s WHERE len(seq) >= 40),
x AS (SELECT DISTINCT item_id, substr(seq, i, j - i + 1) AS w FROM (SELECT item_id, seq, pos, i, unnest(range(pos + 20, len(seq) + 1)) AS j FROM (SELECT *, unnest(range(1, pos + 1)) AS i FROM c)) WHERE j - i + 1 > 21)
SELECT item_id, count(*) AS n_substrings, CAST(sum(len(w)) AS BIGINT) AS n_letters, min(w) AS least, max(w) AS greatest FROM x GROUP BY item_id""")
def core_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select("item_id", S.dna_of(F.col("text")).alias("seq")).where(F.length("seq") >= 40)
    found = items.select("item_id", F.explode(S.substrings_around(F.col("seq"), F.expr("cast(length(seq) div 2 - 9 AS int)"), F.lit(21))).alias("w"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_substrings"), F.sum(F.length("w")).alias("n_letters"), F.min("w").alias("least"), F.max("w").alias("greatest"))


# repeats and clusters


@query(f"WITH {PAIRS} SELECT contig_id, begin_first, begin_second FROM pairs")
def repeat_seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.repeat_pairs(contigs(spark, sf_dir))


@query(f"""WITH {CLUSTERS} SELECT contig_id, cluster_id, b AS "begin", e AS "end", n_pairs, len(repeats) AS n_repeats, md5(array_to_string(repeats, ',')) AS repeats_digest FROM clusters""")
def repeat_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contigs(spark, sf_dir)
    found = clusters.cluster_summary(clusters.number_pairs(pairs.repeat_pairs(own)), own, K)
    return found.select("contig_id", "cluster_id", "begin", "end", "n_pairs", F.size("repeats").cast("bigint").alias("n_repeats"), F.md5(F.array_join("repeats", ",")).alias("repeats_digest"))


@query(f"""WITH {CLUSTERS}, w AS (SELECT contig_id, cluster_id, greatest(b - {clusters.FLANK}, 0) AS s, least(e + {clusters.FLANK}, len(seq)) AS t, seq FROM clusters JOIN contigs USING (contig_id))
SELECT contig_id, cluster_id, s AS window_start, t AS window_end, md5(substr(seq, s + 1, t - s)) AS window_digest FROM w""")
def cluster_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contigs(spark, sf_dir)
    found = clusters.cluster_summary(clusters.number_pairs(pairs.repeat_pairs(own)), own, K)
    return clusters.cluster_windows(found, own).select("contig_id", "cluster_id", "window_start", "window_end", F.md5("window").alias("window_digest"))


@query()
def merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contigs(spark, sf_dir)
    found = clusters.cluster_summary(clusters.number_pairs(pairs.repeat_pairs(own)), own, K)
    return clusters.merge_neighbours(found, own).withColumn("n_repeats", F.size("repeats")).drop("repeats")


@query(f"""WITH {CONTIGS},
km AS (SELECT contig_id, b, substr(seq, b + 1, {K}) AS kmer FROM (SELECT contig_id, seq, unnest(range(0, len(seq) - {K - 1})) AS b FROM contigs WHERE len(seq) >= {K})),
cand AS (
  SELECT x.contig_id, x.b AS b, y.b AS c, x.kmer AS k, y.kmer AS l FROM km x JOIN km y ON x.contig_id = y.contig_id AND left(x.kmer, {K // 2}) = left(y.kmer, {K // 2}) AND y.b - x.b BETWEEN {NEAR} AND {FAR}
  UNION SELECT x.contig_id, x.b, y.b, x.kmer, y.kmer FROM km x JOIN km y ON x.contig_id = y.contig_id AND right(x.kmer, {K // 2}) = right(y.kmer, {K // 2}) AND y.b - x.b BETWEEN {NEAR} AND {FAR})
SELECT contig_id, b AS begin_first, min(c) AS begin_second FROM cand WHERE hamming(k, l) <= 1 GROUP BY ALL""")
def near_repeat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.near_repeat_pairs(contigs(spark, sf_dir))


_SEED = (K - 1) // 2
#: (more letters in the first copy, more in the second): a letter replaced, more in the second, more in the first; behind the run (1) or before it (-1).
_WAYS = ", ".join(f"({w}, {a}, {b}, {side})" for w, (a, b, side) in enumerate((a, b, side) for a, b in ((1, 1), (0, 1), (1, 0)) for side in (1, -1)))


@query(f"""WITH {CONTIGS},
km AS (SELECT contig_id, b, substr(seq, b + 1, {_SEED}) AS k FROM (SELECT contig_id, seq, unnest(range(0, len(seq) - {_SEED - 1})) AS b FROM contigs WHERE len(seq) >= {K})),
sd AS (SELECT x.contig_id, y.b - x.b AS d, x.b FROM km x JOIN km y ON x.contig_id = y.contig_id AND x.k = y.k AND y.b - x.b BETWEEN 1 AND {pairs.REACH + 1}),
rn AS (SELECT contig_id, d, min(b) AS s, max(b) + {_SEED} AS e FROM (SELECT *, b - row_number() OVER (PARTITION BY contig_id, d ORDER BY b) AS g FROM sd) GROUP BY contig_id, d, g),
wy AS (SELECT rn.*, w, ma, mb, side, CASE WHEN side = 1 THEN e + ma ELSE s - ma END AS x, CASE WHEN side = 1 THEN e + d + mb ELSE s + d - mb END AS y FROM rn, (VALUES {_WAYS}) t(w, ma, mb, side)),
nr AS (SELECT wy.*, CASE WHEN y <= x THEN 0 WHEN side = 1 THEN len(list_filter(range(1, {_SEED + 1}), lambda t: y + t <= len(seq) AND substr(seq, x + 1, t) = substr(seq, y + 1, t)))
  ELSE len(list_filter(range(1, {_SEED + 1}), lambda t: x - t >= 0 AND y <= len(seq) AND substr(seq, x - t + 1, t) = substr(seq, y - t + 1, t))) END AS n FROM wy JOIN contigs USING (contig_id)),
fr AS (SELECT nr.*, CASE WHEN n < {_SEED} THEN n WHEN side = 1 THEN r.e - x ELSE x - r.s END AS m
  FROM nr LEFT JOIN rn r ON n = {_SEED} AND r.contig_id = nr.contig_id AND r.d = y - x AND x - CASE WHEN side = 1 THEN 0 ELSE 1 END BETWEEN r.s AND r.e - 1),
gr AS (SELECT contig_id, d, s, -1 AS w, s AS b1, s + d AS b2, e - s AS l1, e - s AS l2, 0 AS edits FROM rn
  UNION ALL SELECT contig_id, d, s, w, CASE WHEN side = 1 THEN s ELSE x - m END, CASE WHEN side = 1 THEN s + d ELSE y - m END, e - s + ma + m, e - s + mb + m, 1 FROM fr WHERE m > 0),
ok AS (SELECT *, row_number() OVER (PARTITION BY contig_id, d, s ORDER BY l1 + l2 DESC, w) AS o FROM gr WHERE least(l1, l2) >= {K} AND b2 - b1 - l1 BETWEEN {pairs.GAP[0]} AND {pairs.GAP[1]} AND b2 - b1 BETWEEN 1 AND {pairs.REACH})
SELECT DISTINCT contig_id, b1 AS begin_first, b2 AS begin_second, CAST(l1 AS INT) AS length_first, CAST(l2 AS INT) AS length_second, edits, substr(seq, b1 + 1, least(l1, {pairs.LONGEST})) AS repeat FROM ok JOIN contigs USING (contig_id) WHERE o = 1""")
def maximal_repeat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of at most one edit, letters put in or left out included, as long as they can be."""
    return pairs.maximal_pairs(contigs(spark, sf_dir))


def _alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-mers of a cluster's pairs as the rows of an alignment, the sources' line beginnings of K letters being far less alike."""
    own = contigs(spark, sf_dir)
    numbered = clusters.number_pairs(pairs.repeat_pairs(own)).join(own, "contig_id")
    return numbered.select("contig_id", "cluster_id", F.col("begin_first").alias("row"), F.expr(f"substring(seq, cast(begin_first AS int) + 1, {K})").alias("aligned"))


ALIGNED = f"""{CLUSTERS},
cell AS (SELECT contig_id, cluster_id, begin_first AS r, col, substr(kmer, col + 1, 1) AS c FROM num, range({K}) t(col)),
cnt AS (SELECT contig_id, cluster_id, col, c, count(*) AS n, min(r) AS first_row FROM cell GROUP BY ALL),
con AS (SELECT contig_id, cluster_id, col, c FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, cluster_id, col ORDER BY n DESC, first_row, c) AS rn FROM cnt) WHERE rn = 1)"""


@query(f"WITH {ALIGNED} SELECT contig_id, cluster_id, string_agg(c, '' ORDER BY col) AS consensus FROM con GROUP BY ALL")
def column_mode_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.consensus(_alignments(spark, sf_dir), ["contig_id", "cluster_id"]).select("contig_id", "cluster_id", "consensus")


@query(f"""WITH {ALIGNED} SELECT contig_id, cluster_id, r AS "row", count(*) FILTER (cell.c <> con.c) AS substitutions FROM cell JOIN con USING (contig_id, cluster_id, col) GROUP BY ALL""")
def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["contig_id", "cluster_id"]
    rows = _alignments(spark, sf_dir)
    return columns.mismatches(rows, columns.consensus(rows, keys), keys).select(*keys, "row", "substitutions")


@query(f"""WITH {ALIGNED},
sh AS (SELECT contig_id, cluster_id, col, max(n) / CAST(sum(n) AS DOUBLE) AS share, sum(n) AS rows_ FROM cnt GROUP BY ALL),
e AS (SELECT contig_id, cluster_id, bool_and(share >= CASE WHEN rows_ <= 4 THEN 0.49 ELSE 0.6 END) FILTER (col < 3 OR col >= {K - 3}) AS edges_pass, count(*) FILTER (share < 0.66) AS n_bad FROM sh GROUP BY ALL)
SELECT contig_id, cluster_id, edges_pass, n_bad, n_bad <= 5 AS columns_pass FROM e""")
def column_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["contig_id", "cluster_id"]
    rows = _alignments(spark, sf_dir)
    edges = columns.edge_dominance(rows, keys).withColumnRenamed("passes", "edges_pass")
    return edges.join(columns.consistency(rows, keys).withColumnRenamed("passes", "columns_pass"), keys)


# arrays: a conversation's user turns stand for repeats, the assistant's for spacers

TALK = A.Limits(min_repeats=2, min_repeat=50, max_repeat=600, min_spacer=100, max_spacer=1500, long_spacer=1200, long_share=0.6, long_most=2, most_equal=1, most_in_row=1)


def _talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def of(role: str) -> F.Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])

    return turns.groupBy("conv_id").agg(of("user").alias("repeats"), of("assistant").alias("spacers"))


TALKS = """talks AS (SELECT conv_id, coalesce(list(coalesce(text, '') ORDER BY turn, text) FILTER (role = 'user'), []) AS r, coalesce(list(coalesce(text, '') ORDER BY turn, text) FILTER (role = 'assistant'), []) AS s FROM conversations GROUP BY conv_id)"""
_EVEN = "list_transform([0, 1, 2, 3, 4, 5], lambda b: len(list_filter(s, lambda x: (CASE WHEN len(x) <= 15 THEN 0 WHEN len(x) <= 25 THEN 1 WHEN len(x) <= 36 THEN 2 WHEN len(x) <= 52 THEN 3 WHEN len(x) <= 72 THEN 4 ELSE 5 END) = b)) / CAST(len(s) AS DOUBLE))"


@query(f"""WITH {TALKS} SELECT conv_id, len(r) AS number_repeats, coalesce(list_max(list_transform(r, lambda x: len(x))), 0) AS repeat_len,
  CASE WHEN len(s) > 0 THEN round(list_avg(list_transform(s, lambda x: len(x))), 6) ELSE 0 END AS avg_spacer_len,
  round(CASE WHEN len(regexp_replace(array_to_string(r, ''), '[^ACGT]', '', 'g')) > 0 THEN len(regexp_replace(array_to_string(r, ''), '[^AT]', '', 'g')) / CAST(len(regexp_replace(array_to_string(r, ''), '[^ACGT]', '', 'g')) AS DOUBLE) ELSE 0 END, 6) AS at_richness,
  CASE WHEN len(s) > 0 THEN round(-list_sum(list_transform({_EVEN}, lambda p: p * ln(p + 1e-8))) / ln(6.0), 6) + 0.0 ELSE 0 END AS spacer_evenness FROM talks""")
def array_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.features(_talks(spark, sf_dir))
    return found.select("conv_id", *(F.col(x).cast("bigint") for x in ("number_repeats", "repeat_len")), F.round("avg_spacer_len", 6).alias("avg_spacer_len"), F.round("at_richness", 6).alias("at_richness"), "spacer_evenness")


@query(f"""WITH {TALKS}, m AS (SELECT *, list_avg(list_transform(r, lambda x: len(x))) AS mr, list_avg(list_transform(s, lambda x: len(x))) AS ms, len(list_filter(s, lambda x: len(x) > 1200)) AS nl, list_filter(s, lambda x: x <> '') AS f FROM talks),
e AS (SELECT conv_id, max(n1) / CAST(max(t) AS DOUBLE) AS s1, max(n2) / CAST(max(t) AS DOUBLE) AS s2, max(n3) AS most FROM (SELECT conv_id, len(f) AS t, len(list_filter(f, lambda y: left(y, 1) = left(x, 1))) AS n1, len(list_filter(f, lambda y: right(y, 1) = right(x, 1))) AS n2, len(list_filter(f, lambda y: y = x)) AS n3 FROM (SELECT conv_id, f, unnest(f) AS x FROM m)) GROUP BY conv_id)
SELECT conv_id, len(r) >= 2 AS min_repeats, coalesce(mr <= 600, false) AS repeat_max, coalesce(mr >= 50, false) AS repeat_min, coalesce(ms > 100, false) AS spacer_min, coalesce(ms <= 1500, false) AS spacer_max,
  len(s) = 0 OR (nl <= 2 AND nl <= 0.6 * len(s)) AS long_spacers, len(f) < 2 OR (s1 <= 0.8 AND s2 <= 0.8) AS spacer_edges, coalesce(most, 0) <= 1 AS equal_spacers FROM m LEFT JOIN e USING (conv_id)""")
def array_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _talks(spark, sf_dir).select("conv_id", *(c.alias(name) for name, c in A.checks(TALK).items()))


@query("""WITH r AS (SELECT conv_id, turn, len(coalesce(text, '')) // 200 AS n FROM conversations WHERE role = 'assistant'),
w AS (SELECT *, lag(n, 1) OVER o AS a, lag(n, 2) OVER o AS b, lead(n, 1) OVER o AS c, lead(n, 2) OVER o AS d, count(*) OVER (PARTITION BY conv_id) AS k FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN k <= 2 THEN true WHEN b IS NOT NULL AND d IS NOT NULL THEN a = b AND a = c AND a = d AND n <> a
  WHEN a IS NULL THEN c = d AND n <> c WHEN b IS NULL THEN a = c AND c = coalesce(d, c) AND n <> c
  WHEN c IS NULL THEN a = b AND n <> a ELSE a = b AND a = c AND n <> a END AS suspicious FROM w""")
def neighbour_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.expr("length(coalesce(text, '')) div 200").alias("size"))
    return A.neighbour_outliers(turns, ["conv_id"], "turn", "size").select("conv_id", "turn", "suspicious")


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, event_type, g, count(*) AS n FROM e GROUP BY ALL), f AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, (SELECT max(n) FROM r WHERE r.user_id = u.user_id) AS longest_run, (SELECT max(n) FROM f WHERE f.user_id = u.user_id) AS most_frequent FROM (SELECT DISTINCT user_id FROM events) u""")
def identical_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = clusters.islands(events, ["user_id"], ["ts", "event_id"], F.col("event_type") != F.lag("event_type").over(w), "run").groupBy("user_id", "run").agg(F.count("*").alias("n"))
    most = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("most_frequent"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest_run")).join(most, "user_id")


@query("""WITH c AS (SELECT source, left(text, 1) AS a, right(text, 1) AS b FROM documents WHERE text <> ''),
f AS (SELECT source, max(n) AS n FROM (SELECT source, a, count(*) AS n FROM c GROUP BY ALL) GROUP BY source), l AS (SELECT source, max(n) AS n FROM (SELECT source, b, count(*) AS n FROM c GROUP BY ALL) GROUP BY source), t AS (SELECT source, count(*) AS t FROM c GROUP BY source)
SELECT source, round(f.n / CAST(t AS DOUBLE), 9) AS first_share, round(l.n / CAST(t AS DOUBLE), 9) AS last_share, t < 2 OR (f.n <= 0.8 * t AND l.n <= 0.8 * t) AS passes FROM t JOIN f USING (source) JOIN l USING (source)""")
def edge_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode shares of the first and last characters of a source's texts, as counts of counts, so that no source meets in one place."""
    edges = read(spark, sf_dir, "documents").where("text <> ''").select("source", F.explode(F.array(F.struct(F.lit("first").alias("side"), F.substring("text", 1, 1).alias("c")), F.struct(F.lit("last").alias("side"), F.substring("text", -1, 1).alias("c")))).alias("e"))
    counts = edges.groupBy("source", "e.side", "e.c").agg(F.count("*").alias("n")).groupBy("source", "side").agg((F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("n"))
    wide = counts.groupBy("source").agg(*(F.max(F.when(F.col("side") == x, F.col("share"))).alias(x) for x in ("first", "last")), F.max("n").alias("n"))
    return wide.select("source", F.round("first", 9).alias("first_share"), F.round("last", 9).alias("last_share"), ((F.col("n") < 2) | ((F.col("first") <= 0.8) & (F.col("last") <= 0.8))).alias("passes"))


# ranking and routing


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return routing.best_of(items, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey")])


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_totalprice, o_totalprice > 300000 AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, bool_or(p) OVER (PARTITION BY o_custkey) AS a FROM o) WHERE p OR (NOT a AND rn = 1)""")
def filter_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return routing.filter_or_best(orders, ["o_custkey"], F.col("o_totalprice") > 300000, [F.desc("o_totalprice"), F.col("o_orderkey")])


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with the share of e among letters as a score, in regions of 4 neighbouring ids; labels tell which pass."""
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    score = F.least(F.lit(1.0), F.round(6 * F.length(F.regexp_replace("text", "[^e]", "")) / F.greatest(F.length("text"), F.lit(1)), 6))
    return docs.select("doc_id", "source", F.expr("doc_id div 16").alias("region"), F.coalesce(score, F.lit(0.0)).alias("score"), (F.col("quality") == 1).alias("passes"))


SCORED = """sc AS (SELECT d.doc_id, source, d.doc_id // 16 AS region, coalesce(least(1.0, round(6 * len(regexp_replace(text, '[^e]', '', 'g')) / CAST(greatest(len(text), 1) AS DOUBLE), 6)), 0) AS score, quality = 1 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
rk AS (SELECT *, score >= 0.75 AND p AS st, score >= 0.5 AND score < 0.75 AS bt FROM sc),
rw AS (SELECT *, bool_or(st) OVER (PARTITION BY region) AS a, row_number() OVER (PARTITION BY region, st ORDER BY score DESC, doc_id) AS f, row_number() OVER (PARTITION BY region, bt ORDER BY score DESC, doc_id) AS g FROM rk),
routed AS (SELECT doc_id, region, score, CASE WHEN st THEN CASE WHEN f = 1 THEN 'bona_fide' ELSE 'alternative' END WHEN score >= 0.75 THEN 'low_score'
  WHEN bt AND a AND score >= 0.6 THEN CASE WHEN p THEN 'alternative' ELSE 'low_score' END WHEN bt AND a THEN NULL
  WHEN bt AND g = 1 THEN CASE WHEN p THEN 'possible' ELSE 'low_score' END WHEN bt THEN 'possible_discarded' ELSE 'low_score' END AS category FROM rw)"""


@query(f"WITH {SCORED} SELECT * FROM routed WHERE category IS NOT NULL")
def five_way_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(_scored(spark, sf_dir), ["region"], "score", "passes", "doc_id").select("doc_id", "region", "score", "category")


@query(f"""WITH {SCORED}, x AS (SELECT doc_id, category, region // 8 AS contig, region, min(CASE WHEN category IN ('bona_fide', 'alternative') THEN 0 WHEN category = 'possible' THEN 1 WHEN category = 'possible_discarded' THEN 2 ELSE 3 END) OVER (PARTITION BY region) AS k FROM routed WHERE category IS NOT NULL)
SELECT doc_id, category, contig, region, dense_rank() OVER (PARTITION BY contig ORDER BY k, region) AS region_index FROM x""")
def region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route(_scored(spark, sf_dir), ["region"], "score", "passes", "doc_id").select("doc_id", "category", F.expr("region div 8").alias("contig"), "region", F.col("region").alias("region_end"))
    return routing.region_index(routed, "contig", "region", "region_end").select("doc_id", "category", "contig", "region", F.col("region_index").cast("bigint"))


# intervals

_SECONDS = "epoch_us(ts) // 1000000"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"))


def _sessions(events: DataFrame, gap: int = 3600) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("pos", "event_id")
    numbered = clusters.islands(events, ["user_id"], ["pos", "event_id"], F.col("pos") - F.lag("pos").over(w) >= gap, "session")
    return numbered.groupBy("user_id", "session").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.min_by("event_type", F.struct("pos", "event_id")).alias("first_type"))


SESSIONS = f"""ev AS (SELECT event_id, user_id, event_type, value, {_SECONDS} AS pos FROM events),
mk AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) < 3600 THEN 0 ELSE 1 END AS f FROM ev),
nu AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM mk),
ses AS (SELECT user_id, session, min(pos) AS s, max(pos) AS e, count(*) AS n, arg_min(event_type, (pos, event_id)) AS first_type FROM nu GROUP BY ALL)"""


@query(f"""WITH {SESSIONS} SELECT user_id, session, s AS "start", e AS "end", n, first_type FROM ses""")
def gene_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(_events(spark, sf_dir))


_ORDER_SPAN = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders"


@query("""SELECT event_id, user_id, pos FROM (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS pos, event_type FROM events) p WHERE event_type <> 'purchase' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = p.user_id AND p.pos BETWEEN epoch_us(b.ts) // 1000000 - 1800 AND epoch_us(b.ts) // 1000000 + 1800)""")
def interval_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside half an hour around any purchase of their user."""
    events = _events(spark, sf_dir)
    around = events.where("event_type = 'purchase'").select("user_id", (F.col("pos") - 1800).alias("start"), (F.col("pos") + 1800).alias("end"))
    others = events.where("event_type <> 'purchase'").select("event_id", "user_id", "pos")
    return intervals.points_in_intervals(others, around, "user_id", "pos", "start", "end", 3600, "left_anti")


@query(f"""WITH {SESSIONS}, big AS (SELECT user_id, s, e FROM ses WHERE n >= 3), sm AS (SELECT user_id, s FROM ses WHERE n < 3),
g AS (SELECT user_id, row_number() OVER w AS gap_ix, lag(e) OVER w AS gs, s AS ge FROM big WINDOW w AS (PARTITION BY user_id ORDER BY s, e) UNION ALL SELECT user_id, count(*) + 1, max_by(e, (s, e)), NULL FROM big GROUP BY user_id)
SELECT sm.user_id, sm.s AS pos, min(gap_ix) AS gap_ix FROM sm JOIN g ON sm.user_id = g.user_id AND sm.s >= coalesce(gs, sm.s) AND (ge IS NULL OR sm.s < ge) GROUP BY ALL""")
def gap_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sessions, each in the gap between its user's longer ones. The gap is the number of longer sessions that end before, found by a running count."""
    sessions = _sessions(_events(spark, sf_dir))
    long_ = sessions.where("n >= 3")
    edges = long_.select("user_id", F.col("end").alias("pos"), F.lit(1).alias("passed"), F.lit(0).alias("short")).unionByName(sessions.where("n < 3").select("user_id", F.col("start").alias("pos"), F.lit(0).alias("passed"), F.lit(1).alias("short")))
    w = Window.partitionBy("user_id").orderBy("pos", "short").rowsBetween(Window.unboundedPreceding, 0)
    has = long_.select("user_id").distinct()
    return edges.withColumn("gap_ix", F.sum("passed").over(w) + 1).where("short = 1").join(has, "user_id", "left_semi").select("user_id", "pos", "gap_ix").distinct()


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS pos, event_type FROM events),
j AS (SELECT a.event_id, a.user_id, a.pos, b.event_id AS purchase_id, abs(a.pos - b.pos) AS distance, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.pos - b.pos), b.event_id) AS rn
  FROM e a LEFT JOIN e b ON b.event_type = 'purchase' AND a.user_id = b.user_id AND abs(a.pos - b.pos) <= 10000 WHERE a.event_type = 'error')
SELECT event_id, user_id, pos, purchase_id, distance FROM j WHERE rn = 1""")
def nearest_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "pos")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("pos").alias("bought"), F.col("event_id").alias("purchase_id"))
    return intervals.nearest_within(errors, buys, "user_id", "pos", "bought", "purchase_id", 10000).select("event_id", "user_id", "pos", "near.purchase_id", "near.distance")


@query(f"""WITH {SESSIONS} SELECT ses.user_id, ses.session, coalesce(max(v.value), 0) AS best FROM ses LEFT JOIN ev v ON v.user_id = ses.user_id AND v.event_type = 'view' AND v.pos BETWEEN s AND e GROUP BY ALL""")
def range_join_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return intervals.best_in_interval(_sessions(events), events.where("event_type = 'view'"), "user_id", "session", "start", "end", "pos", "value", 7200)


@query(f"""WITH {SESSIONS}, w AS (SELECT *, s - lag(e) OVER o AS b, lead(s) OVER o - e AS a FROM ses WINDOW o AS (PARTITION BY user_id ORDER BY s, e))
SELECT user_id, session, s - CASE WHEN b IS NULL OR b > 7200 THEN 3600 WHEN b <= 0 THEN 0 ELSE b // 2 END AS left_bound, e + CASE WHEN a IS NULL OR a > 7200 THEN 3600 WHEN a <= 0 THEN 0 ELSE a // 2 END AS right_bound FROM w""")
def flank_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.flanks(_sessions(_events(spark, sf_dir)), "user_id", "start", "end", F.lit(3600), F.lit(7200)).select("user_id", "session", "left_bound", "right_bound")


@query("""SELECT DISTINCT a.doc_id, md5(a.text) AS digest FROM documents a JOIN documents b ON a.text = b.text AND a.source <> b.source""")
def conflict_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text occurs under another source too: by a grouping, not by pairs."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", F.md5("text").alias("digest"))
    conflicts = docs.groupBy("digest").agg(F.min("source").alias("a"), F.max("source").alias("b")).where("a <> b")
    return docs.join(conflicts, "digest", "left_semi").select("doc_id", "digest").distinct()


@query("""SELECT p_brand, count(*) AS n_items, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def cassette_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents per part are found before the labels are joined, so the join moves one row for each part."""
    extents = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    named = extents.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return named.groupBy("p_brand").agg(F.sum("n").alias("n_items"), F.min("a").alias("first_ship"), F.max("b").alias("last_ship"))


@query("""WITH x AS (SELECT l_orderkey, min(l_discount) AS a, max(l_extendedprice) AS b, max(l_quantity) FILTER (l_returnflag = 'R') AS c FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CAST(coalesce(a, 0) AS DOUBLE) AS mfe_score, CAST(coalesce(b, 0) AS DOUBLE) AS orf_score, CAST(coalesce(c, 0) AS DOUBLE) AS blast_score FROM orders LEFT JOIN x ON l_orderkey = o_orderkey""")
def feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of several providers beside each order, 0 where a provider has none: one shuffle for all of them."""
    items = read(spark, sf_dir, "lineitem")

    def scores(rows: DataFrame, value: F.Column) -> DataFrame:
        return rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(value.alias("score"))

    tables = {"mfe_score": scores(items, F.min("l_discount")), "orf_score": scores(items, F.max("l_extendedprice")), "blast_score": scores(items.where("l_returnflag = 'R'"), F.max("l_quantity"))}
    return intervals.with_scores(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], tables)


@query(f"""WITH {SESSIONS}, a AS (SELECT user_id, session, s, e FROM ses WHERE first_type = 'error'), b AS (SELECT user_id, session AS t, s, e FROM ses WHERE first_type = 'purchase'),
j AS (SELECT a.user_id, a.session, t, least(abs(a.s - b.e), abs(a.e - b.s)) AS distance FROM a JOIN b ON a.user_id = b.user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY distance, t) AS rn FROM j WHERE distance <= 10000)
SELECT a.user_id, a.session, a.s AS "start", a.e AS "end", k.t AS near_session, k.distance FROM a LEFT JOIN k ON a.user_id = k.user_id AND a.session = k.session AND rn = 1""")
def nearest_cassettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that begin with an error, each with the nearest of its user's that begin with a purchase, by the nearer of both ends."""
    found = _sessions(_events(spark, sf_dir)).select("user_id", "session", "start", "end", "first_type")
    left = found.where("first_type = 'error'").drop("first_type")
    right = found.where("first_type = 'purchase'").select("user_id", F.col("session").alias("near_session"), F.col("start").alias("s"), F.col("end").alias("e"))
    near = intervals.nearest_interval(left, right, "user_id", ("start", "end"), ("s", "e"), "near_session", 10000)
    return near.select("user_id", "session", "start", "end", "near.near_session", "near.distance")


@query(f"""WITH {SCORED} SELECT region // 8 AS "Name", row_number() OVER (ORDER BY region // 8, region, doc_id) AS "Global ID", doc_id AS "ID", category AS "Category" FROM routed WHERE category IS NOT NULL""")
def rollup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contigs' rows in one list, numbered through."""
    routed = routing.route(_scored(spark, sf_dir), ["region"], "score", "passes", "doc_id").select(F.expr("region div 8").alias("Name"), "region", F.col("doc_id").alias("ID"), F.col("category").alias("Category"))
    return writers.rollup(routed, "Name", ["region", "ID"]).select("Name", "Global ID", "ID", "Category")


@query(f"""WITH {SCORED} SELECT region // 8 AS contig_id, category, doc_id AS id, CAST(region AS BIGINT) AS "start", score FROM routed WHERE category IS NOT NULL""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested JSON of every contig, parsed once and flattened again."""
    routed = routing.route(_scored(spark, sf_dir), ["region"], "score", "passes", "doc_id")
    empty = F.array().cast("array<string>")
    arrays = routed.select(
        F.expr("region div 8").alias("contig_id"), F.col("doc_id").alias("id"), F.lit(1).alias("region_index"), "category", F.col("region").alias("start"), (F.col("region") + 1).alias("end"), F.lit("Forward").alias("strand"), "score",
        F.lit("ACGT").alias("consensus"), F.array(F.lit("ACGT")).alias("repeats"), empty.alias("spacers"), F.array(F.lit(0)).alias("starts"),
    )
    parsed = writers.array_json(arrays).select("contig_id", F.from_json("document", "Arrays map<string,map<string,struct<start:bigint,certainty_score:double>>>").alias("d"))
    return parsed.select("contig_id", F.explode("d.Arrays").alias("category", "of")).select("contig_id", "category", F.explode("of").alias("id", "a")).select("contig_id", "category", F.col("id").cast("bigint"), (F.col("a.start") - 1).alias("start"), F.col("a.certainty_score").alias("score"))


@query(f"""WITH {SCORED}, l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS r FROM documents),
a AS (SELECT region // 8 AS contig_id, category, r.doc_id AS id, score, region, r, coalesce(r[1], '') AS c, list_transform(r[2:], lambda x: reverse(x)) AS g FROM routed r JOIN l ON r.doc_id = l.doc_id WHERE category IS NOT NULL),
d AS (SELECT *, list_transform(range(1, len(r) + 1), lambda i: lpad(CAST(i AS VARCHAR), 10, ' ') || '  ' || CASE WHEN len(r[i]) = len(c) THEN array_to_string(list_transform(range(1, len(c) + 1), lambda j: CASE WHEN r[i][j] = c[j] AND c[j] = ' ' THEN ' ' WHEN r[i][j] = c[j] THEN '.' ELSE r[i][j] END), '') ELSE r[i] END || '  ' || coalesce(g[i], '')) AS shown FROM a)
SELECT contig_id, category, id, md5(array_to_string(r, chr(10))) AS repeats, md5(array_to_string(g, chr(10))) AS spacers, md5(array_to_string(list_transform(range(1, len(r) + 1), lambda i: CAST(i AS VARCHAR)), ',')) AS starts, md5(c) AS consensus,
  md5(array_to_string(shown, chr(10)) || chr(10) || repeat('_', 100) || chr(10) || repeat(' ', 12) || c) AS dots, CASE WHEN id % 2 = 0 THEN 'Forward' ELSE 'Reverse' END AS strand, CAST(region + 1 AS BIGINT) AS "start", CAST(region + len(r) AS BIGINT) AS "end", CAST(len(r) AS BIGINT) AS length, id % 7 AS array_index, score FROM d""")
def json_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested JSON of every contig, all its fields read back: documents' lines stand for repeats, and their turned ones for spacers."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    texts = read(spark, sf_dir, "documents").select("doc_id", lines.alias("repeats"))
    routed = routing.route(_scored(spark, sf_dir), ["region"], "score", "passes", "doc_id").where("category IS NOT NULL").select("doc_id", "region", "category", "score").join(texts, "doc_id")
    n = F.size("repeats")
    arrays = routed.select(
        F.expr("region div 8").alias("contig_id"), F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("region_index"), "category", F.col("region").alias("start"), (F.col("region") + n).alias("end"), F.when(F.col("doc_id") % 2 == 0, "Forward").otherwise("Reverse").alias("strand"), "score",
        F.coalesce(F.get("repeats", F.lit(0)), F.lit("")).alias("consensus"), "repeats", F.transform(F.slice("repeats", 2, F.greatest(n - 1, F.lit(0))), F.reverse).alias("spacers"), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")).alias("starts"),
    )
    fields = "list_repeats array<string>, list_spacers array<string>, list_repeat_starts array<int>, consensus_repeat string, dot_representation string, strand string, start bigint, end bigint, length bigint, array_index bigint, certainty_score double"
    one = F.from_json("document", "Arrays map<string,map<string,struct<" + fields.replace(" array<", ":array<").replace(" string", ":string").replace(" bigint", ":bigint").replace(" double", ":double") + ">>>")
    parsed = writers.array_json(arrays).select("contig_id", one.alias("d")).select("contig_id", F.explode("d.Arrays").alias("category", "of")).select("contig_id", "category", F.explode("of").alias("id", "a"))
    joined = lambda c, by: F.md5(F.array_join(F.col(f"a.{c}").cast("array<string>"), by))
    return parsed.select(
        "contig_id", "category", F.col("id").cast("bigint"), joined("list_repeats", "\n").alias("repeats"), joined("list_spacers", "\n").alias("spacers"), joined("list_repeat_starts", ",").alias("starts"), F.md5("a.consensus_repeat").alias("consensus"),
        F.md5("a.dot_representation").alias("dots"), "a.strand", "a.start", "a.end", "a.length", "a.array_index", F.col("a.certainty_score").alias("score"),
    )
