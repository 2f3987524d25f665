"""Queries of the kernel, the searches, the models and the whole report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import tables
from ..operators import approximate
from ..operators import arrays as A
from ..operators import clusters, columns, kernel, neighbours, pairs, scoring, search
from . import arrays as plan
from .queries import ALIGNED, CLUSTERS, CONTIGS, K, _alignments, _dna, contigs, query, read

_R, _D = kernel.RADIUS, kernel.DISTANCE


@query(f"""WITH {CLUSTERS}, sq AS (SELECT contig_id, cluster_id, unnest(repeats) AS s FROM clusters),
ps AS (SELECT *, unnest(range(0, len(s))) AS i FROM sq),
lt AS (SELECT contig_id, cluster_id, s, i, j, CASE WHEN i - j < 0 THEN '$' ELSE substr(s, i - j + 1, 1) END AS a, CASE WHEN i + j >= len(s) THEN '$' ELSE substr(s, i + j + 1, 1) END AS b FROM ps, range({_R + 1}) t(j)),
nb AS (SELECT contig_id, cluster_id, s, i, string_agg(least(a, b) || greatest(a, b), '' ORDER BY j) OVER (PARTITION BY contig_id, cluster_id, s, i ORDER BY j ROWS UNBOUNDED PRECEDING) AS n, j AS r FROM lt),
pr AS (SELECT x.contig_id, x.cluster_id, x.s, x.r, y.i - x.i AS d, x.n AS a, y.n AS b FROM nb x JOIN nb y ON x.contig_id = y.contig_id AND x.cluster_id = y.cluster_id AND x.s = y.s AND x.r = y.r AND y.i - x.i BETWEEN 0 AND {_D}),
ft AS (SELECT contig_id, cluster_id, s, r, d, 'P' || least(a, b) || '-' || greatest(a, b) AS f, CASE WHEN d = 0 THEN 1 ELSE 2 END AS w FROM pr UNION ALL SELECT contig_id, cluster_id, s, r, d, 'H' || a, 1 FROM pr UNION ALL SELECT contig_id, cluster_id, s, r, d, 'H' || b, 1 FROM pr WHERE d > 0),
ct AS (SELECT contig_id, cluster_id, s, r, d, f, CAST(sum(w) AS DOUBLE) AS c FROM ft GROUP BY ALL),
nm AS (SELECT contig_id, cluster_id, s, r, d, sqrt(sum(c * c)) AS q FROM ct GROUP BY ALL), gr AS (SELECT contig_id, cluster_id, s, sqrt(count(*)) AS g FROM nm GROUP BY ALL),
sm AS (SELECT contig_id, cluster_id, r, d, f, sum(c / q / g) AS v FROM ct JOIN nm USING (contig_id, cluster_id, s, r, d) JOIN gr USING (contig_id, cluster_id, s) GROUP BY ALL),
sz AS (SELECT contig_id, cluster_id, count(*) AS n FROM sq GROUP BY ALL)
SELECT contig_id, cluster_id, n AS n_sequences, round(CASE WHEN n = 1 THEN 1 ELSE (sum(v * v) - n) / (n * n - n) END, 6) AS similarity FROM sm JOIN sz USING (contig_id, cluster_id) GROUP BY contig_id, cluster_id, n""")
def kernel_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contigs(spark, sf_dir)
    found = clusters.cluster_summary(clusters.number_pairs(pairs.repeat_pairs(own)), own, K)
    repeats = found.select("contig_id", "cluster_id", F.explode("repeats").alias("s"))
    return kernel.mean_similarity(repeats, ["contig_id", "cluster_id"], "s").withColumn("similarity", F.round("similarity", 6))


_SHARE = "len(regexp_replace({0}, '[^{1}]', '', 'g')) / CAST(greatest(len({0}), 1) AS DOUBLE)"


@query(f"""WITH {CONTIGS}, p AS (SELECT contig_id, round(1 / (1 + exp(-20 * ({_SHARE.format('seq', 'A')} - {_SHARE.format('seq', 'T')}))), 6) AS forward, round(1 / (1 + exp(20 * ({_SHARE.format('seq', 'A')} - {_SHARE.format('seq', 'T')}))), 6) AS reverse FROM contigs)
SELECT contig_id, forward, reverse, CASE WHEN forward > reverse THEN 'Forward' ELSE 'Reverse' END AS strand, CASE WHEN greatest(forward, reverse) >= 0.7 THEN 'High' WHEN greatest(forward, reverse) >= 0.5 THEN 'Medium' ELSE 'Low' END AS confidence FROM p""")
def orientation_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of each contig, scored by the surplus of A over T."""
    both = scoring.with_reverse(contigs(spark, sf_dir), "seq")
    surplus = (S.base_count(F.col("seq"), "A") - S.base_count(F.col("seq"), "T")) / F.greatest(F.length("seq"), F.lit(1))
    return scoring.orientation(both.withColumn("score", F.round(1 / (1 + F.exp(-20 * surplus)), 6)), "contig_id", "score")


@query()
def fuzzy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan.searches(contigs(spark, sf_dir))
    return found.select("contig_id", "cluster_id", "pattern", F.posexplode("hits").alias("hit", "h")).select("contig_id", "cluster_id", "pattern", "hit", "h.start", "h.end", "h.text", F.col("h.s").alias("substitutions"), F.col("h.i").alias("insertions"), F.col("h.d").alias("deletions"))


@query()
def candidate_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan.detect(contigs(spark, sf_dir))
    return found.withColumn("aligned", search.aligned("repeats", "pattern")).select("contig_id", "cluster_id", "pattern", "key", "edits", F.array_join("aligned", "\n").alias("aligned"), F.array_join("spacers", ",").alias("spacers"))


#: Bounds for texts, whose repeats are phrases.
TEXT_LIMITS = A.Limits(min_repeats=2, min_repeat=15, max_repeat=60, min_spacer=0, max_spacer=300, most_equal=8, most_in_row=8, edge_share=1.0)


@query()
def refined_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contigs(spark, sf_dir)
    found = plan.refined(plan.evaluate(plan.detect(own), TEXT_LIMITS), own, TEXT_LIMITS)
    return found.select("contig_id", "cluster_id", "pattern", "start", "end", "category", "score", F.array_join("repeats", ",").alias("repeats"), F.array_join("spacers", ",").alias("spacers"))


@query()
def array_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.array_report(contigs(spark, sf_dir), TEXT_LIMITS)


def line_shapes(docs: DataFrame) -> DataFrame:
    """Features of the lines of (doc_id, text), which count as both repeats and spacers, and the text."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return A.features(docs.select("doc_id", lines.alias("repeats"), lines.alias("spacers"), "text"))


@query()
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models learn the labelled documents' quality from the shape of their lines, and score all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbers = line_shapes(docs).select(
        "doc_id", *(F.col(c).cast("double") for c in ("number_repeats", "repeat_len", "avg_spacer_len", "at_richness", "spacer_evenness")),
        F.log1p(F.length("text").cast("double")).alias("letters"), F.coalesce(S.mode_share(F.col("repeats")), F.lit(0.0)).alias("repeat_similarity"),
    )
    sets = {8: ["repeat_similarity", "avg_spacer_len", "spacer_evenness", "letters"], 9: ["number_repeats", "repeat_similarity", "spacer_evenness"], 10: ["repeat_len", "at_richness", "avg_spacer_len", "letters"]}
    known = numbers.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return scoring.fit_ensemble(known, "label", sets).score(numbers).select("doc_id", "score_8", "score_9", "score_10", "score")


#: Letters whose numbers place a document among the others, besides its length.
COUNTED = (" ", "\n", "e", "t")


@query("""WITH d AS (SELECT doc_id, len(x) AS a, len(x) - len(replace(x, ' ', '')) AS b, len(x) - len(replace(x, chr(10), '')) AS c, len(x) - len(replace(x, 'e', '')) AS e, len(x) - len(replace(x, 't', '')) AS f FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
k AS (SELECT d.*, toxic FROM d JOIN labels USING (doc_id)),
p AS (SELECT d.doc_id, k.doc_id AS other, toxic, CAST((d.a - k.a) ** 2 + (d.b - k.b) ** 2 + (d.c - k.c) ** 2 + (d.e - k.e) ** 2 + (d.f - k.f) ** 2 AS DOUBLE) AS distance FROM d, k),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, other) AS o FROM p)
SELECT doc_id, string_agg(other, ',' ORDER BY o) AS nearest, max(distance) AS farthest, round(avg(toxic), 9) AS share FROM r WHERE o <= 7 GROUP BY doc_id""")
def nearest_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's 7 nearest labelled documents by length and numbers of some letters, and the share of toxic ones among them."""
    text = F.coalesce("text", F.lit(""))
    numbers = F.array(F.length(text), *(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in COUNTED)).cast("array<double>")
    docs = read(spark, sf_dir, "documents").select("doc_id", numbers.alias("x")).persist()  # read seven times: six numbers a document instead of its text; what is lost with an executor is made again
    known = docs.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    found = neighbours.nearest(docs, known, "x", "doc_id", "toxic")
    told = found.select("x", F.array_join(F.transform("neighbours", lambda n: n["id"].cast("string")), ",").alias("nearest"), F.array_max(F.transform("neighbours", lambda n: n["distance"])).alias("farthest"), F.round(neighbours.vote(), 9).alias("share"))
    return docs.join(told, "x").select("doc_id", "nearest", "farthest", "share")


@query(f"""WITH {CONTIGS} SELECT contig_id, count(*) FILTER (fr IS NOT NULL) AS n_frames, CAST(max(n) AS INT) AS longest FROM (
  SELECT contig_id, fr, coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(substr(s, fr), '(...)', '\\1 ', 'g'), '(?:^| )(ATG(?: (?:[ACG][ACGT][ACGT]|T[CT][ACGT]|TA[CT]|TG[CGT]))*) (?:TAA|TAG|TGA)', 1), lambda x: (len(x) + 1) // 4)), 0) AS n
  FROM (SELECT contig_id, unnest([seq, reverse(translate(seq, 'ACGT', 'TGCA'))]) AS s FROM contigs), range(1, 4) t(fr)) GROUP BY contig_id""")
def open_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contigs(spark, sf_dir).select("contig_id", F.lit(6).cast("bigint").alias("n_frames"), scoring.longest_orf(F.col("seq")).alias("longest"))


@query()
def expanded_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged clusters with their consensus strings, the parts of longer repeats that hold shorter ones, and all trims."""
    own = contigs(spark, sf_dir)
    merged = clusters.merge_neighbours(clusters.cluster_summary(clusters.number_pairs(pairs.repeat_pairs(own)), own, K), own)
    found = approximate.trimmed(approximate.completed(approximate.with_consensus(merged, ["contig_id", "cluster_id"])))
    return found.select("contig_id", "cluster_id", "begin", "end", F.size("repeats").alias("n_repeats"), F.md5(F.array_join("repeats", ",")).alias("repeats_digest"))


@query(f"""WITH {ALIGNED}, q AS (SELECT contig_id || ':' || cluster_id AS query, string_agg(c, '' ORDER BY col) AS seq FROM con GROUP BY contig_id, cluster_id),
d AS (SELECT item_id, {_dna('text')} AS seq FROM benchmark),
h AS (SELECT query, item_id, a - b AS g, count(*) AS n FROM (SELECT query, a, substr(seq, a, 6) AS w FROM (SELECT *, unnest(range(1, len(seq) - 4)) AS a FROM q)) x JOIN (SELECT item_id, b, substr(seq, b, 6) AS w FROM (SELECT *, unnest(range(1, len(seq) - 4)) AS b FROM d WHERE len(seq) >= 6)) y ON x.w = y.w GROUP BY ALL),
r AS (SELECT query, item_id, n, row_number() OVER (PARTITION BY query ORDER BY n DESC, item_id) AS rn FROM h)
SELECT q.query, coalesce(2 * n + 5, 0) AS score, item_id FROM q LEFT JOIN r ON q.query = r.query AND rn = 1""")
def seed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus of each cluster against the test items as a library of known sequences."""
    agreed = columns.consensus(_alignments(spark, sf_dir), ["contig_id", "cluster_id"])
    asked = agreed.select(F.concat_ws(":", "contig_id", "cluster_id").alias("query"), F.col("consensus").alias("seq"))
    known = read(spark, sf_dir, "benchmark").select("item_id", S.dna_of(F.col("text")).alias("seq"))
    return scoring.seed_scores(asked, known, "query", "item_id")


@query(f"""WITH {ALIGNED}, q AS (SELECT contig_id || ':' || cluster_id AS query, string_agg(c, '' ORDER BY col) AS q FROM con GROUP BY contig_id, cluster_id),
k AS (SELECT item_id, {_dna('text')} AS t FROM benchmark),
st AS (SELECT sum(n) AS total, sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE) AS p FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(t, '')) AS c FROM k) WHERE c <> '' GROUP BY c)),
la AS (SELECT total, p, ((1 - p) + sqrt((1 - p) * (1 - p) + 4 * p * (1 - p))) / (2 * p) AS x FROM st),
ks AS (SELECT total, ln(x) AS l, (p * x - 2 * (1 - p) / (x * x)) * (1 - 1 / x) AS kk FROM la),
dg AS (SELECT DISTINCT query, item_id, b - a AS d FROM (SELECT query, a, substr(q, a, 6) AS w FROM (SELECT *, unnest(range(1, len(q) - 4)) AS a FROM q)) x JOIN (SELECT item_id, b, substr(t, b, 6) AS w FROM (SELECT *, unnest(range(1, len(t) - 4)) AS b FROM k WHERE len(t) >= 6)) y ON x.w = y.w),
ps AS (SELECT query, item_id, d, i, sum(CASE WHEN substr(q, i, 1) = substr(t, i + d, 1) THEN 1 ELSE -2 END) OVER (PARTITION BY query, item_id, d ORDER BY i) AS s
  FROM (SELECT *, unnest(range(greatest(1, 1 - d), least(len(q), len(t) - d) + 1)) AS i FROM dg JOIN q USING (query) JOIN k USING (item_id))),
al AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY query, item_id, d ORDER BY i), 0) AS before FROM ps),
sg AS (SELECT x.query, x.item_id, x.d, x.i AS a, y.i AS b, y.s - x.before AS score FROM al x JOIN al y ON x.query = y.query AND x.item_id = y.item_id AND x.d = y.d AND y.i >= x.i),
sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, item_id, d ORDER BY score DESC, b, a DESC) AS o FROM sg) WHERE o = 1),
bt AS (SELECT query, item_id, d, a, b, score, (l * score - ln(kk)) / ln(2) AS bits, len(q) * CAST(total AS DOUBLE) AS size FROM sc JOIN q USING (query), ks),
be AS (SELECT *, size * pow(2.0, -bits) AS expected, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id, a, a + d) AS o FROM bt WHERE size * pow(2.0, -bits) < 10)
SELECT q.query, item_id, CAST(coalesce(score, 0) AS INT) AS score, round(coalesce(bits, 0), 6) AS bits, round(expected, 9) AS expected, a AS q_start, b AS q_end, a + d AS k_start, b + d AS k_end FROM q LEFT JOIN be ON q.query = be.query AND o = 1""")
def alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ungapped segment of each cluster's consensus in the test items, with bits and what is expected by chance."""
    agreed = columns.consensus(_alignments(spark, sf_dir), ["contig_id", "cluster_id"])
    asked = agreed.select(F.concat_ws(":", "contig_id", "cluster_id").alias("query"), F.col("consensus").alias("seq"))
    known = read(spark, sf_dir, "benchmark").select("item_id", S.dna_of(F.col("text")).alias("seq"))
    found = scoring.segment_scores(asked, known, "query", "item_id")
    return found.withColumns({"bits": F.round("bits", 6), "expected": F.round("expected", 9)})


@query(f"""WITH {CLUSTERS}, x AS (SELECT contig_id, cluster_id, b, e, seq, len(regexp_replace(seq, '[^A]', '', 'g')) >= len(regexp_replace(seq, '[^T]', '', 'g')) AS f FROM clusters JOIN contigs USING (contig_id)),
y AS (SELECT *, substr(seq, greatest(b - 200, 0) + 1, b - greatest(b - 200, 0)) AS p, substr(seq, e + 1, 200) AS q FROM x)
SELECT contig_id, cluster_id, CASE WHEN f THEN p ELSE reverse(translate(q, 'ACGT', 'TGCA')) END AS leader, CASE WHEN f THEN q ELSE reverse(translate(p, 'ACGT', 'TGCA')) END AS downstream FROM y""")
def leader_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = contigs(spark, sf_dir)
    found = clusters.cluster_summary(clusters.number_pairs(pairs.repeat_pairs(own)), own, K)
    strands = own.select("contig_id", F.when(S.base_count(F.col("seq"), "A") >= S.base_count(F.col("seq"), "T"), "Forward").otherwise("Reverse").alias("strand"))
    return A.surroundings(found.withColumnRenamed("begin", "start").join(strands, "contig_id"), own).select("contig_id", "cluster_id", "leader", "downstream")


_CODES = "CASE string_agg(c, '' ORDER BY c) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TRANSITIONS.items()) + " ELSE arg_min(c, (-n, first_row, c)) END"


@query(f"WITH {ALIGNED}, z AS (SELECT contig_id, cluster_id, col, {_CODES} AS c FROM cnt GROUP BY contig_id, cluster_id, col) SELECT contig_id, cluster_id, string_agg(c, '' ORDER BY col) AS consensus FROM z GROUP BY ALL")
def transition_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.ambiguous_consensus(_alignments(spark, sf_dir), ["contig_id", "cluster_id"])


@query("""WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, len(coalesce(text, '')) AS a, CASE WHEN nr = 'assistant' THEN len(coalesce(nt, '')) ELSE 0 END AS b FROM p WHERE role = 'user')
SELECT conv_id, turn, CAST(coalesce(sum(a + b) OVER w, 0) AS BIGINT) AS "start", CAST(coalesce(sum(a + b) OVER w, 0) + a AS BIGINT) AS "end" FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    w = columns.Window.partitionBy("conv_id").orderBy("turn")
    parts = turns.withColumn("behind", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w))).where("role = 'user'")
    return A.repeat_intervals(parts, ["conv_id"], "turn", "text", "behind")


@query("""WITH s AS (SELECT round(len(regexp_replace(coalesce(text, ''), '[^e]', '', 'g')) / CAST(greatest(len(coalesce(text, '')), 1) AS DOUBLE), 6) AS s, toxic AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT s, sum(y) AS a, count(*) AS n FROM s GROUP BY s), b AS (SELECT *, coalesce(sum(n - a) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM g)
SELECT round(sum(a * (l + (n - a) / 2.0)) / (sum(a) * (sum(n) - sum(a))), 9) AS auc, CAST(sum(n) AS BIGINT) AS n FROM b""")
def ranking_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    share = F.round(F.length(F.regexp_replace(text, "[^e]", "")) / F.greatest(F.length(text), F.lit(1)), 6)
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select(share.alias("s"), F.col("toxic").alias("y"))
    return scoring.ranking_auc(rows, "s", "y").select(F.round("auc", 9).alias("auc"), "n")


@query(f"""WITH s AS (SELECT item_id, {_dna('text')} AS seq FROM benchmark),
c AS (SELECT item_id, seq, len(seq) // 2 - 9 AS pos FROM s WHERE len(seq) >= 40),
x AS (SELECT DISTINCT item_id, substr(seq, i, j - i + 1) AS w FROM (SELECT item_id, seq, pos, i, unnest(range(pos + 20, len(seq) + 1)) AS j FROM (SELECT *, unnest(range(1, pos + 1)) AS i FROM c)) WHERE j - i + 1 > 21)
SELECT item_id, round({_SHARE.format('any_value(seq)', 'AT')}, 9) AS at_share, md5(reverse(translate(any_value(seq), 'ACGT', 'TGCA'))) AS turned, count(*) AS n_substrings, CAST(sum(len(w)) AS BIGINT) AS n_letters, min(w) AS least, max(w) AS greatest
FROM x JOIN c USING (item_id) GROUP BY item_id""")
def substrings_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """core_substrings in SQL text over the registered functions, with two scalar ones."""
    tables.register(spark)
    read(spark, sf_dir, "benchmark").select("item_id", S.dna_of(F.col("text")).alias("seq")).createOrReplaceTempView("bases_of_items")
    return spark.sql("""
        SELECT item_id, round(any_value(base_share(seq, 'AT')), 9) AS at_share, any_value(md5(reverse_complement(seq))) AS turned, count(*) AS n_substrings, sum(length(w)) AS n_letters, min(w) AS least, max(w) AS greatest
        FROM (SELECT *, core_place(seq) AS place FROM bases_of_items WHERE length(seq) >= 40) i, LATERAL substrings_holding(i.seq, i.place, 21) GROUP BY item_id""")
