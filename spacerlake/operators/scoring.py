"""Scores of arrays: an ensemble of classifiers on feature subsets, orientation, conflicts of samples, and simple providers."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from .neighbours import nearest, vote
from .trees import ExtraTrees, fit_extra_trees

#: The features of each model.
FEATURE_SETS = {
    8: ["repeat_similarity", "avg_spacer_len", "spacer_similarity", "number_mismatches", "spacer_evenness", "mfe_score", "orf_score", "blast_score_1"],
    9: ["number_repeats", "repeat_similarity", "avg_spacer_len", "spacer_similarity", "spacer_evenness", "mfe_score", "orf_score", "hmmr_score", "blast_score_2"],
    10: ["repeat_len", "repeat_similarity", "at_richness", "avg_spacer_len", "spacer_similarity", "number_mismatches", "spacer_evenness", "hmmr_score", "blast_score_1", "blast_score_2"],
}


@dataclass
class Ensemble:
    """Models by size; a score is the mean of their probabilities of class 1. Extra trees and labelled points come with their features' names; a missing feature counts as 0 for them.

    Labelled points are a table (_x, id, y), of which the 7 nearest vote; a row that has none, as with an infinite feature, gets 0.5.
    """

    models: dict[int, PipelineModel | tuple[list[str], ExtraTrees | DataFrame]]

    def score(self, rows: DataFrame) -> DataFrame:
        columns, names = rows.columns, []
        for size, model in self.models.items():
            name = f"score_{size}"
            if isinstance(model, tuple) and isinstance(model[1], DataFrame):
                x = rows.withColumn("_x", _numbers(model[0]))
                votes = nearest(x, model[1], "_x", "id", "y").select(F.col("x").alias("_x"), vote().alias(name))
                rows = x.join(votes, "_x", "left").select(*columns, *names, F.coalesce(name, F.lit(0.5)).alias(name))
            elif isinstance(model, tuple):
                rows = rows.withColumn(name, model[1].probability(_numbers(model[0])))
            else:
                rows = model.transform(rows).select(*columns, *names, vector_to_array(f"probability_{size}")[1].alias(name))
            names.append(name)
        total = F.lit(0.0)
        for name in names:
            total = total + F.col(name)
        return rows.withColumn("score", total / len(names))


def _numbers(names: list[str]) -> Column:
    return F.array(*(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in names))


def fit_ensemble(rows: DataFrame, label: str, sets: dict[int, list[str]] = FEATURE_SETS, kind: str = "extra", seed: int = 1, id_: str = "id") -> Ensemble:
    """Fits a model for each feature set: extremely randomised trees ("extra"), the 7 nearest rows, of equally near ones those of the least id_ ("neighbours"), a random forest of depth 4 ("forest"), boosted trees ("boosted"), or a logistic regression."""
    models = {}
    for size, names in sets.items():
        if kind == "extra":
            models[size] = names, fit_extra_trees(rows.select(_numbers(names).alias("x"), F.col(label).alias("y")), "x", "y", seed=seed)
            continue
        if kind == "neighbours":
            models[size] = names, rows.where(F.col(label).isNotNull()).select(_numbers(names).alias("_x"), F.col(id_).alias("id"), F.col(label).alias("y"))
            continue
        common = {"labelCol": label, "featuresCol": f"features_{size}", "probabilityCol": f"probability_{size}", "rawPredictionCol": f"raw_{size}", "predictionCol": f"prediction_{size}"}
        if kind == "forest":
            stage = RandomForestClassifier(numTrees=30, maxDepth=4, featureSubsetStrategy="sqrt", seed=seed, **common)
        elif kind == "boosted":
            stage = GBTClassifier(maxIter=10, maxDepth=3, seed=seed, **common)
        else:
            stage = LogisticRegression(**common)
        models[size] = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol=f"features_{size}", handleInvalid="keep"), stage]).fit(rows)
    return Ensemble(models)


def with_reverse(rows: DataFrame, seq: str) -> DataFrame:
    """Each row and its reverse complement, labelled 1 and 0."""
    return rows.withColumn("label", F.lit(1)).unionByName(rows.withColumns({seq: S.reverse_complement(F.col(seq)), "label": F.lit(0)}))


def orientation(scored: DataFrame, key: str, score: str) -> DataFrame:
    """(key, forward, reverse, strand, confidence) of rows labelled 1 and 0 for both readings; a tie is Reverse."""
    both = scored.groupBy(key).agg(F.max(F.when(F.col("label") == 1, F.col(score))).alias("forward"), F.max(F.when(F.col("label") == 0, F.col(score))).alias("reverse"))
    best = F.greatest("forward", "reverse")
    return both.withColumns({
        "strand": F.when(F.col("forward") > F.col("reverse"), "Forward").otherwise("Reverse"),
        "confidence": F.when(best >= 0.7, "High").when(best >= 0.5, "Medium").otherwise("Low"),
    })


def without_conflicts(left: DataFrame, right: DataFrame, consensus: str) -> DataFrame:
    """Rows of left whose consensus doesn't occur in right."""
    return left.join(right.select(consensus).distinct(), consensus, "left_anti")


def longest_orf(seq: Column) -> Column:
    """Length in codons of the longest open reading frame (ATG to a stop) on either strand."""

    def frames(s: Column) -> list[Column]:
        return [F.regexp_replace(F.substring(s, k, 1 << 30), "(...)", "$1 ") for k in (1, 2, 3)]

    def longest(s: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(s, F.lit(r"(?:^| )(ATG(?: (?!TAA|TAG|TGA)[ACGT]{3})*) (?:TAA|TAG|TGA)"), 1), lambda x: (F.length(x) + 1) / 4)
        return F.coalesce(F.array_max(runs), F.lit(0.0))

    return F.greatest(*(longest(f) for s in (seq, S.reverse_complement(seq)) for f in frames(s))).cast("int")


def adjacent_similarity(arrays: DataFrame, contig: str, order: str, consensus: str, least: float = 0.9) -> DataFrame:
    """Pairs of neighbouring arrays of a contig whose consensus sequences agree: similarity is one minus edits by the longer length, coverage the shorter by the longer length."""
    w = Window.partitionBy(contig).orderBy(order)
    following = arrays.withColumns({"next_order": F.lead(order).over(w), "next_consensus": F.lead(consensus).over(w)})
    share = 1 - F.levenshtein(consensus, "next_consensus") / F.greatest(F.length(consensus), F.length("next_consensus"), F.lit(1))
    coverage = F.least(F.length(consensus), F.length("next_consensus")) / F.greatest(F.length(consensus), F.length("next_consensus"), F.lit(1))
    return following.where("next_consensus IS NOT NULL").withColumns({"similarity": share, "coverage": coverage}).where((F.col("similarity") >= least - 5e-5) & (F.col("coverage") >= least - 5e-5))


def seed_scores(queries: DataFrame, known: DataFrame, query: str, known_id: str, seq: str = "seq", k: int = 6) -> DataFrame:
    """(query, score, known_id): the known sequence with the most equal k-mers on one diagonal, and twice that plus k - 1; 0 without any.

    A k-mer is counted once for each place; those of both sides meet in a hash join on the k-mer.
    """

    def kmers(rows: DataFrame, name: str, place: str) -> DataFrame:
        own = rows.where(F.length(seq) >= k).select(name, seq, F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias(place))
        return own.select(name, place, F.expr(f"substring({seq}, {place}, {k})").alias("kmer"))

    hits = kmers(queries, query, "a").join(kmers(known, known_id, "b"), "kmer")
    diagonals = hits.groupBy(query, known_id, (F.col("a") - F.col("b")).alias("diagonal")).agg(F.count("*").alias("n"))
    best = diagonals.groupBy(query).agg(F.min_by(F.struct("n", known_id), F.struct(-F.col("n"), known_id)).alias("best"))
    return queries.select(query).distinct().join(best, query, "left").select(query, F.coalesce(2 * F.col("best.n") + k - 1, F.lit(0)).alias("score"), F.col(f"best.{known_id}").alias(known_id))


#: Scores of equal and different letters on a diagonal. The closed forms below hold for these.
MATCH, MISMATCH = 1, -2


def score_statistics(same: float) -> tuple[float, float]:
    """(lambda, K) of the greatest ungapped segments between random sequences whose letters are equal with chance `same`.

    lambda solves same * e^l + (1 - same) * e^(-2 l) = 1, a cubic in e^l that has the root 1; K is H / lambda * (1 - e^-lambda), as the greatest score of a letter is 1.
    """
    other = 1 - same
    root = (other + math.sqrt(other * other + 4 * same * other)) / (2 * same)
    scale = math.log(root)
    return scale, (MATCH * same * root + MISMATCH * other / root**2) * (1 - 1 / root)


def segment_scores(queries: DataFrame, known: DataFrame, query: str, known_id: str, seq: str = "seq", k: int = 6, most_expected: float = 10.0) -> DataFrame:
    """(query, known_id, score, bits, expected, q_start, q_end, k_start, k_end): each query's best ungapped segment in the known sequences; 0 and nulls without one.

    Diagonals on which a k-mer is equal (a hash join) are searched in full: the segment of the greatest score, of several the one that ends first and then the shortest. Scores become bits by
    the known sequences' letter frequencies, and are left out if so many or more are expected by chance in as much sequence. Of a query's segments the best score counts, then the
    least known_id, then the first in the query, then in the known sequence. Places count from 1, both ends included. Queries are short: a diagonal is no longer than one.
    """
    letters = known.select(F.explode(F.split(seq, "")).alias("c")).where("c <> ''").groupBy("c").count().agg(F.sum("count").alias("n"), (F.sum(F.col("count") * F.col("count")) / (F.sum("count") * F.sum("count"))).alias("same")).first()
    total, same = letters["n"] or 0, letters["same"] or 0.25
    scale, factor = score_statistics(min(max(same, 1e-6), 1 - 1e-6))

    def kmers(rows: DataFrame, name: str, place: str) -> DataFrame:
        own = rows.where(F.length(seq) >= k).select(name, seq, F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias(place))
        return own.select(name, place, F.expr(f"substring({seq}, {place}, {k})").alias("kmer"))

    diagonals = kmers(queries, query, "a").join(kmers(known, known_id, "b"), "kmer").select(query, known_id, (F.col("b") - F.col("a")).alias("d")).distinct()
    texts = diagonals.join(queries.select(query, F.col(seq).alias("q")), query).join(known.select(known_id, F.col(seq).alias("t")), known_id)
    first = F.greatest(F.lit(0), -F.col("d"))  # letters of the query before the diagonal
    size = F.least(F.length("q") - first, F.length("t") - first - F.col("d"))
    cut = texts.select(query, known_id, "d", first.alias("first"), F.substr("q", first + 1, size).alias("q"), F.substr("t", first + F.col("d") + 1, size).alias("t"))
    start = F.struct(*(F.lit(0).alias(x) for x in ("at", "run", "since", "best", "begin", "end")))

    def step(a, equal):
        fresh = a["run"] <= 0
        run = F.when(fresh, 0).otherwise(a["run"]) + F.when(equal, MATCH).otherwise(MISMATCH)
        since = F.when(fresh, a["at"]).otherwise(a["since"])
        better = run > a["best"]
        return F.struct((a["at"] + 1).alias("at"), run.alias("run"), since.alias("since"), F.when(better, run).otherwise(a["best"]).alias("best"), F.when(better, since).otherwise(a["begin"]).alias("begin"), F.when(better, a["at"] + 1).otherwise(a["end"]).alias("end"))

    equal = F.zip_with(F.split("q", ""), F.split("t", ""), lambda x, y: x == y)
    found = cut.select(query, known_id, "d", "first", F.aggregate(F.slice(equal, 1, F.length("q")), start, step).alias("s"))
    told = found.select(query, known_id, F.col("s.best").alias("score"), (F.col("first") + F.col("s.begin") + 1).alias("q_start"), (F.col("first") + F.col("s.end")).alias("q_end"), (F.col("first") + F.col("d") + F.col("s.begin") + 1).alias("k_start"), (F.col("first") + F.col("d") + F.col("s.end")).alias("k_end"))
    bits = (F.lit(scale) * F.col("score") - math.log(factor)) / math.log(2)
    sized = told.join(queries.select(query, F.length(seq).alias("_n")), query).withColumn("bits", bits).withColumn("expected", F.col("_n") * F.lit(float(total)) * F.pow(F.lit(2.0), -F.col("bits")))
    columns = ["score", "bits", "expected", "q_start", "q_end", "k_start", "k_end"]
    best = sized.where(F.col("expected") < most_expected).groupBy(query).agg(F.min_by(F.struct(known_id, *columns), F.struct(-F.col("score"), known_id, "q_start", "k_start")).alias("best"))
    joined = queries.select(query).distinct().join(best, query, "left")
    return joined.select(query, F.col(f"best.{known_id}").alias(known_id), F.coalesce("best.score", F.lit(0)).alias("score"), F.coalesce("best.bits", F.lit(0.0)).alias("bits"), *(F.col(f"best.{c}").alias(c) for c in columns[2:]))


#: Ranges of scores whose rows are put in order together.
RANGES = 64


def ranking_auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(auc, n): the chance that a row of label 1 scores above one of label 0, ties counting half.

    Rows of one score are added up first. Scores are then cut into RANGES at about their quantiles; what lies below a row is counted in its range, and the ranges below are added, a row for each.
    """
    by_score = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("ones"), F.count("*").alias("n"))
    cuts = sorted(set(by_score.approxQuantile("s", [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)))
    placed = by_score.withColumns({"zeros": F.col("n") - F.col("ones"), "range": F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("s")))})
    totals = placed.groupBy("range").agg(F.sum("zeros").alias("zeros"))
    before = totals.select("range", F.coalesce(F.sum("zeros").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("zeros").over(Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = placed.withColumn("own", own).join(before, "range").select("ones", "n", (F.col("ones") * (F.col("before") + F.col("own") + F.col("zeros") / 2)).alias("wins"))
    ones, all_ = F.sum("ones"), F.sum("n")
    return wins.agg((F.sum("wins") / (ones * (all_ - ones))).alias("auc"), all_.alias("n"))


def accuracy(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    """(accuracy, n): the share of rows whose prediction is the label."""
    return rows.agg(F.avg(F.when(F.col(predicted) == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


def split(rows: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    """Adds train, true for about a share of the keys: by hash, so that the same key falls on the same side in every run."""
    return rows.withColumn("train", F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(10_000)) < round(share * 10_000))
