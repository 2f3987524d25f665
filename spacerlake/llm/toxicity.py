"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labels are learnt from rows whose crc32(doc_id as text) mod FOLDS is not 0, of which at most about MOST_LABELLED are
taken, those with the least hash of doc_id: of these, remainder CALIBRATION calibrates and the others fit. The fit's own texts also give the lexicon: words, and
starts of words of STARTS bytes, that more toxic texts hold than chance allows, with their log odds. A text's features
are densities of the lexicon and its weights, second-person words near them, capitals, marks, and lexicon words that
only appear once digits and signs are read as the letters they stand for. Neither labels nor lang, source or doc_id are features.

Defined results: a null text is empty and is scored like one; a null doc_id is not held out; rows of labels that
repeat a doc_id count once, toxic if any is; null labels are left out; with no labels of either class to learn from, every score is the share of
toxic labels (0 without labels); repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices, stored, table

FOLDS, CALIBRATION = 5, 4
MOST_LABELLED = 20_000
STARTS = (4, 5, 6, 7)
#: Texts that must hold a lexicon entry, and standard deviations above chance.
LEAST_TEXTS, LEAST_Z = 4, 5.0
#: Entries counted in a task before their counts are handed on.
MOST_COUNTED = 100_000
NEAR = 5
FEATURES = ["density", "hits", "different", "strongest", "weight", "near_you", "you", "capitals", "exclamations", "questions", "marks", "obfuscated", "signs", "words"]
#: Second-person words of the corpus languages.
SECOND_PERSON = frozenset(x.encode() for x in "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Signs and the letters they stand for.
_LOOKALIKES = bytes.maketrans(b"@$013457!", b"asoieasti")
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CAPITALS = bytes(range(65, 91))
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
_SIGNS = b"@$*#%013457!"


def _words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def entries(word: bytes) -> list[bytes]:
    """A word as a lexicon may hold it: whole, with a blank behind, and its starts."""
    return [word + b" ", *(word[:n] for n in STARTS if len(word) >= n)]


class Scorer:
    MOST_KNOWN = 500_000

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon
        self.known: dict[bytes, float] = {}

    def weights(self, words: list[bytes]) -> list[float]:
        if len(self.known) > self.MOST_KNOWN:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = max((self.lexicon.get(x, 0.0) for x in entries(word)), default=0.0)
        return [known[x] for x in words]

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        lower = (text or "").lower().encode()
        words = _words(lower)
        n = max(1, len(words))
        weights = self.weights(words)
        hits = [k for k, x in enumerate(weights) if x > 0]
        signs = len(raw) - len(raw.translate(None, _SIGNS))
        obfuscated = 0
        if signs:
            read = self.weights(_words(lower.translate(_LOOKALIKES)))
            obfuscated = max(0, sum(x > 0 for x in read) - len(hits))
        you = [k for k, x in enumerate(words) if x in SECOND_PERSON]
        near = _near(hits, you)
        length = max(1, len(raw))
        total = sum(weights)
        return [
            100 * len(hits) / n, math.log1p(len(hits)), math.log1p(len({words[k] for k in hits})), max(weights, default=0.0), 100 * total / n, 100 * near / n, 100 * len(you) / n,
            100 * (len(raw) - len(raw.translate(None, _CAPITALS))) / length, 1000 * raw.count(b"!") / length, 1000 * raw.count(b"?") / length,
            100 * (len(raw) - len(raw.translate(None, _MARKS))) / length, math.log1p(obfuscated), 100 * signs / length, math.log1p(len(words)),
        ]


def _near(hits: list[int], you: list[int]) -> int:
    """Hits with a second-person word at most NEAR words away."""
    if not hits or not you:
        return 0
    a, b = np.array(hits), np.array(you)
    after = np.searchsorted(b, a)
    far = np.iinfo(np.int64).max // 2
    gaps = np.minimum(np.where(after < len(b), b[np.minimum(after, len(b) - 1)] - a, far), np.where(after > 0, a - b[np.maximum(after - 1, 0)], far))
    return int((gaps <= NEAR).sum())


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def _held(docs: DataFrame) -> DataFrame:
    """(entry, toxic, clean): texts of (text, toxic) of either class that hold the entry; the entry "" counts texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            known = list(counts[0] | counts[1])
            out = pa.RecordBatch.from_arrays([pa.array(known, pa.binary()), *(pa.array([counts[k][x] for x in known], pa.int64()) for k in (1, 0))], names=["entry", "toxic", "clean"])
            for x in counts:
                x.clear()
            return out

        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update({x for w in set(_words((text or "").lower().encode())) for x in entries(w)})
                counts[toxic][b""] += 1
                if len(counts[0]) + len(counts[1]) > MOST_COUNTED:
                    yield counted()
        yield counted()

    return docs.select("text", "toxic").mapInArrow(count, "entry binary, toxic bigint, clean bigint").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Entry -> log odds, from the rows (text, toxic) of a bounded sample: all entries that enough toxic texts hold, and more of them than chance allows."""
    held = stored(_held(sample).where(F.col("toxic") >= LEAST_TEXTS), "entries")
    texts = held.where(F.length("entry") == 0).first()
    if texts is None:
        return {}
    n_toxic, n_clean = texts["toxic"], max(1, texts["clean"])
    p = (F.col("toxic") + F.col("clean") + 1) / (n_toxic + texts["clean"] + 2)
    z = (F.col("toxic") / n_toxic - F.col("clean") / n_clean) / F.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_clean))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (texts["clean"] + 1))
    found = held.where(F.length("entry") > 0).where(z >= LEAST_Z).select("entry", odds.alias("odds")).where("odds > 1")
    return {bytes(r["entry"]): r["odds"] for r in found.collect()}  # of the bounded sample


def with_features(docs: DataFrame, lexicon: dict[bytes, float], extra: list[str]) -> DataFrame:
    """The extra columns (bigint or int) and the features of (text)."""
    words = docs.sparkSession.sparkContext.broadcast(lexicon)
    kept = docs.select("text", *extra)
    schema = ", ".join([*(f"{x} {kept.schema[x].dataType.simpleString()}" for x in extra), *(f"{x} double" for x in FEATURES)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words.value)
        for batch in slices(batches):
            found = np.array([scorer.features(x) for x in batch.column(0).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c) for c in np.ascontiguousarray(found.T))], names=[*extra, *FEATURES])

    return kept.mapInArrow(score, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); labels (doc_id, toxic)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    # at most most_labelled pairs of numbers
    sample = stored(docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), fold_of(F.col("doc_id")).alias("fold")), "labelled")
    fit, rest = sample.where(F.col("fold") != CALIBRATION), sample.where(F.col("fold") == CALIBRATION)
    counts = {r["part"]: (r["n"], r["toxic"]) for r in sample.groupBy((F.col("fold") == CALIBRATION).alias("part")).agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).collect()}
    n, toxic = counts.get(False, (0, 0))
    if toxic in (0, n):
        share = sum(x[1] for x in counts.values()) / max(1, sum(x[0] for x in counts.values()))
        score = F.lit(float(share))
        return docs.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))

    lexicon = learn_lexicon(fit)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    ready = stored(assemble.transform(with_features(fit, lexicon, ["toxic"])).select("toxic", "features").coalesce(4), "features")
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=16, maxDepth=3, stepSize=0.25, maxBins=32, seed=9).fit(ready)
    scored = trees.transform(assemble.transform(with_features(docs, lexicon, ["doc_id"]))).select("doc_id", vector_to_array("probability")[1].alias("chance"))
    m, among = counts.get(True, (0, 0))
    score = F.col("chance")
    if among not in (0, m):
        chances = trees.transform(assemble.transform(with_features(rest, lexicon, ["toxic"]))).select(F.col("toxic").cast("double").alias("toxic"), vector_to_array("probability")[1].alias("chance"))
        # the calibrated chance, with a trace of the trees' own so that a step of the curve keeps their order
        curve = IsotonicRegression(labelCol="toxic", featuresCol="chance", predictionCol="calibrated").fit(chances.coalesce(1))
        scored, score = curve.transform(scored), F.col("calibrated") * 0.999 + F.col("chance") * 0.001
    return scored.select("doc_id", held_out.alias("held_out"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
