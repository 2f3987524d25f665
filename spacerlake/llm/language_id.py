"""Language ID by Bayesian evidence fusion.

The languages, and the likelihood of a text in each, are learnt from labelled rows: hashed letter trigrams, add-one smoothed, of about
PER_LANGUAGE rows of each label (rows whose hash falls below a share of its range). Every label is a language; the model takes 128 KB for each, and there are
no more languages in more text. A text's log likelihood is its mean over trigrams times min(trigrams, EVIDENCE), as neighbouring trigrams are
not independent. One more class, OTHER, has all trigrams equally likely: no known language, or no language.

The prior of a host is its texts' summed posteriors, smoothed towards those of its domain, these towards those of its
address suffix, and these towards all (KAPPA pseudo-texts a level), by grouped aggregation. The row's own part is taken out. The language declared by
the markup counts by its probability given the text's language, as found in the corpus by the same sums. The posterior is
the product of the three, scaled to 1. A row is rejected if OTHER wins or the text has no letters.

Defined results: null and empty texts have no letters: language null, probability 0, rejected; a null or unknown declared language and a null
host are evidence like any other; repeated rows are kept; an empty table gives no rows; without any labelled rows every row is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, stored, table

PER_LANGUAGE = 2000
BUCKETS = 1 << 15
EVIDENCE = 20
KAPPA = 10.0
OTHER, OTHER_PRIOR = "other", 0.01

_HIDDEN = re.compile(r"<(script|style)\b|<!--", re.I)
_ENDS = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(1 << 16)] + [True]))
    return _LETTER[0]


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams, with one blank between words and at both ends."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[np.minimum(points, 1 << 16)], points, np.uint32(32))
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint64)
    points = points[1:][(points[1:] != 32) | (points[:-1] != 32)]
    if not (points != 32).any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[np.uint64(32)], points])
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def shown_markup(html: str) -> str:
    """The markup without scripts, styles and comments that end; each kind's missing end is looked for once, so the time is in proportion to the length."""
    out, at, place, endless = [], 0, 0, set()
    while found := _HIDDEN.search(html, place):
        place, kind = found.end(), (found[1] or "").lower()
        if kind in endless:
            continue
        end = _ENDS[kind].search(html, place)
        if end:
            out.append(html[at : found.start()])
            at = place = end.end()
        else:
            endless.add(kind)
    return " ".join([*out, html[at:]])


def declared_language(shown: str) -> str:
    """The lang attribute of the first html tag that has one, or ""."""
    place = 0
    while found := _HTML.search(shown, place):
        place = shown.find(">", found.end())
        if told := _LANG.search(shown[found.end() : place if place >= 0 else None]):
            return told[1]
        if place < 0:
            break
    return ""


def page_text(shown: str) -> str:
    """Text of shown markup, without tags and character references."""
    last = shown.rfind(">") + 1
    return re.sub(r"&#?\w+;", " ", _TAG.sub(" ", shown[:last]) + shown[last:])


def learn_likelihoods(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of the trigram buckets, from rows (text, lang, doc_id)."""
    counts = {r["lang"]: r["n"] for r in docs.where("lang IS NOT NULL AND lang <> ''").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))))[F.col("lang")]
    sample = docs.where(F.col("lang").isin(languages)).where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {x: np.zeros(BUCKETS, np.int64) for x in languages}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in found.items():
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])

    table_ = np.ones((len(languages), BUCKETS))
    # at most BUCKETS rows for each language
    for r in sample.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        table_[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return languages, np.log(table_ / table_.sum(axis=1, keepdims=True))


def _with_evidence(rows: DataFrame, logs: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns to keep, and n_trigrams and log likelihoods (OTHER last) of the column text."""
    model = rows.sparkSession.sparkContext.broadcast(np.vstack([logs, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32))
    own = rows.select(F.col("text").alias("_text"), *keep)
    schema = T.StructType([*(rows.schema[x] for x in keep), T.StructField("n_trigrams", T.LongType()), T.StructField("evidence", T.ArrayType(T.DoubleType()))])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.ascontiguousarray(model.value.T)
        for batch in slices(batches):
            sizes, found = [], []
            for text in batch.column(0).to_pylist():
                own = trigrams(text)
                sizes.append(len(own))
                found.append(table_[own].mean(axis=0, dtype=np.float64) * min(len(own), EVIDENCE) if len(own) else np.zeros(table_.shape[1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=[*keep, "n_trigrams", "evidence"])

    return own.mapInArrow(score, schema)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _softmax(logs: Column) -> Column:
    powers = _let(logs, lambda xs: _let(F.array_max(xs), lambda most: F.transform(xs, lambda x: F.exp(x - most))))
    return _let(powers, lambda xs: _let(_total(xs), lambda size: F.transform(xs, lambda x: x / size)))


def declared_code(declared: Column, languages: list[str]) -> Column:
    """The primary subtag if it is a known language, else "other", or "none"."""
    code = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    return F.when(code == "", "none").when(code.isin(languages), code).otherwise("unknown") if languages else F.lit("none")


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """keep and language, probability, text_language, rejected of every row of (text, declared, host, domain, suffix, keep).

    keep names columns of rows; none may be called as those that are added.
    """
    languages, logs = model
    if not languages:
        return rows.select(*keep).withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(0.0), "text_language": F.lit(None).cast("string"), "rejected": F.lit(True)})
    n, names = len(languages), F.array(*(F.lit(x) for x in [*languages, OTHER]))
    flat = F.array(*(F.lit(float(np.log((1 - OTHER_PRIOR) / n))) for _ in languages), F.lit(float(np.log(OTHER_PRIOR))))

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    places = {"_" + x: F.coalesce(F.col(x), F.lit("")) for x in ("host", "domain", "suffix")} | {"_declared": declared_code(F.col("declared"), languages)}
    level_names = ["_suffix", "_domain", "_host"]
    rows = rows.withColumns(places)
    soft = F.when(F.col("n_trigrams") > 0, _softmax(added(F.col("evidence"), flat))).otherwise(F.array(*[F.lit(0.0)] * (n + 1)))

    scored = stored(_with_evidence(rows, logs, [*keep, *level_names, "_declared"]), "evidence")  # read twice: to add up, and to fuse
    counted = scored.select(*level_names, "_declared", soft.alias("soft"))
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n + 1)]
    by_host = stored(counted.groupBy(*level_names, "_declared").agg(*sums), "hosts")

    def level(keys: list[str], name: str) -> DataFrame:
        return by_host.groupBy(*keys).agg(F.array(*(F.sum(f"s{i}") for i in range(n + 1))).alias(name))

    # (language, declared code) and the totals: at most a few rows for each known language
    total = level([], "all")
    by_code = level(["_declared"], "of_code")
    hosts = level(level_names, "of_host").join(level(level_names[:2], "of_domain"), level_names[:2]).join(level(level_names[:1], "of_suffix"), level_names[:1])
    hosts = stored(hosts, "priors")  # a join of two tables, so that Spark can split a host with very many rows over several tasks

    wide = scored.withColumn("soft", soft)
    joined = wide.join(hosts, level_names).join(F.broadcast(by_code), "_declared").crossJoin(F.broadcast(total))  # total: one row

    def without(counts: Column) -> Column:
        return F.zip_with(counts, F.col("soft"), lambda c, s: F.greatest(c - s, F.lit(0.0)))

    def smoothed(counts: Column, above: Column) -> Column:
        return _let(counts, lambda cs: _let(_total(cs) + KAPPA, lambda size: F.zip_with(cs, above, lambda c, p: (c + KAPPA * p) / size)))

    prior = F.transform(flat, lambda x: F.exp(x))
    for name in ("all", "of_suffix", "of_domain", "of_host"):
        joined = joined.withColumn("_prior", smoothed(without(F.col(name)), prior if name == "all" else F.col("_prior")))
    codes = len(languages) + 2
    told = F.zip_with(without(F.col("of_code")), without(F.col("all")), lambda c, a: F.log((c + 1) / (a + codes)))
    fused = _softmax(added(added(F.col("evidence"), F.transform("_prior", lambda x: F.log(x))), told))
    joined = joined.withColumn("_posterior", fused)
    best = F.array_max("_posterior")
    language = F.element_at(names, F.array_position("_posterior", best).cast("int"))
    text_language = F.element_at(names, F.array_position("evidence", F.array_max("evidence")).cast("int"))
    has = F.col("n_trigrams") > 0
    return joined.select(
        *keep, F.when(has, language).alias("language"), F.when(has, best).otherwise(F.lit(0.0)).alias("probability"), F.when(has, text_language).alias("text_language"),
        (~has | (language == OTHER)).alias("rejected"),
    )


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, domain, suffix) of (page_id, url, html): the whole page is read, once."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            shown = [shown_markup(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([page_text(x) for x in shown], pa.string()), pa.array([declared_language(x) for x in shown], pa.string())], names=["page_id", "url", "text", "declared"])

    parts = pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, declared string")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    return parts.select(
        "page_id", "text", "declared", host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn_likelihoods(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(page_rows(table(spark, sf_dir, "pages")), model, ["page_id", "host", "declared"])
