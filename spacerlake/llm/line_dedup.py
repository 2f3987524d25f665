"""Line dedup by a deletion-neighbourhood join, in DataFrame and SQL functions.

A line, without blanks around, is removed if an earlier line (by doc_id, then place) is equal, or, for lines of
MIN_NEAR characters or more, within an edit distance of 1: one character put in, taken out or replaced. Whether the
earlier line is itself removed doesn't matter. Empty lines stay.

Every line has one deletion variant for each character, too many rows to shuffle for all lines. So variants are dealt
out in two steps that lose no pair. First, each line is cut into parts; leaving out one part gives a coarse variant
that stands for all deletions in it. Two lines within the bound share the coarse variant of the part that holds the
edit, on the grid of the shorter one; so a line also counts on the grid of one character less. Only lines that share
a coarse variant with another emit all variants of that part, hashed. Lines with equal variants at the same place
differ by at most a replacement; a whole line that equals another's variant differs by one character put in. Within a group
of equal variants only the earliest member counts, so a group costs its size, not its pairs. The edit distance to it
is then verified on the texts.

Equal lines are found by 128 bits of hash. Documents are rows by (doc_id, hash of the text); rows that repeat both are one document, whose
lines don't count against themselves.

Defined results: a null text is empty; null doc_ids come first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored, table

MIN_NEAR = 16
#: A line of less than LONG characters has two parts; others have parts of PART characters, or of the root of their length where that is more.
LONG, PART = 2048, 256

_ROW = ["doc_id", "tie"]
_HASH = ["h1", "h2"]
#: Coarse variants of `line` on a grid of less than LONG characters, that of n - longer: key, longer, and the part's text; n is its length.
_HALVES = """
array(named_struct('key', xxhash64(n - {longer}, 0, '', substring(line, (n - {longer}) div 2 + {longer} + 1)), 'longer', {longer}, 'part', substring(line, 1, (n - {longer}) div 2 + {longer})),
      named_struct('key', xxhash64(n - {longer}, 1, substring(line, 1, (n - {longer}) div 2), ''), 'longer', {longer}, 'part', substring(line, (n - {longer}) div 2 + 1)))
"""
#: The keys alone of a line of less than LONG characters, in flat expressions; n is its length. Its two parts on both grids.
_HALF_KEYS = """
array(xxhash64(n, 0, '', substring(line, n div 2 + 1)), xxhash64(n, 1, substring(line, 1, n div 2), ''),
      xxhash64(n - 1, 0, '', substring(line, (n - 1) div 2 + 2)), xxhash64(n - 1, 1, substring(line, 1, (n - 1) div 2), ''))
"""


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _chain(hashes: Column) -> Column:
    """A hash of each beginning of an array of hashes, from the empty one on."""
    return F.aggregate(hashes, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), x))))


def _pieces(text: Column, size: Column) -> Column:
    return F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))


def _long_parts(longer: int) -> Column:
    """The same on a grid of LONG characters or more, in time proportional to the line: each piece is hashed once, and what stands before and after a part is told by chains of these hashes.

    `before` are the line's pieces, `behind` those of the line without its first character where it is the longer one. Parts of the root of the
    length keep both the chains (pieces by pieces) and a part's variants (characters by characters) at the line's length.
    """
    line, grid = F.col("line"), F.col("n") - longer
    size = F.greatest(F.lit(PART), F.ceil(F.sqrt(grid)).cast("int"))
    cut = F.struct(_pieces(line, size).alias("before"), (_pieces(F.expr("substring(line, 2)"), size) if longer else _pieces(line, size)).alias("behind"))

    def chained(s: Column) -> Column:
        left, right = (F.transform(s[x], lambda piece: F.xxhash64(piece)) for x in ("before", "behind"))
        return F.struct(s["before"].alias("before"), s["behind"].alias("behind"), _chain(left).alias("lefts"), _chain(F.reverse(right)).alias("rights"))

    def parts(s: Column) -> Column:
        def part(piece: Column, i: Column) -> Column:
            key = F.xxhash64(grid, i, s["lefts"][i], s["rights"][F.size(s["behind"]) - 1 - i])
            return F.struct(key.alias("key"), F.lit(longer).alias("longer"), (F.concat(F.left(s["before"][i], F.lit(1)), piece) if longer else piece).alias("part"))

        return F.transform(s["behind"], part)

    return _named(_named(cut, chained), parts)


def _coarse() -> Column:
    """Coarse variants of `line` of n characters: it counts on its own grid (longer = 0), and as the longer line on that of one character less."""
    return F.concat(*(F.when(F.col("n") - longer < LONG, F.expr(_HALVES.format(longer=longer))).otherwise(_long_parts(longer)) for longer in (0, 1)))


def _within_one(a: Column, b: Column) -> Column:
    """Whether two texts are within one edit. Of long ones the common beginning is found by halving steps, so the time is that of their length, not its square."""
    n, m = F.length(a), F.length(b)

    def longer(p: Column, step: Column) -> Column:
        return F.when((p + step <= F.least(n, m)) & (F.substr(a, p + 1, step) == F.substr(b, p + 1, step)), p + step).otherwise(p)

    def rest_equal(p: Column) -> Column:
        return F.when(n == m, F.substr(a, p + 2) == F.substr(b, p + 2)).when(n == m + 1, F.substr(a, p + 2) == F.substr(b, p + 1)).when(m == n + 1, F.substr(a, p + 1) == F.substr(b, p + 2)).otherwise(False)

    prefix = F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), longer)
    return F.when((n < LONG) & (m < LONG), F.levenshtein(a, b, 1).between(0, 1)).otherwise(_named(prefix, rest_equal))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), F.split(text, "\n", -1).alias("lines"))


def _lines(docs: DataFrame) -> DataFrame:
    found = _rows(docs).select(*_ROW, F.posexplode("lines").alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return found.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), F.col("line"))})


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tie"] == b["tie"])


def _near(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h1, h2) of the different lines that have an earlier line within the bound."""
    long_ = _lines(docs).withColumn("n", F.length("line")).where(F.col("n") >= MIN_NEAR)
    own_keys = F.when(F.col("n") < LONG, F.expr(_HALF_KEYS)).otherwise(F.transform(_coarse(), lambda x: x["key"]))
    keys = long_.select("h1", "n", "line").select("h1", F.explode(own_keys).alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"), "line-keys")
    hashes = keys.join(shared, "key", "left_semi").select("h1").distinct()
    wanted = firsts.join(hashes, "h1", "left_semi").select("first", *_HASH, "first.doc_id", "first.tie", "first.at")
    places = wanted.groupBy(*_ROW).agg(F.collect_list(F.struct("at", "first", *_HASH)).alias("places"))
    rows = _rows(docs)
    texts = rows.join(places, _same_row(rows, places)).select("lines", F.explode("places").alias("p")).select("p.first", "p.h1", "p.h2", F.trim(F.expr("lines[p.at]")).alias("line")).dropDuplicates(_HASH)
    texts = stored(texts, "line-texts")

    parts = texts.withColumn("n", F.length("line")).select("first", *_HASH, F.explode(_coarse()).alias("c")).select("first", *_HASH, "c.*").join(shared, "key", "left_semi")
    # an own row stands for the line itself; the others for the part without one character
    variants = parts.select("first", *_HASH, F.explode(F.expr("""
        concat(
          if(longer = 0, array(named_struct('variant', xxhash64(1, key, part), 'own', true)), cast(array() AS array<struct<variant:bigint,own:boolean>>)),
          if(length(part) = 0, cast(array() AS array<struct<variant:bigint,own:boolean>>), transform(sequence(1, length(part)), j -> named_struct(
            'variant', if(longer = 0, xxhash64(0, key, j, substring(part, 1, j - 1), substring(part, j + 1)), xxhash64(1, key, concat(substring(part, 1, j - 1), substring(part, j + 1)))),
            'own', false))))""")).alias("v"), "longer").select("first", *_HASH, "v.*", "longer")  # fmt: skip
    # a group is small by nature: a line and those with one character put in, or lines that differ in one character
    group = Window.partitionBy("variant")
    of_own, of_others = (F.min(F.when(F.col("own") == own, F.col("first"))).over(group) for own in (True, False))
    partner = F.when(F.col("own") | (F.col("longer") == 0), of_others).otherwise(of_own)
    found = variants.select("first", *_HASH, partner.alias("partner")).where(F.col("partner") < F.col("first")).distinct()
    other = texts.select(F.col("first").alias("partner"), F.col("line").alias("other"))
    verified = found.join(texts.select(*_HASH, "line"), _HASH).join(other, "partner").where(_within_one(F.col("line"), F.col("other")))
    return verified.select(*_HASH).distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_near, kept) of every row of docs (doc_id, text): kept is the text without the removed lines."""
    docs = docs.select("doc_id", "text")
    place = F.struct(*_ROW, "at")
    firsts = stored(_lines(docs).groupBy(*_HASH).agg(F.min(place).alias("first"), F.max(place).alias("last")).select(*_HASH, "first", (F.col("first") < F.col("last")).alias("again")), "line-firsts")
    near = stored(_near(docs, firsts).withColumn("near", F.lit(True)), "line-near")
    marked = firsts.where("again").join(near, _HASH, "full").select(*_HASH, "first", F.coalesce("near", F.lit(False)).alias("near"))
    hits = _lines(docs).select(*_ROW, "at", *_HASH).join(marked, _HASH).where("near OR struct(doc_id, tie, at) <> first")
    removed = hits.select(*_ROW, "at", "near").distinct().groupBy(*_ROW).agg(F.collect_list(F.when(~F.col("near"), F.col("at"))).alias("repeated"), F.collect_list(F.when(F.col("near"), F.col("at"))).alias("nears"))
    rows = _rows(docs)
    none = F.array().cast("array<int>")
    joined = rows.join(removed, _same_row(rows, removed), "left").select(rows["doc_id"], "lines", F.coalesce("repeated", none).alias("repeated"), F.coalesce("nears", none).alias("nears"))
    # numbers are told apart by hash, so a document's cost is its lines, however many are removed
    left = F.array_except(F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(none), F.concat("repeated", "nears"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return joined.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size("repeated").cast("bigint").alias("n_repeated"), F.size("nears").cast("bigint").alias("n_near"), kept.alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_repeated", "n_near", F.md5("kept").alias("kept_md5"))


OP10_SQL = f"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS raw FROM a),
t AS (SELECT *, trim(raw, ' ') AS x FROM l),
f AS (SELECT x, length(x) AS n, min(struct_pack(d := doc_id, i := i)) AS f FROM t WHERE x <> '' GROUP BY x),
g AS (SELECT x, n, f, unnest([n, n - 1]) AS g FROM f WHERE n >= {MIN_NEAR}),
k AS (SELECT x, n, f, g, 0 AS side, right(x, CAST(g - g // 2 AS BIGINT)) AS half FROM g UNION ALL SELECT x, n, f, g, 1, left(x, CAST(g // 2 AS BIGINT)) FROM g),
c AS (SELECT DISTINCT a.x AS x, b.x AS y, a.n AS n, b.n AS m FROM k a JOIN k b ON a.g = b.g AND a.side = b.side AND a.half = b.half AND b.f < a.f AND abs(a.n - b.n) <= 1),
v AS (SELECT DISTINCT x FROM c WHERE CASE
   WHEN n = m THEN len(list_filter(range(0, n), lambda j: left(x, j) = left(y, j) AND substr(x, j + 2) = substr(y, j + 2))) > 0
   WHEN n < m THEN len(list_filter(range(0, m), lambda j: left(x, j) = left(y, j) AND substr(x, j + 1) = substr(y, j + 2))) > 0
   ELSE len(list_filter(range(0, n), lambda j: left(x, j) = left(y, j) AND substr(x, j + 2) = substr(y, j + 1))) > 0 END),
m AS (SELECT t.doc_id, t.i, t.raw, v.x IS NOT NULL AS near, f.f IS NOT NULL AND v.x IS NULL AND struct_pack(d := t.doc_id, i := t.i) <> f.f AS rep
      FROM t LEFT JOIN f ON t.x = f.x LEFT JOIN v ON t.x = v.x)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (rep) AS n_repeated, count(*) FILTER (near) AS n_near,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT rep AND NOT near), '')) AS kept_md5
FROM m GROUP BY doc_id
"""
