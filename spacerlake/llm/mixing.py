"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions.

The documents of a source stand in the order of md5(seed:doc_id) and are cut into blocks of block_chars characters;
a document belongs to the block in which it starts. Slots take one block each. With integer parts p out of q = sum(p),
block k of a source is released at slot floor(k q / p) and due before slot ceil((k + 1) q / p); of the released blocks
the one with the earliest deadline goes next. As the parts add up to q, every block meets its window, so that after
any slot each source is less than one block from its share, and the schedule repeats after q slots. The schedule of
one period (RESOLUTION slots and one more for each source at most, whatever the input) is found once; a block's slot
follows from it by arithmetic.

in_mix is set up to the horizon, the first slot at which sources with more than TOLERANCE of the weights together have no
block left: so far the mix holds the target weights, but for that tolerance, and one small source can't end it. Later documents keep their slots.

A source may hold most of the rows: it is numbered in BUCKETS buckets by hash, whose sizes are added up first, so no
window spans a source's documents.

Defined results: a null source is the source ""; a null text is empty; a source without a weight, or with one of 0, has no slots (null,
in_mix false); repeated rows are kept and stand next to each other; null doc_ids hash as the text "null"; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

BLOCK_CHARS = 8192
#: Parts into which the weights are rounded.
RESOLUTION = 1000
#: Buckets of a source, by three hex digits of the hash.
BUCKETS = 16**3
TOLERANCE = 0.05
SEED = "mix"

#: ps: parts of the sources, in the order of their names; q: their sum. An element for each slot: the source's place in ps, and which of its blocks.
_PERIOD = """
aggregate(sequence(0L, q - 1), named_struct('ks', transform(ps, p -> 0L), 'out', cast(array() AS array<struct<i:int,k:bigint>>)),
  (a, t) -> aggregate(
    array(array_min(filter(
      transform(ps, (p, i) -> named_struct('due', ((a.ks[i] + 1) * q + p - 1) div p, 'i', i, 'released', (a.ks[i] * q) div p)),
      s -> s.released <= t))),
    a, (b, s) -> named_struct('ks', transform(b.ks, (k, i) -> if(i = s.i, k + 1, k)), 'out', concat(b.out, array(named_struct('i', s.i, 'k', b.ks[s.i]))))),
  a -> a.out)
"""


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, block_chars: int = BLOCK_CHARS, seed: str = SEED, resolution: int = RESOLUTION, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, source, n_chars, block, slot, in_mix) of every row of docs (doc_id, source, text).

    Without weights, a source's weight is its number of characters to the power of exponent.
    """
    own = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("place"),
    ).withColumn("bucket", F.substring("place", 1, 3))
    sums = own.groupBy("source", "bucket").agg(F.sum("n_chars").alias("chars"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.select("source", "bucket", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("before"))

    totals = sums.groupBy("source").agg(F.sum("chars").alias("chars"))
    if weights is None:
        weighed = totals.withColumn("weight", F.sqrt(F.col("chars").cast("double")) if exponent == 0.5 else F.pow(F.col("chars").cast("double"), F.lit(float(exponent))))
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1])))) if weights else F.lit(None).cast("map<string,double>")
        weighed = totals.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)))
    total = weighed.where("weight > 0").agg(F.sum("weight").alias("all_weights"))
    parts = weighed.where("weight > 0").crossJoin(F.broadcast(total)).select(  # one row: the sum
        "source", F.greatest(F.lit(1), F.floor(F.col("weight") / F.col("all_weights") * resolution + 0.5)).cast("bigint").alias("p"),
        F.greatest(F.lit(1), F.ceil(F.col("chars") / F.lit(block_chars))).cast("bigint").alias("n_blocks"),
    )
    one = parts.agg(F.array_sort(F.collect_list(F.struct("source", "p", "n_blocks"))).alias("s"), F.sum("p").alias("q"))
    period = one.where("q > 0").withColumn("ps", F.expr("transform(s, x -> x.p)")).select("s", "q", F.posexplode(F.expr(_PERIOD)).alias("slot", "pick"))
    slots = period.select(F.expr("s[pick.i].source").alias("source"), F.expr("s[pick.i].p").alias("p"), F.col("pick.k").alias("j"), F.col("slot").cast("bigint").alias("first_slot"), "q", F.expr("s[pick.i].n_blocks").alias("n_blocks"))
    # a row for each source: when it has no block left, and the parts of all that ran out by then
    ends = slots.where("j = n_blocks % p").select("source", "p", "q", F.expr("(n_blocks div p) * q + first_slot").alias("end"))
    gone = F.sum("p").over(Window.orderBy("end", "source").rowsBetween(Window.unboundedPreceding, 0))
    horizon = ends.withColumn("gone", gone).where(F.col("gone") > tolerance * F.col("q")).agg(F.min("end").alias("horizon"))
    slots = slots.crossJoin(F.broadcast(horizon)).drop("n_blocks")  # one row: the least slot

    running = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    block = F.expr(f"(before + in_bucket) div {block_chars}")
    placed = own.withColumn("in_bucket", F.coalesce(F.sum("n_chars").over(running), F.lit(0))).join(buckets, ["source", "bucket"]).select("doc_id", "source", "n_chars", block.alias("block"))
    shares = parts.select("source", "p")
    # parts and slots have at most RESOLUTION rows and one more for each source
    return placed.join(F.broadcast(shares), "source", "left").withColumn("j", F.col("block") % F.col("p")).join(F.broadcast(slots.drop("p")), ["source", "j"], "left").select(
        "doc_id", "source", "n_chars", "block", F.expr("(block div p) * q + first_slot").alias("slot"), F.coalesce(F.expr("(block div p) * q + first_slot < horizon"), F.lit(False)).alias("in_mix")
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH RECURSIVE n AS (SELECT doc_id, coalesce(source, '') AS s, CAST(coalesce(length(text), 0) AS BIGINT) AS c, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
tot AS (SELECT s, CAST(sum(c) AS BIGINT) AS c FROM n GROUP BY s),
pw AS (SELECT s, CAST(greatest(1, floor(sqrt(c) / (SELECT sum(sqrt(c)) FROM tot WHERE c > 0) * {RESOLUTION} + 0.5)) AS BIGINT) AS p,
              CAST(greatest(1, ceil(c / {BLOCK_CHARS}.0)) AS BIGINT) AS nb FROM tot WHERE c > 0),
src AS (SELECT list(p ORDER BY s) AS ps, list(s ORDER BY s) AS ss, CAST(sum(p) AS BIGINT) AS q FROM pw),
sch(t, ks, i, k) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ps, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM src
  UNION ALL
  SELECT t + 1, list_transform(ks, lambda x, j: CASE WHEN j = b THEN x + 1 ELSE x END), b, ks[b] FROM (
    SELECT sch.t, sch.ks, list_min(list_filter(list_transform(range(1, len(ps) + 1),
        lambda j: CASE WHEN (ks[j] * q) // ps[j] <= sch.t + 1 THEN (((ks[j] + 1) * q + ps[j] - 1) // ps[j]) * 1000000 + j END), lambda v: v IS NOT NULL)) % 1000000 AS b
    FROM sch, src WHERE sch.t + 1 < q)),
slots AS (SELECT ss[i] AS s, k AS j, t AS slot FROM sch, src WHERE t >= 0),
ends AS (SELECT s, p, q, (nb // p) * q + slot AS e FROM pw JOIN slots USING (s), src WHERE slots.j = nb % p),
hor AS (SELECT min(e) AS h FROM (SELECT e, q, sum(p) OVER (ORDER BY e, s ROWS UNBOUNDED PRECEDING) AS g FROM ends) WHERE g > {TOLERANCE} * q),
blk AS (SELECT doc_id, s, c, CAST((sum(c) OVER (PARTITION BY s ORDER BY h, doc_id, c ROWS UNBOUNDED PRECEDING) - c) // {BLOCK_CHARS} AS BIGINT) AS block FROM n),
fin AS (SELECT doc_id, blk.s, c, block, CAST((block // p) * q + slots.slot AS BIGINT) AS slot FROM blk LEFT JOIN pw ON blk.s = pw.s CROSS JOIN src LEFT JOIN slots ON slots.s = blk.s AND slots.j = block % p)
SELECT doc_id, s AS source, c AS n_chars, block, slot, coalesce(slot < h, false) AS in_mix FROM fin, hor
"""
