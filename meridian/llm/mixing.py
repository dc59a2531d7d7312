"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its weight's part of the budget; a target above the
cap (``max_epochs`` times the source's size) stops there and its excess is shared
out again by weight, until none is above.  The fixed point is found in one pass
over the sources sorted by size for weight: the water level is the first at
which the next source no longer overflows.

Sampling: a source with target ``t`` and size ``s`` takes all documents
``t div s`` times, and of the rest whole documents in the order of a seeded hash
until the remaining words are reached; the document at the cut gives part of its
words.  Each source's taken words are thus its target rounded down.

Running sums over a source never sit in one task: the hash order is cut into
4,096 buckets, sums of buckets are added up first, and rows are summed within
their bucket.

Defined results: a null text has size 0; a null source is the last source; null
doc_ids are ordered first; repeated rows are rows of their own (rows of one doc_id
are ordered by their texts' hashes); an empty table gives no rows; sources without
words have target 0.  Columns of the input never clash with working columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, table, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to source, source_size, target; nulls last, weights repeating."""
    every = Window.partitionBy(F.lit(0))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    leveled = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("source_size") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    )
    # The level at the first source, in that order, that holds its part counts.
    fits = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))
    chosen = leveled.withColumn("chosen", F.min(fits).over(every)["level"])
    return chosen.select("source", "source_size", F.coalesce(F.least("cap", F.col("chosen") * F.col("weight")), F.col("cap")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of ``docs``, and what places it: whole, ord, th."""
    order = F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        order.alias("ord"),
        F.xxhash64("text").alias("th"),
    ).withColumn("bucket", F.substring("ord", 1, 3))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, max_epochs)
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part").over(upto), F.lit(0)))
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("p_source"), F.col("s.bucket").alias("p_bucket"), "start", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("ord", "doc_id", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("upto", F.sum("size").over(within))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - F.col("whole") * F.col("source_size")
    first = F.col("start") + F.col("upto") - F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - first))
    return (
        summed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
        .withColumn("whole", whole)
        .withColumn("rest", rest)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"), "whole", "ord", "th")
    )


def mixed_rows(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    Whole documents only: the one document at each source's cut is taken once
    more if at least half of it is (rows equal to it as well).  Documents without
    words are kept once.  A cut is the last place in the hash order that a source
    takes once more, so rows learn from one small row of their source how often they go.
    """
    names = docs.columns
    narrow = docs.select(*[F.col(f"`{c}`") for c in ("doc_id", "text", "source")])
    extra = (F.col("size") > 0) & (2 * (F.col("taken") - F.col("whole") * F.col("size")) >= F.col("size"))
    at = F.struct("ord", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "th")
    cuts = written(mix_sources(narrow, seed=seed, **how).groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(extra, at)).alias("cut")), "cuts")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    text, doc_id = F.col("row.text"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    place = F.struct(F.md5(F.concat(F.lit(f"{seed}-"), doc_id).cast("binary")).alias("ord"), doc_id.alias("id"), F.xxhash64(text).alias("th"))
    named = docs.select(row.alias("row")).select("row", F.col("row.source").cast("string").alias("own"), place.alias("place"), F.rlike(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX)).alias("any"))
    joined = named.join(cuts, F.col("own").eqNullSafe(F.col("source")))
    times = F.when(F.col("any"), F.col("whole") + F.coalesce((F.col("place") <= F.col("cut")).cast("int"), F.lit(0))).otherwise(1).cast("int")
    return joined.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sources weigh 5, 2, 1, repeating, and share 150 % of all words."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
WITH rows_ AS (
  SELECT doc_id, source, md5('mix-1-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, source_size / w AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w
  FROM weighed),
leveled AS (
  SELECT *, (budget - coalesce(sum(cap) OVER pre, 0)) / (all_w - coalesce(sum(w) OVER pre, 0)) AS level
  FROM ranked WINDOW pre AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, w * (SELECT level FROM leveled WHERE cap >= level * w ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target
  FROM leveled),
summed AS (
  SELECT r.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY r.source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first_,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - first_)) AS BIGINT) AS taken
FROM summed
"""
