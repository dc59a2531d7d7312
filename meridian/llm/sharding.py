"""Hilbert-curve sharding (DataFrame functions only, no Python on the executors).

Several metadata dimensions are quantised, rows are sorted by the index of their
cell on a Hilbert curve, and the order is cut into runs of equal row counts.
Files cut from neighbouring runs cover small boxes of every dimension, so readers
can skip files on any of them.

Equal texts take the smallest source and language of their group, so that they
fall into one cell and stand next to each other; a group is split only where a
cut falls inside it.

Defined results: a null text has size 16, a null crc and forms a group with the
other null texts; null sources and languages are values of their own, below all
others; repeated rows are rows like any other; an empty table gives no rows.
Columns of the input never clash with working columns (they travel in a struct);
an input column named like an output column is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bits for each of the three dimensions.
BITS = 5
#: Copies of a group's common values, so that a huge group joins in many tasks.
SALTS = 16


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of ``len(dims)`` integers below ``2**bits``.

    Skilling's transposed form, folded over (bit, axis) steps with ``aggregate``
    so that the expression stays small.
    """
    n = len(dims)
    long = lambda v: F.lit(v).cast("long")
    axes = F.array(*[d.cast("long") for d in dims])
    steps = F.array(*[F.struct(long(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(acc: Column, step: Column) -> Column:
        first, here, low = acc[0], F.get(acc, step["i"]), step["q"] - 1
        turn = here.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        return F.transform(
            acc,
            lambda v, j: F.when(turn, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            .when((j == 0) | (j == step["i"]), v.bitwiseXOR(swap))
            .otherwise(v),
        )

    if bits > 1:
        axes = F.aggregate(steps, axes, undo)
    gray = F.aggregate(
        axes,
        F.array().cast("array<long>"),
        lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), long(0)))))),
    )
    last = lambda a: F.element_at(a, -1)
    flips = F.array(*[long(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<long>")
    flip = lambda a: F.aggregate(flips, long(0), lambda t, q: F.when(last(a).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    holder = F.transform(F.array(gray), lambda a: F.struct(a.alias("a"), flip(a).alias("t")))[0]
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    return F.transform(
        F.array(holder),
        lambda h: F.aggregate(order, long(0), lambda acc, s: acc * 2 + F.call_function("shiftright", F.get(h["a"], s["i"]).bitwiseXOR(h["t"]), s["b"]).bitwiseAND(long(1))),
    )[0]


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """The rows of a sorted DataFrame, written, with ``rank`` from 0 and their number ``o_n``.

    Rows are counted by partition; only those counts, one row each, come together.
    """
    kept = written(ordered.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    counts = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        F.col("part").alias("o_part"),
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("o_start"),
        F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("o_n"),
    )
    rank = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("o_start")
    return kept.join(F.broadcast(offsets), part == F.col("o_part")).withColumn("rank", rank).drop("at", "o_part", "o_start")


def _quantised(keyed: DataFrame, column: str, cells: int) -> DataFrame:
    """Distinct values of a text column with a cell number that keeps their order, written, so that their size is known."""
    ranked = numbered(keyed.select(column).distinct().orderBy(F.col(column).asc_nulls_first()), "values")
    cell = F.floor(F.col("rank") * cells / F.col("o_n"))  # few values are spread over the whole axis
    return written(ranked.select(F.col(column).alias(f"{column}_v"), cell.cast("int").alias(f"{column}_c")), "cells")


def hilbert_shards(docs: DataFrame, n_shards: int = 40, bits: int = BITS, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with size, text_crc32, law, shard, slot, grown_shard, hilbert.

    Law ``rows``: shard sizes differ by one row at most.  ``carry`` names the
    input columns to return (all by default); only they go through the sort.
    """
    cells = 1 << bits
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"]
    names = [c for c in (docs.columns if carry is None else carry) if c not in new]
    text = F.col("text")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        F.col("source").cast("string").alias("src"),
        F.col("lang").cast("string").alias("lng"),
        F.col("doc_id").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("th"),
    )
    # Texts are read once for what all later steps need of them; only rows that carry them are read again.
    slim = written(keyed if carry is not None else keyed.drop("row"), "meta")
    keyed = slim if carry is not None else keyed
    key = [F.col("th"), F.col("size"), F.coalesce("crc", F.lit(-1)).alias("crc_")]
    # Only rows of groups whose sources or languages differ have to learn those of their group.
    several = lambda c: (F.min(c) < F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))
    shared = (
        slim.groupBy(*key)
        .agg(F.min("src").alias("g_src"), F.min("lng").alias("g_lng"), F.coalesce(several("src"), F.lit(False)).alias("m_src"), F.coalesce(several("lng"), F.lit(False)).alias("m_lng"))
        .where("m_src or m_lng")
        .select(F.col("th").alias("g_th"), F.col("size").alias("g_size"), F.col("crc_").alias("g_crc"), "g_src", "g_lng", F.lit(True).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt"))
    )
    shared = written(shared, "shared")
    if shared.isEmpty():
        placed = keyed
    else:
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        same = (F.col("th") == F.col("g_th")) & (F.col("size") == F.col("g_size")) & (F.coalesce("crc", F.lit(-1)) == F.col("g_crc")) & (salt == F.col("g_salt"))
        own = lambda c: F.when(F.col("g"), F.col(f"g_{c}")).otherwise(F.col(c)).alias(c)
        placed = keyed.join(shared, same, "left").select("row", "id", "size", "crc", "th", own("src"), own("lng"))

    marks = slim.agg(F.percentile_approx("size", [i / cells for i in range(1, cells)], 10000).alias("p")).first()["p"] or []
    size_cell = reduce(lambda acc, m: acc + F.when(F.col("size") > m, 1).otherwise(0), sorted(set(marks)), F.lit(0))
    src, lng = _quantised(slim, "src", cells), _quantised(slim, "lng", cells)
    ordered = (
        placed.join(src, F.col("src").eqNullSafe(F.col("src_v")), "left")
        .join(lng, F.col("lng").eqNullSafe(F.col("lng_v")), "left")
        .withColumn("hilbert", hilbert_index([F.coalesce("src_c", F.lit(0)), F.coalesce("lng_c", F.lit(0)), size_cell], bits))
        .orderBy("hilbert", "th", "crc", "size", "id")
        .select("row", "size", "crc", "hilbert")
    )
    # The sort's result is kept, so that counting and numbering see the same order.
    rows = numbered(ordered, "hilbert")
    exact = F.expr(f"(rank * {n_shards}) div o_n")
    return rows.select(
        "row.*",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        exact.cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"(((rank * {n_shards}) div o_n) * o_n + {n_shards - 1}) div {n_shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 along the Hilbert curve, by the law ``rows``."""
    return hilbert_shards(table(spark, sf_dir, "documents"), 40, carry=["doc_id"])
