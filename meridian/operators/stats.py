"""Reports over an index and over benchmark runs, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import ZoneIndex

#: Bytes of a key, a zone id and a polygon id in size estimates; headroom, step and floor of alerts.
KEY_BYTES, ZONE_BYTES, POLY_BYTES = 8, 1, 2
HEADROOM, STEP, FLOOR = 1.2, 10, 110


def index_stats(index: ZoneIndex) -> DataFrame:
    """Cells, unique and ambiguous ones, candidate counts and size estimates: one row."""
    n = F.coalesce(F.size("candidates"), F.lit(0))
    ambiguous = F.col("unique_zone_id").isNull()
    return index.cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~ambiguous).alias("unique_cells"),
        F.count_if(ambiguous).alias("ambiguous_cells"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("candidates"),
        F.max(n).cast("int").alias("max_candidates"),
        F.sum(F.when(ambiguous, KEY_BYTES + POLY_BYTES * n).otherwise(KEY_BYTES + ZONE_BYTES)).cast("long").alias("est_bytes"),
    )


def frequencies(df: DataFrame, value: Column) -> DataFrame:
    """value, n, total, upto (running sum from the smallest value), rest."""
    counted = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counted.select("value", "n", total.alias("total"), upto.alias("upto"), (total - upto).alias("rest"))


def with_shares(table: DataFrame) -> DataFrame:
    """A table of ``frequencies`` with percent of the total, of the running sum, and of the rest."""
    pct = lambda n: F.round(F.lit(100.0) * F.col(n) / F.col("total"), 2)
    return table.withColumns({"pct": pct("n"), "upto_pct": pct("upto"), "rest_pct": pct("rest")})


def size_shares(files: DataFrame) -> DataFrame:
    """(name, bytes) of parts with their percentage of all, largest first."""
    total = F.sum("bytes").over(Window.partitionBy(F.lit(0)))
    return files.withColumn("pct", F.round(F.lit(100.0) * F.col("bytes") / total, 2)).orderBy(F.col("bytes").desc(), "name")


def stored_sizes(spark, path: str) -> DataFrame:
    """(name, bytes) of the tables of a saved index, from the store's listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("name")).agg(F.sum("length").alias("bytes"))


def stats_by_resolution(rings: DataFrame, sizes: list[int]) -> DataFrame:
    """``index_stats`` of the same rings compiled at several cell sizes: one row each."""
    found = None
    for size in sizes:
        one = index_stats(ZoneIndex.compile(rings, size)).select(F.lit(size).cast("long").alias("cell"), "*")
        found = one if found is None else found.unionByName(one)
    return found


def polygon_stats(index: ZoneIndex) -> DataFrame:
    n = F.col("n_vertices")
    return index.polygons.agg(F.count(F.lit(1)).alias("polygons"), F.sum(n).cast("long").alias("vertices"), F.avg(n).alias("mean"), F.max(n).alias("most"), F.min(n).alias("least"), (2 * F.sum(n)).cast("long").alias("coordinates"))


def hole_metrics(index: ZoneIndex) -> DataFrame:
    return index.holes.agg(F.count(F.lit(1)).alias("holes"), F.countDistinct("poly_id").alias("parents"), F.count("ref_poly_id").alias("references"), F.avg(F.col("ref_poly_id").isNotNull().cast("double")).alias("reference_share"))


def polygons_per_zone(index: ZoneIndex) -> DataFrame:
    return index.polygons.groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


def zone_metrics(index: ZoneIndex) -> DataFrame:
    """Zones, polygons, the most, mean and upper median of polygons in a zone."""
    per = F.col("n")
    return polygons_per_zone(index).agg(F.count(F.lit(1)).alias("zones"), F.sum(per).cast("long").alias("polygons"), F.max(per).alias("most"), F.avg(per).alias("mean"), F.expr("element_at(sort_array(collect_list(n)), cast(count(1) div 2 as int) + 1)").alias("upper_median"))


def polygons_per_zone_distribution(index: ZoneIndex) -> DataFrame:
    """How many zones have n polygons, and the first of them."""
    named = polygons_per_zone(index).join(index.zones, "zone_id")
    return named.groupBy("n").agg(F.count(F.lit(1)).alias("zones"), F.min_by("tz_name", "zone_id").alias("example"))


def size_strata(index: ZoneIndex) -> DataFrame:
    """poly_id, n_vertices, stratum by the 50th and 90th percentile."""
    cut = index.polygons.agg(F.percentile("n_vertices", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    n = F.col("n_vertices")
    return index.polygons.join(F.broadcast(cut)).select("poly_id", "n_vertices", F.when(n <= F.col("p")[0], "small").when(n <= F.col("p")[1], "medium").otherwise("large").alias("stratum"))


def transitions(before: DataFrame, after: DataFrame, key: str, top: int = 12) -> DataFrame:
    """The most frequent changes of answer between two lookups of the same rows."""
    both = before.select(key, F.col("tz_name").alias("expected")).join(after.select(key, F.col("tz_name").alias("got")), key)
    return both.where(~F.col("expected").eqNullSafe(F.col("got"))).groupBy("expected", "got").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "expected", "got").limit(top)


def read_benchmarks(spark, path: str) -> DataFrame:
    """(run, fullname, statistics) of benchmark JSON files."""
    stats = "struct<min:double,max:double,mean:double,median:double,stddev:double,rounds:long>"
    got = spark.read.option("multiLine", True).schema(f"benchmarks array<struct<fullname:string,stats:{stats}>>").json(path)
    return got.select(F.input_file_name().alias("run"), F.explode("benchmarks").alias("b")).select("run", "b.fullname", "b.stats.*")


def noise(runs: DataFrame, value: str = "value") -> DataFrame:
    """Per name: extremes, median, mean, population deviation, spread and variation in percent."""
    v = F.col(value)
    return runs.groupBy("name").agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, F.lit(0.5)).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation")).withColumns({"spread_pct": F.col("most") / F.col("least") * 100, "variation_pct": F.col("deviation") / F.col("mean") * 100})


def alert_threshold(noises: DataFrame) -> DataFrame:
    """One threshold for all: the worst spread with headroom, rounded up to a step, at least the floor."""
    raw = 100 + (F.max("spread_pct") - 100) * HEADROOM
    return noises.agg(F.greatest(F.ceil(raw / STEP) * STEP, F.lit(FLOOR)).cast("long").alias("threshold_pct"))


def compare_runs(base: DataFrame, head: DataFrame) -> DataFrame:
    """Best value of each side by name, their ratio, worst first; names of one side only keep a null."""
    least = lambda df, to: df.groupBy("name").agg(F.min("value").alias(to))
    both = least(base, "base").join(least(head, "head"), "name", "full_outer")
    return both.withColumn("ratio", F.col("head") / F.col("base")).orderBy(F.col("ratio").desc_nulls_last(), "name")


def memory_stats(samples: DataFrame) -> DataFrame:
    """Per name: mean and sample deviation (0 for one sample); names with an invalid sample are left out."""
    return samples.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("deviation"), F.bool_and(F.col("value") > 0).alias("ok")).where("ok").drop("ok")


def three_digits(value: Column) -> Column:
    """A number with three significant digits, without an exponent (whole from 100 on)."""
    size = F.abs(value)
    return F.when(size >= 100, F.format_string("%.0f", value)).when(size >= 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))


def _scaled(value: Column, steps: list[tuple[float, str]]) -> Column:
    """The value in the first unit that it reaches; the last one is for whatever is smaller."""
    out = None
    for least, unit in steps:
        text = F.concat(three_digits(value / least), F.lit(unit))
        out = F.when(F.abs(value) >= least, text) if out is None else out.when(F.abs(value) >= least, text)
    return out.otherwise(F.concat(three_digits(value / steps[-1][0]), F.lit(steps[-1][1])))


def format_duration(seconds: Column) -> Column:
    """ns, us, ms or s with three digits."""
    steps = [(1e-6, 1e9, "ns"), (1e-3, 1e6, "us"), (1.0, 1e3, "ms")]
    out = F.format_string("%.3g s", seconds)
    for limit, by, unit in reversed(steps):
        out = F.when(seconds < limit, F.format_string(f"%.3g {unit}", seconds * by)).otherwise(out)
    return out


def format_rate(rate: Column) -> Column:
    """Operations a second, in thousands or millions where there are so many."""
    return _scaled(rate, [(1e6, "M/s"), (1e3, "k/s"), (1.0, "/s")])


def format_bytes(n: Column) -> Column:
    return _scaled(n, [(float(1 << 30), " GiB"), (float(1 << 20), " MiB"), (float(1 << 10), " KiB"), (1.0, " B")])


def format_ratio(ratio: Column) -> Column:
    return F.concat(three_digits(ratio), F.lit("x"))


def percent_faster(before: Column, after: Column) -> Column:
    """How much less time ``after`` takes, in percent of ``before``; negative where it takes more."""
    return F.round((before - after) / before * 100, 1)


def benchmark_parts(name: Column) -> Column:
    """A benchmark's name, ``test_function[param-param]``, as a struct of its function and parameters."""
    plain = F.regexp_replace(name, "^test_", "")
    params = F.regexp_extract(plain, r"\[(.*)\]$", 1)
    words = F.transform(F.when(params != "", F.split(params, "-")).otherwise(F.array().cast("array<string>")), lambda p: F.replace(p, F.lit("_"), F.lit(" ")))
    return F.struct(F.regexp_replace(plain, r"\[.*\]$", "").alias("function"), words.alias("params"))
