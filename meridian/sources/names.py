"""Zone names as text: one a line, the line number is the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_zone_names(spark: SparkSession, path: str) -> DataFrame:
    """zone_id, tz_name of a names file; blank lines don't count."""
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", "\r?\n"), lambda v: F.trim(v)), lambda v: v != "").alias("names"))
    return lines.select(F.posexplode("names").alias("zone_id", "tz_name"))


def write_zone_names(zones: DataFrame, path: str) -> None:
    """The names in order of their ids, as one text."""
    zones.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("zone_id", "tz_name"))), lambda z: z["tz_name"]), "\n").alias("value")).write.mode("overwrite").text(path)
