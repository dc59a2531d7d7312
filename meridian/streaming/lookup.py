"""Lookups on streams: the Arrow strategy keeps no state and drops no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import ZoneIndex
from ..operators.lookup import lookup


def lookup_stream(stream: DataFrame, index: ZoneIndex, mode: str = "full", **how) -> DataFrame:
    """Every row of a stream with its zone."""
    return lookup(stream, index, mode, "arrow", **how)


def local_hours(stream: DataFrame, index: ZoneIndex, ts: str, late: str = "1 hour") -> DataFrame:
    """Rows of a stream (or table) by zone and hour of local time, with a watermark on the UTC time."""
    named = lookup_stream(stream.withWatermark(ts, late), index)
    return named.withColumn("local_hour", F.hour(F.from_utc_timestamp(F.col(ts), F.col("tz_name")))).groupBy(F.window(ts, "1 hour"), "tz_name", "local_hour").agg(F.count(F.lit(1)).alias("n"))
