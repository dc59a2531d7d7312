"""Lookups over one index a session: module functions, SQL functions, and their names for a command line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.index import ZoneIndex
from .operators.lookup import Finder, _arrow

_finders: dict[str, Finder] = {}
#: Session setting that names the saved index.
INDEX = "spark.meridian.index"


def use(index: ZoneIndex | str, spark: SparkSession | None = None, strategy: str = "auto") -> Finder:
    """Set the session's index: a compiled one, or the path of a saved one."""
    spark = spark or SparkSession.active()
    if isinstance(index, str):
        index = ZoneIndex.load(spark, index)
    found = _finders[spark.sparkContext.applicationId] = Finder(index, strategy)
    return found


def finder(spark: SparkSession | None = None) -> Finder:
    """The session's finder; made once from ``spark.meridian.index`` if none was set."""
    spark = spark or SparkSession.active()
    key = spark.sparkContext.applicationId
    if key not in _finders:
        path = spark.conf.get(INDEX, None)
        if not path:
            raise ValueError(f"no index: call use(), or set {INDEX}")
        use(path, spark)
    return _finders[key]


def timezone_at(df: DataFrame, **how) -> DataFrame:
    return finder(df.sparkSession).timezone_at(df, **how)


def timezone_at_land(df: DataFrame, **how) -> DataFrame:
    return finder(df.sparkSession).timezone_at_land(df, **how)


def certain_timezone_at(df: DataFrame, **how) -> DataFrame:
    return finder(df.sparkSession).certain_timezone_at(df, **how)


def unique_timezone_at(df: DataFrame, **how) -> DataFrame:
    return finder(df.sparkSession).unique_timezone_at(df, **how)


def get_geometry(zone: str | int, pairs: bool = True, spark: SparkSession | None = None) -> DataFrame:
    return finder(spark).get_geometry(zone, pairs)


def register(spark: SparkSession, index: ZoneIndex) -> None:
    """SQL functions timezone_at(lng, lat), certain_timezone_at, unique_timezone_at, light_timezone_at: a name or null."""
    _arrow(spark.range(0).select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), index, "full")
    sent = index.sent
    names = {r["zone_id"]: r["tz_name"] for r in index.zones.select("zone_id", "tz_name").collect()}

    def named(mode: str):
        @F.pandas_udf("string")
        def zone(lng: pd.Series, lat: pd.Series) -> pd.Series:
            ok = ((lng.abs() <= 180) & (lat.abs() <= 90)).to_numpy(dtype=bool)
            out = np.full(len(lng), None, dtype=object)
            if ok.any():
                x, y = ((v[ok].to_numpy(float) * 10_000_000).astype(np.int64) for v in (lng, lat))
                out[ok] = [names.get(int(z)) for z in sent.value.locate(x, y, mode)]
            return pd.Series(out, dtype=object)

        return zone

    for mode in ("full", "certain", "unique", "light"):
        spark.udf.register("timezone_at" if mode == "full" else f"{mode}_timezone_at", named(mode))


__all__ = ["certain_timezone_at", "finder", "get_geometry", "register", "timezone_at", "timezone_at_land", "unique_timezone_at", "use"]
