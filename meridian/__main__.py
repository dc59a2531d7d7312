"""Command line: one point, or CSV files, against a saved index.

    python -m meridian --index PATH --lng 13.4 --lat 52.5 [--mode full]
    python -m meridian --index PATH --csv IN --out OUT [--sep , --lng-column lon --lat-column lat]

Exit codes: 0 done, 1 no zone or some lines without one, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.index import ZoneIndex
from .operators.lookup import MODES, lookup
from .sources import csvio


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="meridian", description="timezones of coordinates")
    p.add_argument("--index", required=True)
    p.add_argument("--mode", choices=MODES, default="full")
    p.add_argument("--lng", type=float)
    p.add_argument("--lat", type=float)
    p.add_argument("--csv")
    p.add_argument("--out")
    p.add_argument("--sep", default=",")
    p.add_argument("--lng-column")
    p.add_argument("--lat-column")
    p.add_argument("--no-header", dest="header", action="store_false", default=None)
    return p


def run(spark: SparkSession, given: argparse.Namespace) -> int:
    point = given.lng is not None and given.lat is not None
    if point == (given.csv is not None) or (given.csv is None) != (given.out is None):
        print("give either --lng and --lat, or --csv and --out", file=sys.stderr)
        return 2
    try:
        index = ZoneIndex.load(spark, given.index)
        if point:
            found = lookup(spark.createDataFrame([(given.lng, given.lat)], "lng double, lat double"), index, given.mode).first()
            print(found["tz_name"] or "")
            if found["error"]:
                print(found["error"], file=sys.stderr)
            return int(found["tz_name"] is None)
        rows = csvio.annotate_csv(spark, given.csv, index, given.mode, given.sep, given.lng_column, given.lat_column, given.header)
        csvio.write_csv(rows, given.out, given.sep)
        return int(not rows.where(F.col("tz_name").isNull()).isEmpty())
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    return run(SparkSession.builder.appName("meridian").getOrCreate(), given)


if __name__ == "__main__":
    sys.exit(main())
