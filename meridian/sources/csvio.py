"""CSV in, annotated CSV out: every input line comes back whole and in order, bad ones with an empty zone.

Lines are read as text, so a row with more fields than the others keeps them all;
fields are parsed beside the line, for the coordinates.  Quoted line breaks aren't supported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import ZoneIndex
from ..operators.lookup import lookup

#: Header names that are taken for coordinates, by priority.
USUAL = {"lng": ("lng", "lon", "long", "longitude", "x"), "lat": ("lat", "latitude", "y")}
_BOM = "﻿"


def separator(given: str) -> str:
    """The one character between fields; ``\\t`` may be spelled out."""
    known = {"\\t": "\t"}.get(given, given)
    if len(known) != 1:
        raise ValueError(f"fields are separated by one character, not by {given!r}")
    return known


def is_number(field: Column) -> Column:
    """Whether a field reads as a number (``nan`` and ``inf`` do)."""
    return F.trim(field).try_cast("double").isNotNull()


@dataclass(frozen=True)
class Columns:
    """What the first line says: its fields, and whether they are names; and the fields of the widest line."""

    line: str
    first: tuple[str, ...]
    named: bool
    width: int

    def places(self) -> dict[str, int]:
        """Position of each column name, the first of equal ones."""
        out: dict[str, int] = {}
        for k, name in enumerate(self.first if self.named else ()):
            out.setdefault(name.removeprefix(_BOM).strip().lower(), k)
        return out

    def coordinates(self, **asked: str | None) -> dict[str, int]:
        """Positions of ``lng`` and ``lat``, each asked for by name or number (from 1), or left to the usual names."""
        places = self.places()
        wishes = {axis: [want.strip().lower()] if want else list(USUAL[axis]) for axis, want in asked.items()}
        numbers = {str(k + 1): k for k in range(self.width)}
        found = {}
        for axis, names in wishes.items():
            if not asked[axis] and not self.named:
                raise ValueError(f"without a header line, say which column holds {axis}")
            table = numbers if names[0].isascii() and names[0].isdecimal() else places
            match = [table[n] for n in names if n in table]
            if not match:
                raise ValueError(f"no column for {axis}: looked for {', '.join(names)} in {', '.join(table) or 'nothing'}")
            found[axis] = match[0]
        if len(set(found.values())) < len(found):
            raise ValueError("longitude and latitude can't be one column")
        return found


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, line): the lines of text files, and where they stand (file, start of the block read, number in it)."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("number"))
    return spark.read.text(path).where("value <> ''").select(at.alias("at"), F.col("value").alias("line"))


def fields_of(lines: DataFrame, sep: str, width: int) -> DataFrame:
    """``lines`` with an array of ``width`` fields (null where a line has fewer)."""
    names = [f"f{k}" for k in range(width)]
    parsed = F.from_csv(F.col("line"), ", ".join(f"{n} string" for n in names), {"sep": sep, "mode": "PERMISSIVE"})
    return lines.withColumn("fields", parsed).withColumn("fields", F.array(*[F.col(f"fields.{n}") for n in names]))


def inspect(lines: DataFrame, sep: str, header: bool | None = None) -> Columns:
    """The columns of CSV lines: one pass for the widest line and the first one."""
    marks = F.length("line") - F.length(F.replace(F.col("line"), F.lit(sep), F.lit("")))
    seen = lines.agg((F.max(marks) + 1).alias("width"), F.min_by("line", "at").alias("line")).first()
    if seen["width"] is None:
        return Columns("", (), bool(header), 0)
    first = fields_of(lines.sparkSession.createDataFrame([(seen["line"],)], "line string"), sep, seen["width"])
    row = first.select("fields", F.exists("fields", is_number).alias("data")).first()
    return Columns(seen["line"], tuple(f or "" for f in row["fields"]), not row["data"] if header is None else header, seen["width"])


def annotate_csv(spark: SparkSession, path: str, index: ZoneIndex, mode: str = "full", sep: str = ",", lng: str | None = None, lat: str | None = None, header: bool | None = None, strategy: str = "auto") -> DataFrame:
    """(at, line, fields, tz_name, error) of the data lines of CSV files; order by ``at`` for their order.

    Raises ValueError before any row is looked up if the coordinates' columns can't be told.
    """
    sep = separator(sep)
    lines = read_lines(spark, path)
    columns = inspect(lines, sep, header)
    if not columns.width:
        return lookup(lines.select("at", "line", F.array().cast("array<string>").alias("fields"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat")).where("false"), index, mode).select("at", "line", "fields", "tz_name", "error")
    where = columns.coordinates(lng=lng, lat=lat)
    if columns.named:  # every file starts with the same line
        lines = lines.where(F.col("line") != columns.line)
    rows = fields_of(lines, sep, columns.width)
    points = rows.select("at", "line", "fields", *[F.get("fields", F.lit(k)).alias(axis) for axis, k in where.items()])
    return lookup(points, index, mode, strategy).select("at", "line", "fields", "tz_name", "error")


def write_csv(found: DataFrame, path: str, sep: str = ",") -> None:
    """The lines as they were, in their order, with the zone's name as one more field."""
    name = F.coalesce(F.col("tz_name"), F.lit(""))
    found.orderBy("at").select(F.concat("line", F.lit(separator(sep)), name).alias("value")).write.mode("overwrite").text(path)
