"""The compiled index: tables of zones, polygons, holes, edges and grid cells."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import X_MAX, Y_MAX, cell_id, column_of, row_of
from ..sources import geojson as src
from .pip import BAND, banded, contained

FORMAT_VERSION = 1
CELL = 10_000_000
_TABLES = ("zones", "polygons", "holes", "edges", "bands", "cells")


def covered_cells(boxes: DataFrame, cell: int) -> DataFrame:
    """Rows with xmin, xmax, ymin, ymax once for each cell that their box reaches."""
    columns = F.sequence(column_of(F.col("xmin"), cell), column_of(F.col("xmax"), cell))
    rows = F.sequence(row_of(F.col("ymin"), cell), row_of(F.col("ymax"), cell))
    return boxes.withColumn("cx", F.explode(columns)).withColumn("cy", F.explode(rows)).withColumn("cell_id", cell_id(F.col("cx"), F.col("cy")))


def candidates(polygons: DataFrame, outline: DataFrame, bands: DataFrame, cell: int, band: int = BAND) -> DataFrame:
    """(cell_id, poly_id) of every polygon that may hold a point of the cell.

    A cell that the box of an edge of the outline (level ones too) reaches may; of the other cells in a polygon's box,
    those whose centre it holds.
    """
    box = [F.least("x_low", "x_high").alias("xmin"), F.greatest("x_low", "x_high").alias("xmax"), F.col("y_low").alias("ymin"), F.col("y_high").alias("ymax")]
    touched = covered_cells(outline.select("poly_id", *box), cell).select("cell_id", "poly_id").distinct()
    rest = covered_cells(polygons.select("poly_id", "xmin", "xmax", "ymin", "ymax"), cell).select("cell_id", "poly_id", "cx", "cy").join(touched, ["cell_id", "poly_id"], "left_anti")
    centre = rest.select("cell_id", "poly_id", (F.col("cx") * cell - X_MAX + cell // 2).alias("x"), (F.col("cy") * cell - Y_MAX + cell // 2).alias("y"))
    inside = centre.join(contained(centre, bands, band), ["x", "y", "poly_id"], "left_semi").select("cell_id", "poly_id")
    return touched.unionByName(inside)


def cell_index(polygons: DataFrame, found: DataFrame) -> DataFrame:
    """cell_id, unique_zone_id, last_zone_id, candidates (pos, poly_id, zone_id, tested).

    Order: zones by their vertices in the cell, then polygons by vertices; ids
    break ties.  Candidates of the last zone need no test in the full lookup.
    """
    own = found.join(polygons.select("poly_id", "zone_id", "n_vertices"), "poly_id")
    total = F.sum("n_vertices").over(Window.partitionBy("cell_id", "zone_id"))
    ranked = own.withColumn("total", total).withColumn("pos", F.row_number().over(Window.partitionBy("cell_id").orderBy("total", "zone_id", "n_vertices", "poly_id")) - 1)
    listed = ranked.groupBy("cell_id").agg(F.min("zone_id").alias("lo"), F.max("zone_id").alias("hi"), F.max_by("zone_id", "pos").alias("last_zone_id"), F.sort_array(F.collect_list(F.struct("pos", "poly_id", "zone_id"))).alias("c"))
    tested = F.transform("c", lambda c: F.struct(c["pos"].alias("pos"), c["poly_id"].alias("poly_id"), c["zone_id"].alias("zone_id"), (c["zone_id"] != F.col("last_zone_id")).alias("tested")))
    return listed.select("cell_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("unique_zone_id"), "last_zone_id", F.when(F.col("lo") != F.col("hi"), tested).alias("candidates"))


@dataclass
class ZoneIndex:
    """The tables of an index; ``with`` releases what is kept in memory."""

    zones: DataFrame
    polygons: DataFrame
    holes: DataFrame
    edges: DataFrame
    bands: DataFrame
    cells: DataFrame
    cell: int = CELL
    data_version: str = "unknown"
    #: The broadcast copy that the Arrow strategy made.
    sent: Any = field(default=None, repr=False)

    @classmethod
    def compile(cls, rings: DataFrame, cell: int = CELL, data_version: str = "unknown") -> ZoneIndex:
        """From the rings of ``sources.geojson``."""
        polygons, edges = src.polygons_of(rings), src.edges_of(rings)
        bands = banded(edges)
        return cls(src.zones_of(rings), polygons, src.holes_of(rings), edges, bands, cell_index(polygons, candidates(polygons, src.edges_of(rings, level=True), bands, cell)), cell, data_version)

    def save(self, path: str) -> None:
        for name in _TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.zones.sparkSession
        spark.createDataFrame([(self.data_version, FORMAT_VERSION, self.cell)], "data_version string, format_version int, cell long").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, in_memory: bool = False) -> ZoneIndex:
        meta = spark.read.parquet(f"{path}/meta").first()
        if meta["format_version"] != FORMAT_VERSION:
            raise ValueError(f"{path} has format {meta['format_version']}; this version reads {FORMAT_VERSION}")
        index = cls(*[spark.read.parquet(f"{path}/{name}") for name in _TABLES], meta["cell"], meta["data_version"])
        return index.persist() if in_memory else index

    def persist(self) -> ZoneIndex:
        for name in ("zones", "polygons", "bands", "cells"):
            getattr(self, name).persist()
        return self

    def __enter__(self) -> ZoneIndex:
        return self

    def __exit__(self, *exc) -> None:
        for name in _TABLES:
            getattr(self, name).unpersist()
        if self.sent is not None:
            self.sent.unpersist()
            self.sent = None
