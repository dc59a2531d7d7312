"""Integrity checks: each returns its violations, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RELEASE_TAG, X_MAX, Y_MAX, boxes_overlap, cell_of
from .index import ZoneIndex, covered_cells
from .pip import rings_around

#: Cells in which boxes are brought together.
COARSE = 100_000_000


def bad_rings(rings: DataFrame) -> DataFrame:
    """Rings of under three vertices, of unequal axes, or beyond the globe."""
    out = F.exists("xs", lambda v: F.abs(v) > X_MAX) | F.exists("ys", lambda v: F.abs(v) > Y_MAX)
    why = F.when(F.size("xs") != F.size("ys"), "axes differ").when(F.size("xs") < 3, "under three vertices").when(out, "beyond the globe")
    return rings.select("poly_id", "hole_id", why.alias("problem")).where("problem is not null")


def unordered_zone_ids(polygons: DataFrame) -> DataFrame:
    """Polygons whose zone id is smaller than that of the polygon before."""
    before = F.lag("zone_id").over(Window.orderBy("poly_id"))
    return polygons.select("poly_id", "zone_id", before.alias("before")).where("before > zone_id")


def zones_without_polygons(index: ZoneIndex) -> DataFrame:
    return index.zones.join(index.polygons, "zone_id", "left_anti").select("zone_id", "tz_name")


def orphan_holes(holes: DataFrame, polygons: DataFrame) -> DataFrame:
    return holes.join(polygons.select("poly_id"), "poly_id", "left_anti").select("hole_id", "poly_id")


def wrong_references(index: ZoneIndex) -> DataFrame:
    """Holes that have both or neither of ring and reference, or whose reference has other bounds."""
    box = ["xmin", "xmax", "ymin", "ymax", "n_vertices"]
    twin = index.polygons.select(F.col("poly_id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in box])
    both = index.holes.join(twin, F.col("ref_poly_id") == F.col("t_id"), "left")
    differ = F.lit(False)
    for c in box:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"t_{c}"))
    return both.where((F.col("xs").isNotNull() == F.col("ref_poly_id").isNotNull()) | (F.col("ref_poly_id").isNotNull() & differ)).select("hole_id", "poly_id", "ref_poly_id")


def dedup_ratio(holes: DataFrame) -> DataFrame:
    """How many holes there are, and the share of them kept as a reference to a boundary (null: no holes)."""
    return holes.agg(F.count(F.lit(1)).alias("holes"), F.avg(F.col("ref_poly_id").isNotNull().cast("double")).alias("ratio"))


def uncovered_vertices(index: ZoneIndex) -> DataFrame:
    """Polygons with a vertex in a cell that lists neither them nor their zone alone."""
    pts = index.polygons.select("poly_id", "zone_id", F.explode(F.arrays_zip("xs", "ys")).alias("p")).select("poly_id", "zone_id", cell_of(F.col("p.xs"), F.col("p.ys"), index.cell).alias("cell_id")).distinct()
    listed = index.cells.select("cell_id", "unique_zone_id", F.coalesce(F.transform("candidates", lambda c: c["poly_id"]), F.array().cast("array<int>")).alias("ids"))
    both = pts.join(listed, "cell_id", "left")
    return both.where(~F.coalesce(F.array_contains("ids", F.col("poly_id")) | (F.col("unique_zone_id") == F.col("zone_id")), F.lit(False))).select("poly_id", "cell_id")


def unused_polygons(index: ZoneIndex) -> DataFrame:
    """Polygons that no cell lists, and whose zone no cell has alone."""
    listed = index.cells.where("candidates is not null").select(F.explode("candidates.poly_id").alias("poly_id")).distinct()
    alone = index.cells.where("unique_zone_id is not null").select(F.col("unique_zone_id").alias("zone_id")).distinct()
    return index.polygons.join(listed, "poly_id", "left_anti").join(alone, "zone_id", "left_anti").select("poly_id", "zone_id")


def incoherent_candidates(index: ZoneIndex) -> DataFrame:
    """Cells whose candidates of one zone don't stand together."""
    each = index.cells.where("candidates is not null").select("cell_id", F.inline("candidates"))
    changed = F.coalesce((F.lag("zone_id").over(Window.partitionBy("cell_id").orderBy("pos")) != F.col("zone_id")).cast("int"), F.lit(1))
    return each.withColumn("new", changed).groupBy("cell_id").agg(F.sum("new").alias("runs"), F.countDistinct("zone_id").alias("zones")).where("runs <> zones")


def counts(index: ZoneIndex) -> DataFrame:
    """Numbers of zones, polygons and holes, the data's version and the cell size: one row."""
    spark = index.zones.sparkSession
    one = index.zones.agg(F.count(F.lit(1)).alias("zones"))
    for name in ("polygons", "holes", "cells"):
        one = one.join(F.broadcast(getattr(index, name).agg(F.count(F.lit(1)).alias(name))))
    return one.join(F.broadcast(spark.createDataFrame([(index.data_version, index.cell)], "data_version string, cell long")))


def count_mismatch(index: ZoneIndex) -> DataFrame:
    """A row if there are fewer polygons than zones, or polygons of other zones than those named."""
    polys = index.polygons.agg(F.count(F.lit(1)).alias("polygons"), F.countDistinct("zone_id").alias("used"))
    return index.zones.agg(F.count(F.lit(1)).alias("zones")).join(F.broadcast(polys)).where("polygons < zones or used <> zones")


def bad_entries(index: ZoneIndex) -> DataFrame:
    """Cells that are listed twice, lie outside the grid, or whose candidates are empty, repeated or out of order."""
    n = F.size("candidates")
    ids = F.transform("candidates", lambda c: c["poly_id"])
    places = F.transform("candidates", lambda c: c["pos"])
    column, row = F.floor(F.col("cell_id") / 100_000), F.pmod("cell_id", F.lit(100_000))
    outside = (column < 0) | (column >= 2 * X_MAX // index.cell) | (row >= 2 * Y_MAX // index.cell)
    why = (
        F.when(outside, "outside the grid")
        .when(F.count(F.lit(1)).over(Window.partitionBy("cell_id")) > 1, "listed twice")
        .when(F.col("unique_zone_id").isNull() & (F.coalesce(n, F.lit(0)) == 0), "no candidates")
        .when(F.size(F.array_distinct(ids)) < n, "a polygon twice")
        .when(places != F.sequence(F.lit(0), n - 1), "out of order")
    )
    return index.cells.withColumn("problem", why).where("problem is not null").select("cell_id", "problem")


def polygons_in_holes(index: ZoneIndex) -> DataFrame:
    """(hole_id, poly_id, any, whole): polygons with a vertex in a hole of another polygon, and whether all are."""
    holes = index.holes.join(index.polygons.select(F.col("poly_id").alias("ref_poly_id"), F.col("xs").alias("r_xs"), F.col("ys").alias("r_ys")), "ref_poly_id", "left")
    box = ["xmin", "xmax", "ymin", "ymax"]
    own = holes.select("hole_id", F.col("poly_id").alias("owner"), *[F.col(c).alias(f"h_{c}") for c in box])
    # Boxes meet cell by cell of a coarse grid, so that no pair of far ones is looked at.
    near = covered_cells(own.select("hole_id", "owner", *[F.col(f"h_{c}").alias(c) for c in box]), COARSE).select("cell_id", "hole_id", "owner", *[F.col(c).alias(f"h_{c}") for c in box])
    polys = covered_cells(index.polygons.select("poly_id", *box), COARSE).select("cell_id", "poly_id", *box)
    pairs = near.join(polys, "cell_id").where(boxes_overlap("", "h_")).where("owner <> poly_id").select("hole_id", "owner", "poly_id").distinct()
    vertices = index.polygons.select("poly_id", F.explode(F.arrays_zip("xs", "ys")).alias("v")).select("poly_id", F.col("v.xs").alias("x"), F.col("v.ys").alias("y"))
    at = pairs.join(vertices, "poly_id")
    inside = rings_around(at.select("x", "y", F.col("owner").alias("poly_id")).distinct(), index.bands).where("hole_id <> -1").select("x", "y", "hole_id", F.lit(True).alias("hit"))
    met = at.join(inside, ["x", "y", "hole_id"], "left").groupBy("hole_id", "poly_id").agg(F.count("hit").alias("inside"), F.count(F.lit(1)).alias("vertices"))
    return met.where("inside > 0").select("hole_id", "poly_id", F.lit(True).alias("any"), (F.col("inside") == F.col("vertices")).alias("whole"))


def unordered_releases(releases: DataFrame, order: str, tag: str = "tag") -> DataFrame:
    """Rows of a list of release tags that don't come after the one before: by year, then by letters in base 26."""
    place = F.struct(F.substring(tag, 1, 4), F.length(tag), F.col(tag))
    before = F.lag(place).over(Window.orderBy(order))
    return releases.where(F.col(tag).rlike(RELEASE_TAG)).withColumn("ok", place > before).where(~F.col("ok")).drop("ok")


def overlapping_boxes(polygons: DataFrame) -> DataFrame:
    """(a, b): pairs of polygons whose boxes share a point, brought together by the cells of a coarse grid."""
    box = ["xmin", "xmax", "ymin", "ymax"]
    cells = covered_cells(polygons.select("poly_id", *box), COARSE)
    left = cells.select("cell_id", F.col("poly_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in box])
    right = cells.select("cell_id", F.col("poly_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in box])
    return left.join(right, "cell_id").where(boxes_overlap("a_", "b_")).where("a < b").select("a", "b").distinct()


def provenance_problems(meta: dict, wanted: dict) -> list[str]:
    """What keeps benchmark points of one origin from being used with an index of another."""
    return [f"{k}: made with {meta.get(k)!r}, wanted {v!r}" for k, v in wanted.items() if meta.get(k) != v] + (["made in debug mode"] if meta.get("debug") else [])
