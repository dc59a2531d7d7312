"""GeoJSON in, engine tables out: zones, polygons, holes, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import is_ocean, ring_key, scaled

_FEATURES = "features array<struct<properties:struct<tzid:string>,geometry:struct<type:string,coordinates:string>>>"
_RINGS = "array<array<array<array<double>>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row for each polygon ring of the FeatureCollections at ``path``."""
    return flatten(spark.read.text(path, wholetext=True))


def flatten(texts: DataFrame) -> DataFrame:
    """(value) to zone_id, tz_name, poly_id, hole_id (null: boundary), xs, ys.

    Ids are dense in file order: counts are summed over the features, which are
    few, and never over polygons.
    """
    got = texts.select(F.from_json("value", f"struct<{_FEATURES}>").alias("c")).select(F.posexplode("c.features").alias("zone_id", "f"))
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polys = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords), _RINGS)
    zones = got.select("zone_id", F.col("f.properties.tzid").alias("tz_name"), polys.alias("polys"))
    before = Window.orderBy("zone_id").rowsBetween(Window.unboundedPreceding, -1)
    sized = zones.withColumn("n_holes", F.aggregate("polys", F.lit(0), lambda a, p: a + F.size(p) - 1)).select(
        "*", F.coalesce(F.sum(F.size("polys")).over(before), F.lit(0)).alias("first_poly"), F.coalesce(F.sum("n_holes").over(before), F.lit(0)).alias("first_hole")
    )
    each = sized.select("zone_id", "tz_name", "first_poly", "first_hole", "polys", F.posexplode("polys").alias("p", "rings"))
    holes_before = F.aggregate(F.slice("polys", F.lit(1), F.col("p")), F.lit(0), lambda a, q: a + F.size(q) - 1)
    each = each.select("zone_id", "tz_name", (F.col("first_poly") + F.col("p")).alias("poly_id"), (F.col("first_hole") + holes_before).alias("h0"), F.posexplode("rings").alias("r", "ring"))
    xs = lambda k: F.transform("ring", lambda v: scaled(v[k]))
    each = each.select("zone_id", "tz_name", F.col("poly_id").cast("int"), F.when(F.col("r") > 0, F.col("h0") + F.col("r") - 1).cast("int").alias("hole_id"), xs(0).alias("xs"), xs(1).alias("ys"))
    closed = (F.size("xs") > 1) & (F.element_at("xs", 1) == F.element_at("xs", -1)) & (F.element_at("ys", 1) == F.element_at("ys", -1))
    opened = lambda c: F.when(closed, F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(F.col(c))
    return each.withColumns({"xs_": opened("xs"), "ys_": opened("ys")}).select("zone_id", "tz_name", "poly_id", "hole_id", F.col("xs_").alias("xs"), F.col("ys_").alias("ys"))


def _bounds() -> list[Column]:
    return [F.size("xs").alias("n_vertices"), F.array_min("xs").alias("xmin"), F.array_max("xs").alias("xmax"), F.array_min("ys").alias("ymin"), F.array_max("ys").alias("ymax")]


def zones_of(rings: DataFrame) -> DataFrame:
    return rings.select("zone_id", "tz_name").distinct().withColumn("is_ocean", is_ocean(F.col("tz_name")))


def polygons_of(rings: DataFrame) -> DataFrame:
    return rings.where("hole_id is null").select("poly_id", "zone_id", *_bounds(), "xs", "ys")


def holes_of(rings: DataFrame) -> DataFrame:
    """Holes; one with the same ring as a boundary refers to it instead of keeping its own."""
    own = rings.where("hole_id is not null").select("hole_id", "poly_id", *_bounds(), "xs", "ys")
    box = ["n_vertices", "xmin", "xmax", "ymin", "ymax"]
    # Rings are compared in canonical form only where bounds and size agree.
    twins = (
        own.alias("h")
        .join(polygons_of(rings).alias("p"), [F.col(f"h.{c}") == F.col(f"p.{c}") for c in box])
        .where(ring_key(F.col("h.xs"), F.col("h.ys")) == ring_key(F.col("p.xs"), F.col("p.ys")))
        .groupBy(F.col("h.hole_id").alias("t_id"))
        .agg(F.min("p.poly_id").alias("ref_poly_id"))
    )
    return own.join(twins, F.col("hole_id") == F.col("t_id"), "left").select("hole_id", "poly_id", *box, "ref_poly_id", F.when(F.col("ref_poly_id").isNull(), F.col("xs")).alias("xs"), F.when(F.col("ref_poly_id").isNull(), F.col("ys")).alias("ys"))


def edges_of(rings: DataFrame, level: bool = False) -> DataFrame:
    """Upward edges of all rings; level ones never cross a ray and are left out unless asked for."""
    prev = lambda c: F.concat(F.slice(c, -1, 1), F.slice(c, F.lit(1), F.size(c) - 1))
    pts = F.arrays_zip(prev("xs").alias("x1"), prev("ys").alias("y1"), F.col("xs").alias("x2"), F.col("ys").alias("y2"))
    e = rings.where(F.size("xs") > 0).select("poly_id", F.coalesce("hole_id", F.lit(-1)).alias("hole_id"), F.explode(pts).alias("e"))
    e = e if level else e.where("e.y1 <> e.y2")
    up = F.col("e.y1") < F.col("e.y2")
    pick = lambda a, b: F.when(up, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}"))
    return e.select("poly_id", "hole_id", pick("x1", "x2").alias("x_low"), pick("y1", "y2").alias("y_low"), pick("x2", "x1").alias("x_high"), pick("y2", "y1").alias("y_high"))
