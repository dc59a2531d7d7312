"""Registered queries on the synthetic world and points derived from the tables, with oracle SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import geo
from ..operators import quality, stats
from ..operators.index import ZoneIndex, covered_cells
from ..operators.lookup import geometry, lookup
from ..operators.pip import contained, in_any_hole
from ..sources import csvio
from ..sources.geojson import flatten, read_geojson
from ..sources.registry import read_registry, write_registry
from ..streaming.lookup import lookup_stream
from . import world

#: Ten degrees: 36 by 18 cells, few enough for oracle SQL.
CELL = 100_000_000
#: The clocks that the worlds' invented land zones keep; oceans keep that of their own name.
CLOCKS = {
    "Land/Triangle": "America/Sao_Paulo",
    "Land/Host": "Africa/Lagos",
    "Land/Enclave": "Europe/Rome",
    "Land/Corner": "Asia/Kathmandu",
    "Land/Islands": "America/Chicago",
    "Land/Ponds": "America/New_York",
    "Land/Star": "Australia/Eucla",
    "Land/Strait": "Asia/Kolkata",
}
_kept: dict[tuple[str, str], ZoneIndex] = {}


def shared_path(spark: SparkSession) -> str:
    """A new folder that all executors share; only runs on one machine may do without a setting, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="meridian-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def rings_of(spark: SparkSession, zones) -> DataFrame:
    return flatten(spark.createDataFrame([(world.geojson(zones),)], "value string"))


def index_of(spark: SparkSession, name: str = "tiled") -> ZoneIndex:
    """The compiled index of a world: written once for each session."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _kept:
        path = shared_path(spark)
        ZoneIndex.compile(rings_of(spark, getattr(world, name)()), CELL, "2026c").save(path)
        _kept[key] = ZoneIndex.load(spark, path)
    return _kept[key]


def points(spark: SparkSession, sf_dir: str, table: str, key: str, *more: str) -> DataFrame:
    lng, lat = geo.derived_point(F.expr(key))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(key).alias("k"), lng.alias("lng"), lat.alias("lat"), *more)


def with_bad(df: DataFrame) -> DataFrame:
    return df.withColumns({"lng": F.when(F.col("k") % 97 == 0, 200.0).otherwise(F.col("lng")), "lat": F.when(F.col("k") % 101 != 0, F.col("lat"))})


def scaled(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey", *more: str) -> DataFrame:
    return points(spark, sf_dir, table, key, *more).select("k", geo.scaled(F.col("lng")).alias("x"), geo.scaled(F.col("lat")).alias("y"), *more)


_LNG = "CAST((({k} * 1299709) % 3600000) - 1800000 AS DOUBLE) / 10000.0"
_LAT = "CAST((({k} * 104729) % 1800000) - 900000 AS DOUBLE) / 10000.0"


def _pts(table: str = "customer", key: str = "c_custkey", more: str = "") -> str:
    lng, lat = _LNG.format(k=key), _LAT.format(k=key)
    return f"pts AS (SELECT {key} AS k, {lng} AS lng, {lat} AS lat, CAST(trunc({lng} * 10000000) AS BIGINT) AS x, CAST(trunc({lat} * 10000000) AS BIGINT) AS y{more} FROM {table})"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    typed = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT"
    if not rows:
        return f"{name} AS (SELECT {', '.join(f'0::BIGINT AS {c.strip()}' for c in columns.split(','))} WHERE false)"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(typed, r)) + ')' for r in rows)})"


def _world(zones=None) -> str:
    t = world.tables(zones or world.tiled())
    return ", ".join(
        [
            _values("zones", "zone_id, tz_name", t["zones"]),
            _values("polys", "poly_id, zone_id, n, xmin, xmax, ymin, ymax", t["polys"]),
            _values("holes", "hole_id, poly_id, n, xmin, xmax, ymin, ymax", t["holes"]),
            _values("edges", "poly_id, hole_id, xl, yl, xh, yh", t["edges"]),
            _values("outline", "poly_id, xmin, xmax, ymin, ymax", t["outline"]),
            _values("verts", "poly_id, hole_id, i, x, y", t["verts"]),
        ]
    )


def _inside(pts: str, to: str) -> str:
    return f"""{to}_h AS (SELECT p.k, e.poly_id, e.hole_id FROM {pts} p JOIN edges e ON p.y > e.yl AND p.y <= e.yh
      AND (e.xh - e.xl) * (p.y - e.yl) >= (p.x - e.xl) * (e.yh - e.yl) GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1),
    {to} AS (SELECT k, poly_id FROM {to}_h GROUP BY 1, 2 HAVING max(hole_id) = -1)"""


def _cells(cell: int = CELL) -> str:
    """CTEs up to cells: the index at a cell size."""
    right, top = 3_600_000_000 // cell - 1, 1_800_000_000 // cell - 1
    return f"""
cov AS (SELECT DISTINCT poly_id, cx, cy FROM outline,
  LATERAL (SELECT unnest(range(least((xmin + 1800000000) // {cell}, {right}), least((xmax + 1800000000) // {cell}, {right}) + 1)) AS cx),
  LATERAL (SELECT unnest(range(least((ymin + 900000000) // {cell}, {top}), least((ymax + 900000000) // {cell}, {top}) + 1)) AS cy)),
boxed AS (SELECT poly_id, cx, cy FROM polys,
  LATERAL (SELECT unnest(range(least((xmin + 1800000000) // {cell}, {right}), least((xmax + 1800000000) // {cell}, {right}) + 1)) AS cx),
  LATERAL (SELECT unnest(range(least((ymin + 900000000) // {cell}, {top}), least((ymax + 900000000) // {cell}, {top}) + 1)) AS cy)),
mids AS (SELECT DISTINCT cx * 100000 + cy AS k, cx * {cell} - 1800000000 + {cell // 2} AS x, cy * {cell} - 900000000 + {cell // 2} AS y FROM boxed),
{_inside("mids", "mid_in")},
cand AS (SELECT cx * 100000 + cy AS cell_id, poly_id FROM cov UNION
  SELECT b.cx * 100000 + b.cy, b.poly_id FROM boxed b JOIN mid_in m ON m.k = b.cx * 100000 + b.cy AND m.poly_id = b.poly_id),
totals AS (SELECT c.cell_id, c.poly_id, p.zone_id, p.n, sum(p.n) OVER (PARTITION BY c.cell_id, p.zone_id) AS total FROM cand c JOIN polys p USING (poly_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY total, zone_id, n, poly_id) - 1 AS pos FROM totals),
cells AS (SELECT cell_id, CASE WHEN min(zone_id) = max(zone_id) THEN min(zone_id) END AS unique_zone_id, arg_max(zone_id, pos) AS last_zone_id,
  CASE WHEN min(zone_id) <> max(zone_id) THEN count(*) ELSE 0 END AS n_cand FROM ranked GROUP BY cell_id)"""


_CELL_OF = f"least((x + 1800000000) // {CELL}, 35) * 100000 + least((y + 900000000) // {CELL}, 17)"


def _at(table: str = "customer", key: str = "c_custkey", more: str = "", zones=None) -> str:
    """CTEs up to tz(k, tz_name): the zone that holds each point of a world without overlaps."""
    return f"WITH {_world(zones)}, {_pts(table, key, more)}, {_inside('pts', 'in_p')}, tz AS (SELECT k, zones.tz_name, zones.zone_id FROM in_p JOIN polys USING (poly_id) JOIN zones ON zones.zone_id = polys.zone_id)"


def _full(table: str = "customer", key: str = "c_custkey", more: str = "") -> str:
    """CTEs up to full_(k, tz_id, tz_name): as the index answers, the last candidate untested."""
    return f"""WITH {_world()}, {_pts(table, key, more)}, {_inside('pts', 'in_p')}, {_cells()},
    hit AS (SELECT p.k, arg_min(r.zone_id, r.pos) AS z FROM pts p JOIN ranked r ON r.cell_id = {_CELL_OF} JOIN cells c ON c.cell_id = r.cell_id
      JOIN in_p i ON i.k = p.k AND i.poly_id = r.poly_id WHERE c.unique_zone_id IS NULL AND r.zone_id <> c.last_zone_id GROUP BY p.k),
    full_ AS (SELECT p.*, coalesce(c.unique_zone_id, hit.z, c.last_zone_id) AS zone_id FROM pts p LEFT JOIN cells c ON c.cell_id = {_CELL_OF} LEFT JOIN hit ON hit.k = p.k)"""


def _flag(df: DataFrame) -> DataFrame:
    return df.select("k", "tz_name")


def _rings(spark: SparkSession) -> DataFrame:
    return rings_of(spark, world.tiled())


def _ways() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    cust = lambda s, d: points(s, d, "customer", "c_custkey")
    q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

    q["scale_points"] = (lambda s, d: scaled(s, d), f"WITH {_pts()} SELECT k, x, y FROM pts")
    q["unscale_roundtrip"] = (lambda s, d: scaled(s, d).select("k", geo.unscaled(F.col("x")).alias("lng"), geo.unscaled(F.col("y")).alias("lat")), f"WITH {_pts()} SELECT k, CAST(x AS DOUBLE) * 1e-7::DOUBLE AS lng, CAST(y AS DOUBLE) * 1e-7::DOUBLE AS lat FROM pts")
    bad = f"WITH {_pts()}, bad AS (SELECT k, CASE WHEN k % 97 = 0 THEN 200.0 ELSE lng END AS lng, CASE WHEN k % 101 <> 0 THEN lat END AS lat FROM pts)"
    q["valid_points"] = (lambda s, d: with_bad(cust(s, d)).where(geo.coordinate_error(F.col("lng"), F.col("lat")).isNull()).select("k"), f"{bad} SELECT k FROM bad WHERE lng BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90")
    q["invalid_flagged"] = (
        lambda s, d: lookup(with_bad(cust(s, d)), index_of(s), "light").select("k", "error"),
        f"{bad} SELECT k, CASE WHEN lng IS NULL OR lat IS NULL THEN 'missing coordinate' WHEN lng NOT BETWEEN -180 AND 180 THEN 'longitude out of range' WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude out of range' END AS error FROM bad",
    )
    q["ocean_flag"] = (lambda s, d: index_of(s).zones.select("zone_id", "tz_name", "is_ocean"), f"WITH {_world()} SELECT CAST(zone_id AS INTEGER) AS zone_id, tz_name, starts_with(tz_name, 'Etc/GMT') AS is_ocean FROM zones")
    q["land_only"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), "land")), f"{_full()} SELECT k, CASE WHEN NOT starts_with(tz_name, 'Etc/GMT') THEN tz_name END AS tz_name FROM full_ LEFT JOIN zones USING (zone_id)")
    q["timezone_at"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s))), f"{_full()} SELECT k, tz_name FROM full_ LEFT JOIN zones USING (zone_id)")
    q["timezone_at_arrow"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), strategy="arrow")), f"{_full()} SELECT k, tz_name FROM full_ LEFT JOIN zones USING (zone_id)")
    q["certain_at"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), "certain")), f"{_at()} SELECT p.k, tz.tz_name FROM pts p LEFT JOIN tz USING (k)")
    q["unique_at"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), "unique")), f"{_full()} SELECT p.k, z.tz_name FROM pts p LEFT JOIN cells c ON c.cell_id = {_CELL_OF} LEFT JOIN zones z ON z.zone_id = c.unique_zone_id")
    q["light_at"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), "light")), f"{_full()} SELECT p.k, z.tz_name FROM pts p LEFT JOIN cells c ON c.cell_id = {_CELL_OF} LEFT JOIN zones z ON z.zone_id = coalesce(c.unique_zone_id, c.last_zone_id)")
    pairs = _near
    q["bbox_candidates"] = (lambda s, d: pairs(s, d).select("k", "poly_id"), f"WITH {_world()}, {_pts()} SELECT k, CAST(poly_id AS INTEGER) AS poly_id FROM pts JOIN polys ON x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
    q["pip_with_holes"] = (
        lambda s, d: (p := pairs(s, d)).join(contained(p, index_of(s).bands), ["x", "y", "poly_id"]).select("k", "poly_id"),
        f"WITH {_world()}, {_pts()}, {_inside('pts', 'in_p')} SELECT k, CAST(poly_id AS INTEGER) AS poly_id FROM in_p",
    )
    q["pip_boundary"] = (
        lambda s, d: (p := pairs(s, d)).join(contained(p, index_of(s).bands.where("hole_id = -1")), ["x", "y", "poly_id"]).select("k", "poly_id"),
        f"WITH {_world()}, {_pts()}, {_inside('pts', 'in_p')} SELECT k, CAST(poly_id AS INTEGER) AS poly_id FROM in_p_h WHERE hole_id = -1",
    )
    q["hole_hits"] = (
        lambda s, d: (p := pairs(s, d)).join(in_any_hole(p, index_of(s).bands), ["x", "y", "poly_id"]).select("k", "poly_id"),
        f"WITH {_world()}, {_pts()}, {_inside('pts', 'in_p')} SELECT DISTINCT k, CAST(poly_id AS INTEGER) AS poly_id FROM in_p_h WHERE hole_id <> -1",
    )
    q["candidates_exploded"] = (lambda s, d: index_of(s).cells.select("cell_id", F.inline("candidates")).select("cell_id", "pos", "poly_id", "zone_id"), f"{_full()} SELECT r.cell_id, CAST(pos AS INTEGER) AS pos, CAST(poly_id AS INTEGER) AS poly_id, CAST(zone_id AS INTEGER) AS zone_id FROM ranked r JOIN cells c USING (cell_id) WHERE c.unique_zone_id IS NULL")
    q["cell_index_build"] = (lambda s, d: index_of(s).cells.select("cell_id", "unique_zone_id", "last_zone_id"), f"{_full()} SELECT cell_id, CAST(unique_zone_id AS INTEGER) AS unique_zone_id, CAST(last_zone_id AS INTEGER) AS last_zone_id FROM cells")
    q["cell_of_point"] = (lambda s, d: scaled(s, d).select("k", geo.cell_of(F.col("x"), F.col("y"), CELL).alias("cell_id")), f"WITH {_pts()} SELECT k, {_CELL_OF} AS cell_id FROM pts")
    q["cell_stats"] = (
        lambda s, d: stats.index_stats(index_of(s)),
        f"{_full()} SELECT count(*) AS cells, count(unique_zone_id) AS unique_cells, count(*) - count(unique_zone_id) AS ambiguous_cells, CAST(sum(n_cand) AS BIGINT) AS candidates, CAST(max(n_cand) AS INTEGER) AS max_candidates, CAST(sum(CASE WHEN unique_zone_id IS NULL THEN 8 + 2 * n_cand ELSE 9 END) AS BIGINT) AS est_bytes FROM cells",
    )
    running = "SELECT CAST(value AS INTEGER) AS value, n, CAST(sum(n) OVER () AS BIGINT) AS total, CAST(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, CAST(sum(n) OVER () - sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS rest FROM f"
    q["candidates_hist"] = (lambda s, d: stats.frequencies(index_of(s).cells, F.coalesce(F.size("candidates"), F.lit(0))), f"{_full()}, f AS (SELECT n_cand AS value, count(*) AS n FROM cells GROUP BY 1) {running}")
    q["zones_per_cell_hist"] = (
        lambda s, d: stats.frequencies(index_of(s).cells, F.when(F.col("unique_zone_id").isNotNull(), 1).otherwise(F.size(F.array_distinct("candidates.zone_id")))),
        f"{_full()}, f AS (SELECT value, count(*) AS n FROM (SELECT cell_id, count(DISTINCT zone_id) AS value FROM ranked GROUP BY 1) GROUP BY 1) {running}",
    )
    q["ring_bbox"] = (lambda s, d: index_of(s).polygons.select("poly_id", "xmin", "xmax", "ymin", "ymax"), f"WITH {_world()} SELECT CAST(poly_id AS INTEGER) AS poly_id, xmin, xmax, ymin, ymax FROM polys")
    q["ring_sizes"] = (lambda s, d: index_of(s).polygons.select("poly_id", F.lit(-1).alias("hole_id"), "n_vertices").unionByName(index_of(s).holes.select("poly_id", "hole_id", "n_vertices")), f"WITH {_world()} SELECT CAST(poly_id AS INTEGER) AS poly_id, -1 AS hole_id, CAST(n AS INTEGER) AS n_vertices FROM polys UNION ALL SELECT CAST(poly_id AS INTEGER), CAST(hole_id AS INTEGER), CAST(n AS INTEGER) FROM holes")
    q["hole_registry"] = (lambda s, d: index_of(s).holes.groupBy("poly_id").agg(F.count(F.lit(1)).alias("n"), F.min("hole_id").alias("first")), f"WITH {_world()} SELECT CAST(poly_id AS INTEGER) AS poly_id, count(*) AS n, CAST(min(hole_id) AS INTEGER) AS first FROM holes GROUP BY 1")
    q["zone_positions"] = (lambda s, d: index_of(s).polygons.groupBy("zone_id").agg(F.min("poly_id").alias("first"), F.count(F.lit(1)).alias("n")), f"WITH {_world()} SELECT CAST(zone_id AS INTEGER) AS zone_id, CAST(min(poly_id) AS INTEGER) AS first, count(*) AS n FROM polys GROUP BY 1")
    q["hole_refs"] = (
        lambda s, d: index_of(s).holes.select("hole_id", "ref_poly_id"),
        # A hole and a boundary are the same ring if they agree in bounds and in all upward edges.
        f"WITH {_world()}, he AS (SELECT hole_id, list(struct_pack(a := xl, b := yl, c := xh, d := yh) ORDER BY yl, xl, yh, xh) AS e FROM edges WHERE hole_id >= 0 GROUP BY 1), pe AS (SELECT poly_id, list(struct_pack(a := xl, b := yl, c := xh, d := yh) ORDER BY yl, xl, yh, xh) AS e FROM edges WHERE hole_id = -1 GROUP BY 1) SELECT CAST(h.hole_id AS INTEGER) AS hole_id, CAST(min(pe.poly_id) AS INTEGER) AS ref_poly_id FROM he h LEFT JOIN pe ON pe.e = h.e GROUP BY 1",
    )
    ring = "list(struct_pack(a := xl, b := yl, c := xh, d := yh) ORDER BY yl, xl, yh, xh)"
    q["ring_keys"] = (
        lambda s, d: _rings(s).select(geo.ring_key(F.col("xs"), F.col("ys")).alias("ring")).groupBy("ring").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("rings")),
        f"WITH {_world()}, r AS (SELECT poly_id, hole_id, {ring} AS e FROM edges GROUP BY 1, 2) SELECT n, count(*) AS rings FROM (SELECT count(*) AS n FROM r GROUP BY e) GROUP BY n",
    )
    q["polygon_stats"] = (lambda s, d: stats.polygon_stats(index_of(s)), f"WITH {_world()} SELECT count(*) AS polygons, CAST(sum(n) AS BIGINT) AS vertices, avg(n) AS mean, CAST(max(n) AS INTEGER) AS most, CAST(min(n) AS INTEGER) AS least, CAST(2 * sum(n) AS BIGINT) AS coordinates FROM polys")
    q["hole_metrics"] = (lambda s, d: stats.hole_metrics(index_of(s)).select("holes", "parents"), f"WITH {_world()} SELECT count(*) AS holes, count(DISTINCT poly_id) AS parents FROM holes")
    per = f"WITH {_world()}, per AS (SELECT zone_id, count(*) AS n FROM polys GROUP BY 1)"
    q["tz_metrics"] = (lambda s, d: stats.zone_metrics(index_of(s)), f"{per} SELECT count(*) AS zones, CAST(sum(n) AS BIGINT) AS polygons, max(n) AS most, avg(n) AS mean, list_sort(list(n))[count(*) // 2 + 1] AS upper_median FROM per")
    q["polys_per_zone"] = (lambda s, d: stats.polygons_per_zone_distribution(index_of(s)), f"{per} SELECT n, count(*) AS zones, arg_min(tz_name, zone_id) AS example FROM per JOIN zones USING (zone_id) GROUP BY n")
    q["size_strata"] = (lambda s, d: stats.size_strata(index_of(s)), f"WITH {_world()}, c AS (SELECT quantile_cont(n, 0.5) AS a, quantile_cont(n, 0.9) AS b FROM polys) SELECT CAST(poly_id AS INTEGER) AS poly_id, CAST(n AS INTEGER) AS n_vertices, CASE WHEN n <= a THEN 'small' WHEN n <= b THEN 'medium' ELSE 'large' END AS stratum FROM polys, c")
    q["customers_per_tz"] = (lambda s, d: lookup(cust(s, d), index_of(s)).groupBy("tz_name").agg(F.count(F.lit(1)).alias("customers")), f"{_full()} SELECT tz_name, count(*) AS customers FROM full_ LEFT JOIN zones USING (zone_id) GROUP BY 1")
    q["orders_per_tz"] = (
        lambda s, d: lookup(points(s, d, "orders", "o_orderkey", "o_orderstatus"), index_of(s)).groupBy("tz_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders")),
        f"{_full('orders', 'o_orderkey', ', o_orderstatus')} SELECT tz_name, o_orderstatus, count(*) AS orders FROM full_ LEFT JOIN zones USING (zone_id) GROUP BY 1, 2",
    )
    q["items_per_tz"] = (
        lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).join(lookup(points(s, d, "orders", "o_orderkey"), index_of(s)).select("k", "tz_name"), "k").groupBy("tz_name").agg(F.sum("n").alias("items")),
        f"{_full('orders', 'o_orderkey')} SELECT tz_name, count(*) AS items FROM lineitem JOIN full_ ON l_orderkey = k LEFT JOIN zones USING (zone_id) GROUP BY 1",
    )
    dated = lambda s, d: lookup(points(s, d, "events", "event_id", F.col("ts").cast("timestamp").alias("ts")), index_of(s)).withColumn("clock", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CLOCKS.items() for x in pair]), F.col("tz_name")), F.col("tz_name")))
    own = " ".join(f"WHEN '{name}' THEN '{clock}'" for name, clock in CLOCKS.items())
    ev = f"{_full('events', 'event_id', ', ts')}, o AS (SELECT k, ts, timezone(CASE tz_name {own} ELSE tz_name END, timezone('UTC', ts)) AS here FROM full_ JOIN zones USING (zone_id))"
    q["events_utc_offset"] = (lambda s, d: dated(s, d).select("k", geo.utc_offset_minutes(F.col("ts"), F.col("clock")).alias("minutes")), f"{ev} SELECT k, CAST(date_diff('minute', ts, here) AS INTEGER) AS minutes FROM o")
    q["events_local_hour"] = (lambda s, d: dated(s, d).groupBy(F.hour(F.from_utc_timestamp("ts", F.col("clock"))).alias("local_hour")).agg(F.count(F.lit(1)).alias("events")), f"{ev} SELECT CAST(hour(here) AS INTEGER) AS local_hour, count(*) AS events FROM o GROUP BY 1")
    q["transition_matrix"] = (
        lambda s, d: stats.transitions(lookup(cust(s, d), index_of(s)), lookup(cust(s, d), index_of(s), "certain"), "k"),
        f"{_full()}, b AS (SELECT p.k, a.tz_name AS expected, z.tz_name AS got FROM full_ p LEFT JOIN zones a USING (zone_id) LEFT JOIN in_p i ON i.k = p.k LEFT JOIN polys USING (poly_id) LEFT JOIN zones z ON z.zone_id = polys.zone_id) SELECT expected, got, count(*) AS n FROM b WHERE expected IS DISTINCT FROM got GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 12",
    )
    q["coverage_gaps"] = (lambda s, d: lookup(cust(s, d), index_of(s, "gappy"), "certain").where("tz_id is null").select("k"), f"{_at(zones=world.gappy())} SELECT k FROM pts ANTI JOIN tz USING (k)")
    q["overlap_first"] = (lambda s, d: lookup(cust(s, d), index_of(s, "overlapping"), "certain").where("tz_id is not null").select("k", "tz_name"), f"{_at(zones=world.overlapping())} SELECT k, max(tz_name) AS tz_name FROM tz GROUP BY k")
    # The checks meet an index with planted faults: cells taken out, a polygon that no cell lists, candidates dealt anew.
    gone = (1_800_000 + 10, 2_000_000 + 11)
    q["index_completeness"] = (
        lambda s, d: quality.uncovered_vertices(_changed(s, cells=lambda c: c.where(~F.col("cell_id").isin(*gone)))),
        f"""WITH {_world()}, {_cells()}, left_ AS (SELECT * FROM cells WHERE cell_id NOT IN {gone}), v AS (SELECT DISTINCT poly_id, zone_id, {_CELL_OF} AS cell_id FROM verts JOIN polys USING (poly_id) WHERE hole_id = -1)
        SELECT CAST(v.poly_id AS INTEGER) AS poly_id, v.cell_id FROM v LEFT JOIN left_ c USING (cell_id) WHERE c.cell_id IS NULL OR (c.unique_zone_id IS DISTINCT FROM v.zone_id AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.cell_id = v.cell_id AND r.poly_id = v.poly_id))""",
    )
    extra = ("SELECT poly_id, 999 AS zone_id FROM polys WHERE poly_id = 0", 900)
    q["unused_polygons"] = (
        lambda s, d: quality.unused_polygons(_changed(s, polygons=lambda p: p.unionByName(p.where("poly_id = 0").withColumns({"poly_id": F.lit(extra[1]), "zone_id": F.lit(999)})))),
        f"""WITH {_world()}, {_cells()}, all_ AS (SELECT poly_id, zone_id FROM polys UNION ALL SELECT poly_id + {extra[1]}, zone_id FROM ({extra[0]}))
        SELECT CAST(poly_id AS INTEGER) AS poly_id, CAST(zone_id AS INTEGER) AS zone_id FROM all_ WHERE poly_id NOT IN (SELECT r.poly_id FROM ranked r JOIN cells c USING (cell_id) WHERE c.unique_zone_id IS NULL) AND zone_id NOT IN (SELECT unique_zone_id FROM cells WHERE unique_zone_id IS NOT NULL)""",
    )
    dealt = lambda c: c.withColumn("candidates", F.transform(F.sort_array(F.transform("candidates", lambda x: F.struct((x["poly_id"] % 2).alias("odd"), x["pos"].alias("was"), x.alias("x")))), lambda x, k: x["x"].withField("pos", k)))
    q["candidate_order"] = (
        lambda s, d: quality.incoherent_candidates(_changed(s, cells=dealt)),
        f"""WITH {_world()}, {_cells()}, d AS (SELECT r.cell_id, r.zone_id, row_number() OVER (PARTITION BY r.cell_id ORDER BY r.poly_id % 2, r.pos) AS pos FROM ranked r JOIN cells c USING (cell_id) WHERE c.unique_zone_id IS NULL),
        n AS (SELECT *, CASE WHEN lag(zone_id) OVER (PARTITION BY cell_id ORDER BY pos) = zone_id THEN 0 ELSE 1 END AS new_ FROM d)
        SELECT cell_id, CAST(sum(new_) AS BIGINT) AS runs, count(DISTINCT zone_id) AS zones FROM n GROUP BY 1 HAVING sum(new_) <> count(DISTINCT zone_id)""",
    )
    q["bad_entries"] = (
        lambda s, d: quality.bad_entries(_changed(s, cells=lambda c: dealt(c).withColumn("candidates", F.transform("candidates", lambda x: x.withField("pos", F.when(F.col("cell_id") >= 2_500_000, x["pos"] + 1).otherwise(x["pos"])))).unionByName(c.where("unique_zone_id = 8")))),
        f"""WITH {_world()}, {_cells()}, doubled AS (SELECT cell_id, 'listed twice' AS problem FROM cells, range(2) WHERE unique_zone_id = 8)
        SELECT cell_id, 'out of order' AS problem FROM cells WHERE unique_zone_id IS NULL AND cell_id >= 2500000 UNION ALL SELECT * FROM doubled""",
    )
    q["zone_id_monotone"] = (lambda s, d: quality.unordered_zone_ids(index_of(s).polygons), f"WITH {_world()} SELECT CAST(poly_id AS INTEGER) AS poly_id, CAST(zone_id AS INTEGER) AS zone_id, CAST(before AS INTEGER) AS before FROM (SELECT *, lag(zone_id) OVER (ORDER BY poly_id) AS before FROM polys) WHERE before > zone_id")
    lost = "hole_id % 4 = 1"  # these holes are given a parent that doesn't exist
    q["hole_parent_orphans"] = (
        lambda s, d: quality.orphan_holes(index_of(s).holes.withColumn("poly_id", F.when(F.expr(lost), F.col("poly_id") + 1000).otherwise(F.col("poly_id"))), index_of(s).polygons),
        f"WITH {_world()}, h AS (SELECT hole_id, CASE WHEN {lost} THEN poly_id + 1000 ELSE poly_id END AS poly_id FROM holes) SELECT CAST(hole_id AS INTEGER) AS hole_id, CAST(poly_id AS INTEGER) AS poly_id FROM h ANTI JOIN polys USING (poly_id)",
    )
    q["bad_rings"] = (lambda s, d: quality.bad_rings(_rings(s).withColumn("xs", F.when(F.col("poly_id") == 3, F.slice("xs", 1, 2)).otherwise(F.col("xs")))).select("poly_id", "problem").distinct(), "SELECT CAST(3 AS INTEGER) AS poly_id, 'axes differ' AS problem")
    runs = lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").alias("value"), "l_linenumber")
    rsql = "WITH r AS (SELECT l_returnflag || l_linestatus AS name, l_quantity AS value, l_linenumber FROM lineitem)"
    q["noise_stats"] = (lambda s, d: stats.noise(runs(s, d)).select("name", "n", "least", "most", "median", "spread_pct"), f"{rsql} SELECT name, count(*) AS n, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS median, max(value) / min(value) * 100 AS spread_pct FROM r GROUP BY 1")
    q["alert_threshold"] = (lambda s, d: stats.alert_threshold(stats.noise(runs(s, d))), f"{rsql}, n AS (SELECT max(value) / min(value) * 100 AS s FROM r GROUP BY name) SELECT CAST(greatest(ceil((100 + (max(s) - 100) * 1.2::DOUBLE) / 10) * 10, 110) AS BIGINT) AS threshold_pct FROM n")
    # Every line item is in one of the two runs; one name of each run is spelled so that the other has no such name.
    spelled = lambda df, name, other: df.withColumn("name", F.when(F.col("name") == name, F.lit(other)).otherwise(F.col("name")))
    q["run_compare"] = (
        lambda s, d: stats.compare_runs(spelled(runs(s, d).where("l_linenumber <= 3"), "AF", "AF before"), spelled(runs(s, d).where("l_linenumber > 3"), "RF", "RF after")),
        f"{rsql}, a AS (SELECT CASE name WHEN 'AF' THEN 'AF before' ELSE name END AS name, min(value) AS base FROM r WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT CASE name WHEN 'RF' THEN 'RF after' ELSE name END AS name, min(value) AS head FROM r WHERE l_linenumber > 3 GROUP BY 1) SELECT coalesce(a.name, b.name) AS name, base, head, head / base AS ratio FROM a FULL JOIN b ON a.name = b.name",
    )
    q["mem_stats"] = (lambda s, d: stats.memory_stats(runs(s, d)).select("name", "n", "least", "most"), f"{rsql} SELECT name, count(*) AS n, min(value) AS least, max(value) AS most FROM r GROUP BY 1")
    tag = lambda k: F.concat(F.lit("tz-"), (F.lit(2000) + k % 30).cast("string"), F.chr(97 + k % 26), F.when(k % 3 == 0, F.chr(97 + k % 7)).otherwise(""), F.lit(".json"))
    tsql = "t AS (SELECT c_custkey AS k, CAST(2000 + c_custkey % 30 AS VARCHAR) AS y, chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS a, CASE WHEN c_custkey % 3 = 0 THEN chr(CAST(97 + c_custkey % 7 AS INTEGER)) ELSE '' END AS b FROM customer)"
    q["release_tag"] = (lambda s, d: cust(s, d).select("k", geo.release_of(tag(F.col("k"))).alias("tag")), f"WITH {tsql} SELECT k, y || a || b AS tag FROM t")
    q["release_version"] = (
        lambda s, d: cust(s, d).select("k", geo.release_version(geo.release_of(tag(F.col("k")))).alias("version")),
        f"WITH {tsql} SELECT k, '1.' || y || '.' || CAST(CASE WHEN b = '' THEN ascii(a) - 96 ELSE (ascii(a) - 96) * 26 + ascii(b) - 96 END AS VARCHAR) AS version FROM t",
    )
    q["last_change_index"] = (
        lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda v: v["l_suppkey"] % 2).alias("ids")).select("l_orderkey", geo.last_change(F.col("ids")).alias("at")),
        "WITH r AS (SELECT l_orderkey, l_suppkey % 2 AS v, row_number() OVER w - 1 AS i, lag(l_suppkey % 2) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, CAST(coalesce(max(i) FILTER (v <> p), 0) AS INTEGER) AS at FROM r GROUP BY 1",
    )
    q["bbox_cells"] = (lambda s, d: covered_cells(index_of(s).polygons, CELL).groupBy("poly_id").agg(F.count(F.lit(1)).alias("cells")), f"WITH {_world()} SELECT CAST(poly_id AS INTEGER) AS poly_id, (least((xmax + 1800000000) // {CELL}, 35) - least((xmin + 1800000000) // {CELL}, 35) + 1) * (least((ymax + 900000000) // {CELL}, 17) - least((ymin + 900000000) // {CELL}, 17) + 1) AS cells FROM polys")
    shape = lambda zone, more: f"WITH {_world()} SELECT CAST(v.poly_id AS INTEGER) AS poly_id, CAST(count(DISTINCT v.hole_id) AS INTEGER) AS rings, {more} FROM verts v JOIN polys USING (poly_id) JOIN zones USING (zone_id) WHERE tz_name = '{zone}' GROUP BY 1"
    at_first = "CAST(min(v.{a}) FILTER (v.hole_id = -1 AND v.i = 0) AS DOUBLE) * 1e-7::DOUBLE AS {n}"
    q["geometry_pairs"] = (lambda s, d: geometry(index_of(s), "Land/Host").select("poly_id", F.size("rings").alias("rings"), F.size(F.flatten("rings")).alias("vertices"), F.col("rings")[0][0]["lng"].alias("lng")), shape("Land/Host", f"CAST(count(*) AS INTEGER) AS vertices, {at_first.format(a='x', n='lng')}"))
    q["geometry_lists"] = (lambda s, d: geometry(index_of(s), "Land/Islands", pairs=False).select("poly_id", F.size("rings").alias("rings"), F.col("rings")[0]["lngs"][0].alias("lng"), F.col("rings")[0]["lats"][0].alias("lat")), shape("Land/Islands", f"{at_first.format(a='x', n='lng')}, {at_first.format(a='y', n='lat')}"))
    q["geometry_vertices"] = (
        lambda s, d: geometry(index_of(s), "Land/Host").select("poly_id", F.posexplode("rings").alias("ring", "pts")).select("poly_id", "ring", F.posexplode("pts").alias("i", "p")).select("poly_id", F.col("ring") > 0, F.col("p.lng"), F.col("p.lat")).toDF("poly_id", "hole", "lng", "lat"),
        f"WITH {_world()} SELECT CAST(v.poly_id AS INTEGER) AS poly_id, v.hole_id >= 0 AS hole, CAST(v.x AS DOUBLE) * 1e-7::DOUBLE AS lng, CAST(v.y AS DOUBLE) * 1e-7::DOUBLE AS lat FROM verts v JOIN polys USING (poly_id) JOIN zones USING (zone_id) WHERE tz_name = 'Land/Host'",
    )
    # Whole cents, so that sums don't depend on their order.
    q["revenue_per_tz"] = (
        lambda s, d: lookup(points(s, d, "orders", "o_orderkey", "o_totalprice"), index_of(s)).groupBy("tz_name").agg(F.sum(F.floor(F.col("o_totalprice") * 100)).alias("cents")),
        f"{_full('orders', 'o_orderkey', ', o_totalprice')} SELECT tz_name, CAST(sum(CAST(floor(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM full_ LEFT JOIN zones USING (zone_id) GROUP BY 1",
    )
    q["dedup_ratio"] = (
        lambda s, d: quality.dedup_ratio(index_of(s).holes),
        f"SELECT count(*) AS holes, avg(CASE WHEN ref_poly_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS ratio FROM ({q['hole_refs'][1]})",
    )
    q["csv_annotate"] = (
        _csv,
        f"{_full('supplier', 's_suppkey')} SELECT k, CASE WHEN k % 97 <> 0 AND k % 101 <> 0 THEN tz_name END AS tz_name, CASE WHEN k % 101 = 0 THEN 'missing coordinate' WHEN k % 97 = 0 THEN 'longitude out of range' END AS error FROM full_ LEFT JOIN zones USING (zone_id)",
    )
    _more(q, cust)
    q["stream_lookup"] = (_stream, f"{_full()} SELECT k, tz_name FROM full_ LEFT JOIN zones USING (zone_id)")
    return q


def _changed(spark: SparkSession, **changes) -> ZoneIndex:
    """The tiled index with some of its tables changed."""
    index = index_of(spark)
    return replace(index, sent=None, **{name: change(getattr(index, name)) for name, change in changes.items()})


def _more(q: dict, cust: Callable) -> None:
    """Queries of boxes, cells, shares, formats, and of the ways to ask."""
    named = f"{_full()} SELECT k, tz_name FROM full_ LEFT JOIN zones USING (zone_id)"
    q["timezone_at_relational"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), strategy="relational")), named)
    q["certain_at_relational"] = (lambda s, d: _flag(lookup(cust(s, d), index_of(s), "certain", "relational")), f"{_at()} SELECT p.k, tz.tz_name FROM pts p LEFT JOIN tz USING (k)")

    def by_module(s: SparkSession, d: str) -> DataFrame:
        api.use(index_of(s), s)
        return _flag(api.timezone_at(cust(s, d)))

    def by_sql(s: SparkSession, d: str) -> DataFrame:
        api.register(s, index_of(s))
        return cust(s, d).selectExpr("k", "timezone_at(lng, lat) AS tz_name")

    q["module_timezone_at"], q["sql_timezone_at"] = (by_module, named), (by_sql, named)
    q["counts"] = (lambda s, d: quality.counts(index_of(s)), f"WITH {_world()}, {_cells()} SELECT (SELECT count(*) FROM zones) AS zones, (SELECT count(*) FROM polys) AS polygons, (SELECT count(*) FROM holes) AS holes, (SELECT count(*) FROM cells) AS cells, '2026c' AS data_version, {CELL}::BIGINT AS cell")
    q["count_mismatch"] = (
        lambda s, d: quality.count_mismatch(_changed(s, zones=lambda z: z.unionByName(z.withColumn("zone_id", F.col("zone_id") + 100)))),
        f"WITH {_world()}, n AS (SELECT 2 * (SELECT count(*) FROM zones) AS zones, count(*) AS polygons, count(DISTINCT zone_id) AS used FROM polys) SELECT * FROM n WHERE polygons < zones OR used <> zones",
    )
    q["box_overlaps"] = (lambda s, d: quality.overlapping_boxes(index_of(s).polygons), f"WITH {_world()} SELECT CAST(a.poly_id AS INTEGER) AS a, CAST(b.poly_id AS INTEGER) AS b FROM polys a JOIN polys b ON a.poly_id < b.poly_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")
    q["polygons_in_holes"] = (
        lambda s, d: quality.polygons_in_holes(index_of(s)),
        f"""WITH {_world()}, in_ AS (SELECT v.poly_id, v.i, e.hole_id FROM verts v JOIN edges e ON e.hole_id >= 0 AND e.poly_id <> v.poly_id AND v.y > e.yl AND v.y <= e.yh AND (e.xh - e.xl) * (v.y - e.yl) >= (v.x - e.xl) * (e.yh - e.yl)
        WHERE v.hole_id = -1 GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) SELECT CAST(hole_id AS INTEGER) AS hole_id, CAST(poly_id AS INTEGER) AS poly_id, true AS "any", count(*) = max(n) AS whole FROM in_ JOIN polys USING (poly_id) GROUP BY 1, 2""",
    )

    def globe(s: SparkSession, d: str) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        box = geo.globe_box(F.array(x, -x, x + 1), F.array(y, F.least(y + 10_000_000, F.lit(900_000_000))), y > 850_000_000, y < -850_000_000)
        return scaled(s, d).select("k", box.alias("b")).select("k", "b.*")

    every = "abs(2 * x) + (CASE WHEN x > 0 THEN 1 ELSE 0 END) > 1800000000 OR abs(y) > 850000000"
    q["globe_boxes"] = (
        globe,
        f"""WITH {_pts()} SELECT k, CASE WHEN {every} THEN -1800000000 ELSE least(x, -x) END AS xmin, CASE WHEN {every} THEN 1800000000 ELSE greatest(x + 1, -x) END AS xmax,
        CASE WHEN y < -850000000 THEN -900000000 ELSE y END AS ymin, CASE WHEN y > 850000000 THEN 900000000 ELSE least(y + 10000000, 900000000) END AS ymax, abs(2 * x) + (CASE WHEN x > 0 THEN 1 ELSE 0 END) > 1800000000 AS wraps FROM pts""",
    )
    cells = lambda s, d: scaled(s, d).select(geo.cell_of(F.col("x"), F.col("y"), CELL).alias("cell_id")).distinct()
    q["cell_children"] = (
        lambda s, d: cells(s, d).select("cell_id", F.explode(geo.cell_children(F.col("cell_id"), CELL, 4)).alias("child")),
        f"WITH {_pts()}, c AS (SELECT DISTINCT {_CELL_OF} AS cell_id FROM pts) SELECT cell_id, ((cell_id // 100000) * 4 + i) * 100000 + (cell_id % 100000) * 4 + j AS child FROM c, range(4) a(i), range(4) b(j)",
    )
    q["cell_boxes"] = (
        lambda s, d: cells(s, d).select("cell_id", geo.cell_box(F.col("cell_id"), CELL).alias("b")).select("cell_id", "b.*"),
        f"WITH {_pts()}, c AS (SELECT DISTINCT {_CELL_OF} AS cell_id FROM pts) SELECT cell_id, (cell_id // 100000) * {CELL} - 1800000000 AS xmin, (cell_id // 100000 + 1) * {CELL} - 1800000000 AS xmax, (cell_id % 100000) * {CELL} - 900000000 AS ymin, (cell_id % 100000 + 1) * {CELL} - 900000000 AS ymax FROM c",
    )
    pct = lambda n: f"round(100.0::DOUBLE * {n} / total, 2) AS {n}_pct"
    q["candidates_shares"] = (
        lambda s, d: stats.with_shares(stats.frequencies(index_of(s).cells, F.coalesce(F.size("candidates"), F.lit(0)))).select("value", "pct", "upto_pct", "rest_pct"),
        f"{_full()}, f AS (SELECT n_cand AS value, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total, CAST(sum(count(*)) OVER (ORDER BY n_cand) AS BIGINT) AS upto FROM cells GROUP BY 1), g AS (SELECT *, total - upto AS rest FROM f) SELECT CAST(value AS INTEGER) AS value, round(100.0::DOUBLE * n / total, 2) AS pct, {pct('upto')}, {pct('rest')} FROM g",
    )
    q["size_shares"] = (
        lambda s, d: stats.size_shares(index_of(s).polygons.join(index_of(s).zones, "zone_id").groupBy(F.col("tz_name").alias("name")).agg(F.sum(F.col("n_vertices") * 8).alias("bytes"))),
        f"WITH {_world()}, f AS (SELECT tz_name AS name, CAST(sum(n * 8) AS BIGINT) AS bytes FROM polys JOIN zones USING (zone_id) GROUP BY 1) SELECT name, bytes, round(100.0::DOUBLE * bytes / sum(bytes) OVER (), 2) AS pct FROM f",
    )
    one = "SELECT {cell}::BIGINT AS cell, count(*) AS cells, count(unique_zone_id) AS unique_cells, count(*) - count(unique_zone_id) AS ambiguous_cells, CAST(sum(n_cand) AS BIGINT) AS candidates, CAST(max(n_cand) AS INTEGER) AS max_candidates, CAST(sum(CASE WHEN unique_zone_id IS NULL THEN 8 + 2 * n_cand ELSE 9 END) AS BIGINT) AS est_bytes FROM cells"
    sizes = [CELL, 2 * CELL]
    q["stats_by_resolution"] = (lambda s, d: stats.stats_by_resolution(_rings(s), sizes), " UNION ALL ".join(f"SELECT * FROM (WITH {_world()}, {_cells(c)} {one.format(cell=c)})" for c in sizes))
    digits = lambda v: f"CASE WHEN {v} >= 100 THEN printf('%.0f', {v}) WHEN {v} >= 10 THEN printf('%.1f', {v}) ELSE printf('%.2f', {v}) END"
    r, n = "((c_custkey + 1) * (c_custkey + 1) * 1.2345678912::DOUBLE)", "((c_custkey + 1) * 7654321.123456::DOUBLE)"
    key = lambda: F.col("c_custkey") + 1
    q["formats"] = (
        lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", stats.format_rate(key() * key() * 1.2345678912).alias("rate"), stats.format_bytes(key() * 7654321.123456).alias("bytes"), stats.format_ratio(key() / 7.123456789).alias("ratio")),
        f"""SELECT c_custkey, CASE WHEN {r} >= 1e6 THEN {digits(f'({r} / 1e6)')} || 'M/s' WHEN {r} >= 1e3 THEN {digits(f'({r} / 1e3)')} || 'k/s' ELSE {digits(r)} || '/s' END AS rate,
        CASE WHEN {n} >= 1073741824 THEN {digits(f'({n} / 1073741824)')} || ' GiB' WHEN {n} >= 1048576 THEN {digits(f'({n} / 1048576)')} || ' MiB' ELSE {digits(f'({n} / 1024)')} || ' KiB' END AS bytes, {digits('((c_custkey + 1) / 7.123456789::DOUBLE)')} || 'x' AS ratio FROM customer""",
    )
    name = "concat('test_', lower(c_mktsegment), CASE WHEN c_custkey % 2 = 0 THEN concat('[n_', c_nationkey % 5, '-in_memory]') ELSE '' END)"
    q["benchmark_names"] = (
        lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(stats.benchmark_parts(F.expr(name)).alias("b")).groupBy(F.col("b.function").alias("function"), F.array_join("b.params", ", ").alias("params")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT lower(c_mktsegment) AS function, CASE WHEN c_custkey % 2 = 0 THEN 'n ' || (c_nationkey % 5) || ', in memory' ELSE '' END AS params, count(*) AS n FROM customer GROUP BY 1, 2",
    )
    tag = "concat(2000 + c_custkey % 30, chr(97 + c_custkey % 26))"
    q["release_order"] = (
        lambda s, d: quality.unordered_releases(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.expr(tag).alias("tag")), "c_custkey"),
        "WITH t AS (SELECT c_custkey, (2000 + c_custkey % 30) || chr(CAST(97 + c_custkey % 26 AS INTEGER)) AS tag FROM customer) SELECT c_custkey, tag FROM (SELECT *, lag(tag) OVER (ORDER BY c_custkey) AS before FROM t) WHERE tag <= before",
    )

    def registry(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s)
        write_registry(index_of(s).holes, path)
        return read_registry(s, path)

    q["hole_registry_json"] = (registry, f"WITH {_world()} SELECT CAST(poly_id AS INTEGER) AS poly_id, count(*) AS n, CAST(min(hole_id) AS INTEGER) AS first FROM holes GROUP BY 1")

    def from_file(s: SparkSession, d: str) -> DataFrame:
        path = shared_path(s)
        s.createDataFrame([(world.geojson(world.tiled()),)], "value string").coalesce(1).write.text(path)
        return read_geojson(s, path).groupBy("tz_name").agg(F.count(F.lit(1)).alias("rings"), F.sum(F.size("xs")).cast("long").alias("vertices"))

    q["geojson_file"] = (from_file, f"WITH {_world()} SELECT tz_name, count(DISTINCT (v.poly_id, v.hole_id)) AS rings, count(*) AS vertices FROM verts v JOIN polys USING (poly_id) JOIN zones USING (zone_id) GROUP BY 1")


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of points and polygons whose box holds the point, met by grid cell."""
    index = index_of(spark)
    boxes = covered_cells(index.polygons.select("poly_id", "xmin", "xmax", "ymin", "ymax"), CELL)
    pts = scaled(spark, sf_dir).withColumn("cell_id", geo.cell_of(F.col("x"), F.col("y"), CELL))
    return pts.join(boxes, "cell_id").where("x between xmin and xmax and y between ymin and ymax").select("k", "x", "y", "poly_id")


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    with_bad(points(spark, sf_dir, "supplier", "s_suppkey")).select(F.col("k").alias("name"), F.col("lat"), F.col("lng")).write.option("header", True).csv(path)
    found = csvio.annotate_csv(spark, path, index_of(spark), header=True)
    return found.select(F.col("fields")[0].cast("long").alias("k"), "tz_name", "error")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as a stream into a table of the shared folder."""
    path = shared_path(spark)
    table = spark.read.parquet(f"{sf_dir}/customer.parquet")
    source = spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/customer.parquet*")
    lng, lat = geo.derived_point(F.col("c_custkey"))
    named = lookup_stream(source.select(F.col("c_custkey").alias("k"), lng.alias("lng"), lat.alias("lat")), index_of(spark)).select("k", "tz_name")
    named.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k long, tz_name string").parquet(f"{path}/out")


_WAYS = _ways()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: way for name, (way, _) in _WAYS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _WAYS.items() if sql}
