"""Lookups: every row of a DataFrame with lng and lat gets its zone.

Modes: ``full`` (the first candidate that holds the point, the last one untested),
``certain`` (every candidate tested, null if none holds the point), ``land`` (full,
null on oceans), ``unique`` (only where a cell has one zone), ``light`` (the cell's
last candidate, no geometry).

Strategies: ``relational`` joins banded edges and counts crossings, on the distinct
points of ambiguous cells (rows of other cells are never shuffled); ``arrow`` tests
points in batches against a broadcast index of flat arrays, without any
shuffle, and serves streams.  Only an index below ``BROADCAST_BYTES`` is broadcast;
``auto`` takes ``arrow`` for such an index and ``relational`` for a larger one.

No row is ever dropped; invalid coordinates get an error, a null, or raise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cell_of, coordinate_error, scaled
from .index import ZoneIndex
from .pip import Rings, contained, spread

MODES = ("full", "certain", "land", "unique", "light")
BROADCAST_BYTES = 512 << 20


def with_points(df: DataFrame, lng: str, lat: str, on_invalid: str) -> DataFrame:
    """``df`` with x, y (null if invalid) and error; columns of these names are replaced."""
    if on_invalid not in ("flag", "null", "raise"):
        raise ValueError(f"on_invalid: {on_invalid!r}")
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)") if dict(df.dtypes)[c] == "string" else F.col(c)
    a, b = number(lng).cast("double"), number(lat).cast("double")
    error = coordinate_error(a, b)
    if on_invalid == "raise":
        error = F.when(error.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(error).cast("string"))
    valid = coordinate_error(a, b).isNull()
    df = df.withColumns({"__x": F.when(valid, scaled(a)), "__y": F.when(valid, scaled(b)), "__error": F.lit(None).cast("string") if on_invalid == "null" else error})
    return df.drop("x", "y", "error").withColumnsRenamed({"__x": "x", "__y": "y", "__error": "error"})


#: Rows without a cell or a hit take keys of their own, so that a join doesn't deal them all to one task.
_SPREAD = 1 << 10


def keyed(rows: DataFrame, key: Column) -> Column:
    """A join key that is never null: rows without one are spread by their own values."""
    plain = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array", "struct"))]
    return F.coalesce(key, -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(_SPREAD)))


def at_cells(rows: DataFrame, index: ZoneIndex) -> DataFrame:
    """``rows`` (x, y) with the entry of their cell."""
    cells = index.cells.withColumnsRenamed({c: f"__{c}" for c in ("cell_id", "unique_zone_id", "last_zone_id", "candidates")})
    return rows.withColumn("__key", keyed(rows, F.when(F.col("x").isNotNull(), cell_of(F.col("x"), F.col("y"), index.cell)))).join(cells, F.col("__key") == F.col("__cell_id"), "left")


def tested_zones(at: DataFrame, index: ZoneIndex, mode: str) -> DataFrame:
    """(x, y, zone) of the distinct points of rows at their cells: the first candidate that holds them."""
    points = at.select("x", "y", F.col("__unique_zone_id").alias("unique_zone_id"), F.col("__candidates").alias("candidates")).where("x is not null").distinct()
    tested = points.where("candidates is not null").select("x", "y", F.inline("candidates"))
    if mode == "certain":
        whole = points.where("unique_zone_id is not null").select("x", "y", F.col("unique_zone_id").alias("zone_id"))
        whole = whole.join(index.polygons.select("zone_id", "poly_id"), "zone_id").select("x", "y", F.col("poly_id").alias("pos"), "poly_id", "zone_id")
        tested = tested.select("x", "y", "pos", "poly_id", "zone_id").unionByName(whole)
    else:
        tested = tested.where("tested")
    box = index.polygons.select("poly_id", "xmin", "xmax", "ymin", "ymax")
    near = tested.join(box, "poly_id").where("x between xmin and xmax and y between ymin and ymax").select("x", "y", "pos", "poly_id", "zone_id")
    return near.join(contained(near, index.bands), ["x", "y", "poly_id"]).groupBy(F.col("x").alias("__x"), F.col("y").alias("__y")).agg(F.min_by("zone_id", "pos").alias("__zone"))


def _relational(rows: DataFrame, index: ZoneIndex, mode: str) -> DataFrame:
    names, at = rows.columns, at_cells(rows, index)
    known, last = F.col("__unique_zone_id"), F.col("__last_zone_id")
    answer = lambda df, zone: df.select(*names, zone.cast("int").alias("tz_id"))
    if mode == "unique":
        return answer(at, known)
    if mode == "light":
        return answer(at, F.coalesce(known, last))
    open_ = F.col("__candidates").isNotNull() if mode == "full" else F.coalesce(known, last).isNotNull()
    hit = tested_zones(at.where(open_), index, mode)
    tried = at.where(open_).join(hit, (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")), "left")
    found = F.col("__zone") if mode == "certain" else F.coalesce("__zone", "__last_zone_id")
    settled = known if mode == "full" else F.lit(None)
    return answer(tried, found).unionByName(answer(at.where(~open_), settled))


def lookup(df: DataFrame, index: ZoneIndex, mode: str = "full", strategy: str = "auto", lng: str = "lng", lat: str = "lat", on_invalid: str = "flag") -> DataFrame:
    """``df`` with x, y, tz_id, tz_name and error."""
    if mode not in MODES or strategy not in ("auto", "relational", "arrow"):
        raise ValueError(f"mode {mode!r}, strategy {strategy!r}")
    rows = with_points(df, lng, lat, on_invalid).drop("tz_id", "tz_name")
    how = "full" if mode == "land" else mode
    found = _arrow(rows, index, how) if strategy == "arrow" or strategy == "auto" and fits(index) else _relational(rows, index, how)
    zones = index.zones.select(F.col("zone_id").alias("__id"), F.col("tz_name"), F.col("is_ocean").alias("__ocean"))
    named = found.withColumn("__key", keyed(found, F.col("tz_id").cast("bigint"))).join(zones, F.col("__key") == F.col("__id"), "left")
    if mode == "land":
        named = named.withColumns({"tz_name": F.when(~F.col("__ocean"), F.col("tz_name")), "tz_id": F.when(~F.col("__ocean"), F.col("tz_id"))})
    return named.select(*[c for c in rows.columns if c != "error"], "tz_id", "tz_name", "error")


def flat_bytes(index: ZoneIndex) -> int:
    """Bytes of an index as flat arrays at most: 128 an edge (in up to three bands), 20 a candidate, 40 a cell."""
    n = F.coalesce(F.size("candidates"), F.lit(0))
    return index.edges.count() * 128 + (index.cells.agg(F.sum(40 + n * 20)).first()[0] or 0)


def fits(index: ZoneIndex) -> bool:
    """Whether an index may be broadcast."""
    return index.sent is not None or flat_bytes(index) <= BROADCAST_BYTES


class BroadcastIndex:
    """Cells, polygons and rings as flat arrays on every executor."""

    def __init__(self, index: ZoneIndex):
        listed = index.cells.select("cell_id", "unique_zone_id", "last_zone_id", F.coalesce(F.size("candidates"), F.lit(0)).alias("n"))
        if (size := flat_bytes(index)) > BROADCAST_BYTES:
            raise ValueError(f"an index of {size} bytes is too large to broadcast; use the relational strategy")
        self.cell = index.cell
        cells = listed.orderBy("cell_id").toArrow()
        column = lambda t, c: np.asarray(t[c].fill_null(-1)).astype(np.int64)
        self.cell_id, self.unique, self.last, count = (column(cells, c) for c in ("cell_id", "unique_zone_id", "last_zone_id", "n"))
        self.first, self.count = np.cumsum(count) - count, count
        each = index.cells.where("candidates is not null").select("cell_id", F.inline("candidates")).orderBy("cell_id", "pos").toArrow()
        self.poly, self.zone, self.tested = (np.asarray(each[c]) for c in ("poly_id", "zone_id", "tested"))
        polys = index.polygons.select("poly_id", "zone_id", "xmin", "xmax", "ymin", "ymax").orderBy("poly_id").toArrow()
        ids = column(polys, "poly_id")
        n = int(ids.max(initial=-1)) + 1
        self.box = np.zeros((4, n), dtype=np.int64)
        for k, c in enumerate(("xmin", "xmax", "ymin", "ymax")):
            self.box[k, ids] = column(polys, c)
        of = column(polys, "zone_id")
        order = np.argsort(of, kind="stable")
        self.zone_polys, zones = ids[order], int(of.max(initial=-1)) + 1
        self.zone_first = np.searchsorted(of[order], np.arange(zones + 1))
        edges = index.edges.select("poly_id", "hole_id", "x_low", "y_low", "x_high", "y_high").toArrow()
        poly, hole = column(edges, "poly_id"), np.asarray(edges["hole_id"]).astype(np.int64)
        # A polygon's rings stand together, the boundary first.
        pairs, ring = np.unique(np.stack([poly, hole], 1), axis=0, return_inverse=True)
        self.ring_first = np.searchsorted(pairs[:, 0], np.arange(n + 1))
        self.boundary = pairs[:, 1] == -1
        self.rings = Rings(ring.reshape(-1), [np.asarray(edges[c]) for c in ("x_low", "y_low", "x_high", "y_high")], len(pairs))

    def holds(self, poly: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether each polygon holds its point: its boundary does and no hole."""
        out = np.zeros(len(x), dtype=bool)
        xmin, xmax, ymin, ymax = self.box[:, poly]
        near = np.flatnonzero((x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax))
        first = self.ring_first[poly[near]]
        owner, ring = spread(first, self.ring_first[poly[near] + 1] - first)
        odd = self.rings.odd(x[near][owner], y[near][owner], ring)
        inside = np.bincount(owner[odd & self.boundary[ring]], minlength=len(near)) > 0
        out[near] = inside & (np.bincount(owner[odd & ~self.boundary[ring]], minlength=len(near)) == 0)
        return out

    def first_hit(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, count: np.ndarray, poly: np.ndarray, zone: np.ndarray, use: np.ndarray | None) -> np.ndarray:
        """The zone of the first listed polygon that holds each point, -1 for none; one round for each place in the lists."""
        out = np.full(len(x), -1, dtype=np.int64)
        left, step = np.flatnonzero(count > 0), 0
        while len(left):
            at = first[left] + step
            try_ = np.flatnonzero(use[at]) if use is not None else np.arange(len(left))
            own = left[try_]
            hit = self.holds(poly[at[try_]], x[own], y[own])
            out[own[hit]] = zone[at[try_[hit]]]
            step += 1
            left = left[(out[left] < 0) & (count[left] > step)]
        return out

    def locate(self, x: np.ndarray, y: np.ndarray, mode: str) -> np.ndarray:
        """Zone ids of points, -1 for none."""
        if not len(self.cell_id):
            return np.full(len(x), -1, dtype=np.int64)
        n_col, n_row = 3_600_000_000 // self.cell, 1_800_000_000 // self.cell
        cell = np.minimum((x + 1_800_000_000) // self.cell, n_col - 1) * 100_000 + np.minimum((y + 900_000_000) // self.cell, n_row - 1)
        at = np.minimum(np.searchsorted(self.cell_id, cell), len(self.cell_id) - 1)
        known = self.cell_id[at] == cell
        unique, last = np.where(known, self.unique[at], -1), np.where(known, self.last[at], -1)
        if mode == "unique":
            return unique
        if mode == "light":
            return np.where(unique >= 0, unique, last)
        out = unique if mode == "full" else np.full(len(x), -1, dtype=np.int64)
        open_ = np.flatnonzero(known & (unique < 0))
        hit = self.first_hit(x[open_], y[open_], self.first[at[open_]], self.count[at[open_]], self.poly, self.zone, self.tested if mode == "full" else None)
        out[open_] = np.where(hit >= 0, hit, last[open_]) if mode == "full" else hit
        if mode == "certain":
            alone = np.flatnonzero(unique >= 0)
            z = unique[alone]
            zones = np.repeat(np.arange(len(self.zone_first) - 1), np.diff(self.zone_first))
            out[alone] = self.first_hit(x[alone], y[alone], self.zone_first[z], self.zone_first[z + 1] - self.zone_first[z], self.zone_polys, zones, None)
        return out


def _arrow(rows: DataFrame, index: ZoneIndex, mode: str) -> DataFrame:
    if index.sent is None:
        index.sent = rows.sparkSession.sparkContext.broadcast(BroadcastIndex(index))
    sent = index.sent

    @F.pandas_udf("int")
    def zone(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = np.full(len(x), -1, dtype=np.int64)
        if known.any():
            out[known] = sent.value.locate(x[known].to_numpy(np.int64), y[known].to_numpy(np.int64), mode)
        return pd.Series(out).where(out >= 0).astype("Int32")

    return rows.withColumn("tz_id", zone("x", "y"))


def geometry(index: ZoneIndex, zone: str | int, pairs: bool = True) -> DataFrame:
    """poly_id and rings (boundary first, then holes in order) of a zone, in degrees."""
    if isinstance(zone, int) and zone < 0:
        raise ValueError("zone ids start at 0")
    named = index.zones.where(F.col("zone_id") == zone if isinstance(zone, int) else F.col("tz_name") == zone)
    if named.isEmpty():
        raise ValueError(f"no zone {zone!r}")
    polys = index.polygons.join(named.select("zone_id"), "zone_id", "left_semi").select("poly_id", F.lit(-1).alias("hole_id"), "xs", "ys")
    twin = index.polygons.select(F.col("poly_id").alias("t_id"), F.col("xs").alias("t_xs"), F.col("ys").alias("t_ys"))
    holes = index.holes.join(polys.select("poly_id"), "poly_id", "left_semi").join(twin, F.col("ref_poly_id") == F.col("t_id"), "left")
    holes = holes.select("poly_id", "hole_id", F.coalesce("xs", "t_xs").alias("xs"), F.coalesce("ys", "t_ys").alias("ys"))
    degrees = lambda c: F.transform(c, lambda v: v.cast("double") * F.lit(1e-7))
    ring = F.zip_with(degrees("xs"), degrees("ys"), lambda a, b: F.struct(a.alias("lng"), b.alias("lat"))) if pairs else F.struct(degrees("xs").alias("lngs"), degrees("ys").alias("lats"))
    listed = polys.unionByName(holes).select("poly_id", "hole_id", ring.alias("ring"))
    return listed.groupBy("poly_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hole_id", "ring"))), lambda r: r["ring"]).alias("rings"))


class Finder:
    """A table-valued lookup with a fixed index."""

    def __init__(self, index: ZoneIndex, strategy: str = "auto"):
        self.index, self.strategy = index, strategy

    def timezone_at(self, df: DataFrame, **how) -> DataFrame:
        return lookup(df, self.index, "full", self.strategy, **how)

    def timezone_at_land(self, df: DataFrame, **how) -> DataFrame:
        return lookup(df, self.index, "land", self.strategy, **how)

    def certain_timezone_at(self, df: DataFrame, **how) -> DataFrame:
        return lookup(df, self.index, "certain", self.strategy, **how)

    def unique_timezone_at(self, df: DataFrame, **how) -> DataFrame:
        return lookup(df, self.index, "unique", self.strategy, **how)

    def light_timezone_at(self, df: DataFrame, **how) -> DataFrame:
        return lookup(df, self.index, "light", self.strategy, **how)

    def get_geometry(self, zone: str | int, pairs: bool = True) -> DataFrame:
        return geometry(self.index, zone, pairs)

