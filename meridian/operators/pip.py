"""Point in polygon with holes: edge parity as an aggregate, or vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import band_of, crosses

#: Height of a latitude band: edges are joined only to points of their bands.
BAND = 10_000_000
#: Pairs of points and edges tested at a time.
PAIRS = 1_000_000


def banded(edges: DataFrame, band: int = BAND) -> DataFrame:
    """Edges once for each band they reach (poly_id, band) is an equi-join key for points."""
    return edges.withColumn("band", F.explode(F.sequence(band_of(F.col("y_low"), band), band_of(F.col("y_high"), band))))


def rings_around(pairs: DataFrame, bands: DataFrame, band: int = BAND) -> DataFrame:
    """(x, y, poly_id, hole_id) of every ring of the pairs (x, y, poly_id) that holds the point; -1 is the boundary."""
    at = pairs.select("x", "y", "poly_id").withColumn("band", band_of(F.col("y"), band))
    hits = at.join(bands, ["poly_id", "band"]).where(crosses(F.col("x"), F.col("y")))
    return hits.groupBy("x", "y", "poly_id", "hole_id").agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1").drop("odd")


def contained(pairs: DataFrame, bands: DataFrame, band: int = BAND) -> DataFrame:
    """Of the pairs (x, y, poly_id), those whose polygon holds the point and none of its holes does."""
    return rings_around(pairs, bands, band).groupBy("x", "y", "poly_id").agg(F.max("hole_id").alias("h")).where("h = -1").select("x", "y", "poly_id")


def in_any_hole(pairs: DataFrame, bands: DataFrame, band: int = BAND) -> DataFrame:
    """Of the pairs (x, y, poly_id), those where one of the polygon's holes holds the point."""
    return rings_around(pairs, bands.where("hole_id <> -1"), band).select("x", "y", "poly_id").distinct()


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of given starts and lengths: the number of the range, and each place in it."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Rings:
    """Rings as flat arrays of edges, each ring in latitude bands of its own; a point is tested by the edges of its band only.

    A ring of n edges that a level line crosses c times on average is cut into n / c
    bands: edges then stand in two or three of them, and a band holds about as many as a test must look at anyway.
    """

    def __init__(self, ring: np.ndarray, edges: list[np.ndarray], n: int):
        """``edges`` are x_low, y_low, x_high, y_high of each edge, ``ring`` its ring; level edges are left out."""
        x_low, y_low, x_high, y_high = (e.astype(np.int64) for e in edges)
        size = np.bincount(ring, minlength=n)
        self.bottom, self.top = np.full(n, 1 << 62), np.full(n, -(1 << 62))
        np.minimum.at(self.bottom, ring, y_low)
        np.maximum.at(self.top, ring, y_high)
        tall = np.where(size > 0, self.top - self.bottom, 0)
        climbed = np.bincount(ring, weights=y_high - y_low, minlength=n)
        wanted = np.maximum(1, size * tall / np.maximum(climbed, 1)).astype(np.int64)
        self.height = np.maximum(1, tall // wanted + 1)
        levels = tall // self.height + 1
        #: Where each ring's table of band starts begins.
        self.table = np.cumsum(levels) - levels
        low, high = ((y - self.bottom[ring]) // self.height[ring] for y in (y_low, y_high))
        entry, level = spread(low, high - low + 1)
        place = self.table[ring[entry]] + level
        entry = entry[np.argsort(place, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=int(levels.sum())))])
        self.x_low, self.y_low, self.x_high, self.y_high = x_low[entry], y_low[entry], x_high[entry], y_high[entry]

    def odd(self, x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> np.ndarray:
        """Whether each ring holds its point."""
        out = np.zeros(len(x), dtype=bool)
        near = np.flatnonzero((y > self.bottom[ring]) & (y <= self.top[ring]))
        own = ring[near]
        at = self.table[own] + (y[near] - self.bottom[own]) // self.height[own]
        first = self.starts[at]
        count = self.starts[at + 1] - first
        upto = np.cumsum(count)
        lo = 0
        while lo < len(near):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            owner, e = spread(first[lo:hi], count[lo:hi])
            own = near[lo:hi]
            px, py = x[own][owner], y[own][owner]
            y_low, y_high = self.y_low[e], self.y_high[e]
            hit = np.flatnonzero((py > y_low) & (py <= y_high))
            e, px, py, y_low, y_high = e[hit], px[hit], py[hit], y_low[hit], y_high[hit]
            x_low = self.x_low[e]
            over = (self.x_high[e] - x_low) * (py - y_low) >= (px - x_low) * (y_high - y_low)
            out[own] = np.bincount(owner[hit[over]], minlength=hi - lo) % 2 == 1
            lo = hi
        return out


def crossed(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Parity of the crossings of each point with the edges (x_low, y_low, x_high, y_high) of one ring."""
    if not len(edges):
        return np.zeros(len(x), dtype=bool)
    return Rings(np.zeros(len(edges), np.int64), list(edges.T), 1).odd(x, y, np.zeros(len(x), np.int64))
