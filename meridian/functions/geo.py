"""Coordinates as integers of 1e-7 degrees, cells, bands, and small scalar functions.

All are column functions: they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000_000
X_MAX, Y_MAX = 180 * SCALE, 90 * SCALE
#: The prefix of ocean zones, and of release tags.
OCEAN_PREFIX = "Etc/GMT"
RELEASE_TAG = "^[0-9]{4}[a-z]+$"


def scaled(degrees: Column) -> Column:
    """Degrees to integers, truncated toward zero."""
    return (degrees * F.lit(float(SCALE))).cast("bigint")


def unscaled(value: Column) -> Column:
    """Integers to degrees: a product, since a quotient differs in the last bit."""
    return value.cast("double") * F.lit(1e-7)


def valid_lat(lat: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & lat.between(-90.0, 90.0), F.lit(False))


def valid_lng(lng: Column) -> Column:
    return F.coalesce(~F.isnan(lng) & lng.between(-180.0, 180.0), F.lit(False))


def coordinate_error(lng: Column, lat: Column) -> Column:
    """Why a pair is no coordinate, or null."""
    return F.when(lng.isNull() | lat.isNull(), "missing coordinate").when(~valid_lng(lng), "longitude out of range").when(~valid_lat(lat), "latitude out of range")


def is_ocean(name: Column) -> Column:
    return F.startswith(name, F.lit(OCEAN_PREFIX))


def cell_of(x: Column, y: Column, cell: int) -> Column:
    """Cell of an integer grid; the outermost border belongs to the last row and column."""
    return cell_id(column_of(x, cell), row_of(y, cell))


def cell_id(column: Column, row: Column) -> Column:
    return column * 100_000 + row


def _floor(value: Column, by: int) -> Column:
    return F.floor((value - F.pmod(value, F.lit(by))) / by).cast("bigint")


def column_of(x: Column, cell: int) -> Column:
    return F.least(_floor(x.cast("bigint") + X_MAX, cell), F.lit(2 * X_MAX // cell - 1).cast("bigint"))


def row_of(y: Column, cell: int) -> Column:
    return F.least(_floor(y.cast("bigint") + Y_MAX, cell), F.lit(2 * Y_MAX // cell - 1).cast("bigint"))


def band_of(y: Column, band: int) -> Column:
    return _floor(y.cast("bigint") + Y_MAX, band)


def crosses(x: Column, y: Column, e: str = "") -> Column:
    """Whether a ray from (x, y) to the right crosses an upward edge (x_low, y_low) - (x_high, y_high).

    The lower end is outside, the upper one inside; a point on the edge counts as crossing.
    """
    c = lambda n: F.col(e + n)
    return (y > c("y_low")) & (y <= c("y_high")) & ((c("x_high") - c("x_low")) * (y - c("y_low")) >= (x - c("x_low")) * (c("y_high") - c("y_low")))


def derived_point(key: Column) -> tuple[Column, Column]:
    """(lng, lat) of an integer key, spread over the globe."""
    lng = (F.pmod(key * 1299709, F.lit(3600000)) - 1800000).cast("double") / 10000.0
    lat = (F.pmod(key * 104729, F.lit(1800000)) - 900000).cast("double") / 10000.0
    return lng, lat


def release_of(path: Column) -> Column:
    """The release tag at the end of a file stem, or null."""
    tag = F.regexp_extract(F.regexp_replace(path, r"\.[^.]*$", ""), "([^-/]*)$", 1)
    return F.when(tag.rlike(RELEASE_TAG), tag)


def release_version(tag: Column, generation: int = 1) -> Column:
    """``2026c`` to ``1.2026.3``: letters count in base 26 without a zero."""
    letters = F.split(F.substring(tag, 5, 100), "")
    number = F.aggregate(letters, F.lit(0).cast("bigint"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 96))
    return F.when(tag.rlike(RELEASE_TAG), F.concat_ws(".", F.lit(str(generation)), F.substring(tag, 1, 4), number.cast("string")))


def utc_offset_minutes(utc: Column, zone: Column) -> Column:
    """Minutes east of UTC of a zone at an instant without zone."""
    return F.expr("0") + ((F.unix_timestamp(F.from_utc_timestamp(utc, zone)) - F.unix_timestamp(utc)) / 60).cast("int")


def ring_key(xs: Column, ys: Column) -> Column:
    """A ring's form that doesn't depend on where it starts or which way it runs."""
    pts = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    turned = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.concat(F.slice(p, k, F.size(p)), F.slice(p, F.lit(1), k - 1)))
    return F.to_json(F.array_min(F.concat(turned(pts), turned(F.reverse(pts)))))


def last_change(ids: Column) -> Column:
    """Index of the last place where neighbouring ids differ (0: nowhere)."""
    at = F.when(F.size(ids) > 1, F.sequence(F.lit(1), F.size(ids) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(at, lambda i: F.get(ids, i) != F.get(ids, i - 1))), F.lit(0))


def boxes_overlap(a: str, b: str) -> Column:
    """Whether two boxes share a point; ``a`` and ``b`` are prefixes of xmin, xmax, ymin, ymax."""
    meet = [F.col(f"{a}{axis}min") <= F.col(f"{b}{axis}max") for axis in "xy"] + [F.col(f"{b}{axis}min") <= F.col(f"{a}{axis}max") for axis in "xy"]
    return meet[0] & meet[1] & meet[2] & meet[3]


def globe_box(xs: Column, ys: Column, holds_north: Column, holds_south: Column) -> Column:
    """The box of a small cell from its vertices, right across the antimeridian and at the poles.

    A struct of xmin, xmax, ymin, ymax, wraps.  Vertices more than half the globe apart
    stand on both sides of the antimeridian, where least and greatest are the wrong
    ends: such a cell gets all longitudes, as does one around a pole, which also
    reaches up (down) to it.  Null for a cell as high as a quarter of the globe.
    """
    low, high = F.array_min(ys), F.array_max(ys)
    wraps = F.array_max(xs) - F.array_min(xs) > X_MAX
    every = wraps | holds_north | holds_south
    end = lambda own, all_, where: F.when(where, F.lit(all_).cast("bigint")).otherwise(own.cast("bigint"))
    box = F.struct(
        end(F.array_min(xs), -X_MAX, every).alias("xmin"),
        end(F.array_max(xs), X_MAX, every).alias("xmax"),
        end(low, -Y_MAX, holds_south & ~holds_north).alias("ymin"),
        end(high, Y_MAX, holds_north).alias("ymax"),
        wraps.alias("wraps"),
    )
    return F.when(high - low < Y_MAX, box)


def cell_box(cell: Column, size: int) -> Column:
    """xmin, xmax, ymin, ymax of a grid cell."""
    x = F.floor(cell / 100_000).cast("bigint") * size - X_MAX
    y = F.pmod(cell, F.lit(100_000)) * size - Y_MAX
    return F.struct(x.alias("xmin"), (x + size).alias("xmax"), y.alias("ymin"), (y + size).alias("ymax"))


def cell_children(cell: Column, size: int, by: int) -> Column:
    """The by * by cells of a grid ``by`` times finer that make up a cell."""
    if size % by:
        raise ValueError(f"a cell of {size} can't be cut into {by}")
    x, y = F.floor(cell / 100_000).cast("bigint") * by, F.pmod(cell, F.lit(100_000)) * by
    steps = F.sequence(F.lit(0), F.lit(by - 1))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: cell_id(x + i, y + j))))


def cell_count(size: int) -> int:
    """Cells of the grid over the whole globe."""
    return (2 * X_MAX // size) * (2 * Y_MAX // size)


def random_point(seed: int, by_area: bool = True) -> tuple[Column, Column]:
    """(lng, lat) at random: even over the sphere's area, or over the degrees."""
    lat = F.degrees(F.asin(F.rand(seed + 1) * 2 - 1)) if by_area else F.rand(seed + 1) * 180 - 90
    return F.rand(seed) * 360 - 180, lat
