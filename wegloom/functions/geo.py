"""Planar and spherical geometry as column expressions, and zone intervals on segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wegloom.functions import constants as C

#: Powers of the third flattening, from the first on, in the series of the transverse Mercator projection after Krueger
#: (fourth order): to the plane, back to the conformal sphere, and from the conformal to the geographic latitude.
_N = C.UTM_F / (2 - C.UTM_F)
_TO_PLANE = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
_TO_SPHERE = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
_TO_LATITUDE = ((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))
_ECC = math.sqrt(C.UTM_F * (2 - C.UTM_F))
_SCALE = C.UTM_K * C.UTM_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FALSE_EAST, FALSE_NORTH = 500_000.0, 10_000_000.0


def _terms(table: tuple[tuple[float, ...], ...]) -> list[float]:
    """The series' factors for the ellipsoid."""
    return [sum(c * _N ** (i + 1) for i, c in enumerate(row)) for row in table]


def _series(factors: list[float], a: Column, b: Column | None = None) -> tuple[Column, Column]:
    """Sums of sin(2ja) cosh(2jb) and of cos(2ja) sinh(2jb) with the factors; b is 0 where there is none."""
    real, imaginary = F.lit(0.0), F.lit(0.0)
    for j, f in enumerate(factors, 1):
        if b is None:
            real = real + f * F.sin(2 * j * a)
        else:
            real = real + f * F.sin(2 * j * a) * F.cosh(2 * j * b)
            imaginary = imaginary + f * F.cos(2 * j * a) * F.sinh(2 * j * b)
    return real, imaginary


def in_zone(lon: Column, lat: Column) -> Column:
    return lon.between(108, 114) & lat.between(-80, 0)


def utm_forward(lon: Column, lat: Column, strict: bool = False) -> Column:
    """Struct x, y in metres (zone 49 south); null, or an error if strict, outside 108-114 E and 80-0 S."""
    turn = F.radians(lon - C.UTM_LON0)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))  # tangent of the conformal latitude
    north, east = F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.cos(turn) * F.cos(turn)))
    more_north, more_east = _series(_terms(_TO_PLANE), north, east)
    out = F.struct((FALSE_EAST + _SCALE * (east + more_east)).alias("x"), (FALSE_NORTH + _SCALE * (north + more_north)).alias("y"))
    bad = F.raise_error(F.lit("coordinate outside 108-114 E, 80-0 S")).cast("struct<x:double,y:double>") if strict else F.lit(None)
    return F.when(in_zone(lon, lat), out).otherwise(bad)


def utm_inverse(x: Column, y: Column) -> Column:
    """Struct lon, lat in degrees; null if that is outside the zone."""
    north, east = (y - FALSE_NORTH) / _SCALE, (x - FALSE_EAST) / _SCALE
    less_north, less_east = _series(_terms(_TO_SPHERE), north, east)
    north, east = north - less_north, east - less_east
    conformal = F.asin(F.sin(north) / F.cosh(east))
    lat = F.degrees(conformal + _series(_terms(_TO_LATITUDE), conformal)[0])
    lon = F.degrees(F.atan2(F.sinh(east), F.cos(north))) + C.UTM_LON0
    return F.when(in_zone(lon, lat), F.struct(lon.alias("lon"), lat.alias("lat")))


def transformer(source: int | str, target: int | str, always_xy: bool = False):
    """A function of two columns from one reference system to the other; only 4326 and 32749."""
    if not always_xy:
        raise ValueError("only always_xy=True is supported")
    pair = tuple(int(str(v).upper().removeprefix("EPSG:")) for v in (source, target))
    if pair == (4326, 32749):
        return utm_forward
    if pair == (32749, 4326):
        return utm_inverse
    raise ValueError("only EPSG:4326 and EPSG:32749 are supported")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a, b = F.sin((p2 - p1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return C.EARTH_M * 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + F.cos(p1) * F.cos(p2) * b * b)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def project_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Struct gap, f, x, y: the nearest point of a segment; f is 0 for one without length."""
    dx, dy = bx - ax, by - ay
    d = dx * dx + dy * dy
    f = F.when(d == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(d, F.lit(0.0)))))
    x, y = ax + f * dx, ay + f * dy
    return F.struct(distance(px, py, x, y).alias("gap"), f.alias("f"), x.alias("x"), y.alias("y"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def cells(minx: Column, maxx: Column, miny: Column, maxy: Column, size: float) -> Column:
    """Array of the grid cells (cx, cy) that a box touches."""
    xs, ys = F.sequence(cell(minx, size), cell(maxx, size)), F.sequence(cell(miny, size), cell(maxy, size))
    return F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: F.struct(a.alias("cx"), b.alias("cy")))))


def line_cells(ax: Column, ay: Column, bx: Column, by: Column, reach: float | Column, size: float) -> Column:
    """Array of the grid cells (cx, cy) within `reach` of a segment, a column of cells at a time.

    In each column of cells, widened by the reach, the segment spans a range of y; that range, widened as well, gives
    the column's cells. So a long slanted segment has as many cells as it passes, not as its box has.
    """
    r = reach if isinstance(reach, Column) else F.lit(float(reach))
    (x0, y0, x1, y1) = (F.when(ax <= bx, ax).otherwise(bx), F.when(ax <= bx, ay).otherwise(by), F.when(ax <= bx, bx).otherwise(ax), F.when(ax <= bx, by).otherwise(ay))
    slope = (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0))

    def column(cx: Column) -> Column:
        at = lambda x: F.coalesce(y0 + (F.least(x1, F.greatest(x0, x)) - x0) * slope, y0)
        p, q = at(cx * size - r), at((cx + 1) * size + r)
        upright = slope.isNull()
        low, high = F.when(upright, F.least(y0, y1)).otherwise(F.least(p, q)), F.when(upright, F.greatest(y0, y1)).otherwise(F.greatest(p, q))
        return F.transform(F.sequence(cell(low - r, size), cell(high + r, size)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(F.sequence(cell(x0 - r, size), cell(x1 + r, size)), column))


def disc_interval(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, r: Column) -> Column:
    """Struct lo, hi: the part, from 0 to 1, of a segment inside a disc; null if there is none."""
    dx, dy, fx, fy = bx - ax, by - ay, ax - cx, ay - cy
    a, b, c = dx * dx + dy * dy, fx * dx + fy * dy, fx * fx + fy * fy - r * r
    root = F.sqrt(F.greatest(F.lit(0.0), b * b - a * c))
    lo, hi = F.greatest(F.lit(0.0), (-b - root) / F.nullif(a, F.lit(0.0))), F.least(F.lit(1.0), (-b + root) / F.nullif(a, F.lit(0.0)))
    return F.when((b * b - a * c > 0) & (hi > lo), F.struct(lo.alias("lo"), hi.alias("hi")))


def union_length(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, covered: the length of the union of (lo, hi) intervals per key."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("hi").over(w), F.col("lo"))
    new = F.greatest(F.lit(0.0), F.col("hi") - F.greatest(F.col("lo"), before))
    return intervals.withColumn("_new", new).groupBy(*keys).agg(F.sum("_new").alias("covered"))


def ring_contains(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring (array of struct x, y), by crossings; the border may go either way."""
    n = F.size(ring)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))

    def crosses(e: Column) -> Column:
        ay, by = e["a"]["y"], e["b"]["y"]
        return ((ay > py) != (by > py)) & (px < (e["b"]["x"] - e["a"]["x"]) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + e["a"]["x"])

    return F.when(n < 4, False).otherwise(F.size(F.filter(pairs, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1)


def rounded(v: Column, places: int) -> Column:
    return F.bround(v, places)
