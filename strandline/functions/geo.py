"""Planar geometry as pure Columns: a point is struct<x,y>, a multipoint an array of points.

Axis order is x, y (longitude, latitude) throughout.
"""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the GRS80 ellipsoid and of zone 32 of the universal transverse Mercator grid (EPSG:25832).
AXIS, FLATTENING, SCALE, FALSE_EAST, MERIDIAN = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 9.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def collect_points(points: Column, order: Column) -> Column:
    """An aggregate: the group's points as a multipoint, by ``order``."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), points.alias("p")))), lambda s: s["p"])


def dump(points: Column) -> Column:
    """Points with their 1-based place, for ``inline``."""
    return F.transform(points, lambda p, i: F.struct((i + 1).alias("path"), p.alias("geom")))


def translate(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: point(p["x"] + dx, p["y"] + dy))


def rotate(points: Column, radians: Column) -> Column:
    """Counter-clockwise about the origin."""
    sin, cos = F.sin(radians), F.cos(radians)
    return F.transform(points, lambda p: point(p["x"] * cos - p["y"] * sin, p["x"] * sin + p["y"] * cos))


def contains(low_x: float, low_y: float, high_x: float, high_y: float, points: Column) -> Column:
    """Does the box contain the multipoint: no point outside it and one at least in its interior."""
    x, y = (lambda p: p["x"]), (lambda p: p["y"])
    closed = F.forall(points, lambda p: x(p).between(low_x, high_x) & y(p).between(low_y, high_y))
    inner = F.exists(points, lambda p: (x(p) > low_x) & (x(p) < high_x) & (y(p) > low_y) & (y(p) < high_y))
    return closed & inner


def coordinates(points: Column) -> Column:
    """array<array<double>> of x and y."""
    return F.transform(points, lambda p: F.array(p["x"], p["y"]))


def utm(p: Column, meridian: float = MERIDIAN) -> Column:
    """Longitude and latitude in degrees to transverse Mercator metres, by the Krueger series to fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    lat, lon = F.radians(p["y"]), F.radians(p["x"] - meridian)
    t = F.sinh(F.atanh(F.sin(lat)) - e * F.atanh(e * F.sin(lat)))
    xi, eta = F.atan2(t, F.cos(lon)), F.atanh(F.sin(lon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return point(FALSE_EAST + SCALE * radius * east, SCALE * radius * north)


def wkb_encode(points: list[tuple[float, float]] | tuple[float, float]) -> bytes:
    """Little-endian well-known binary of a point (a pair) or multipoint (a list of pairs)."""
    if isinstance(points, tuple):
        return struct.pack("<BIdd", 1, 1, *points)
    return struct.pack("<BII", 1, 4, len(points)) + b"".join(wkb_encode(tuple(p)) for p in points)


def wkb_decode(data: bytes) -> tuple[float, float] | list[tuple[float, float]]:
    order = "<" if data[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", data, 1)
    if kind == 1:
        return struct.unpack_from(order + "dd", data, 5)
    if kind != 4:
        raise ValueError(f"geometry type {kind} isn't a point or multipoint")
    (n,) = struct.unpack_from(order + "I", data, 5)
    return [wkb_decode(data[9 + 21 * i : 30 + 21 * i]) for i in range(n)]


def point_from_wkb(data: Column) -> Column:
    """Little-endian WKB point to struct, by a vectorised Python function: only for the edges of a pipeline."""
    @F.pandas_udf("x double, y double")
    def decode(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if v is None else wkb_decode(bytes(v)) for v in values], columns=["x", "y"])

    return decode(data)


def point_to_wkb(p: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else wkb_encode((a, b)) for a, b in zip(x, y)])

    return encode(p["x"], p["y"])
