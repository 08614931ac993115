"""Geodesy as Column functions, with NumPy twins for code that runs in Python workers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84, mean Earth radius, the knot, kilometres for a degree of latitude.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
EARTH_RADIUS_M = 6371008.8
KNOT_MS = 1852.0 / 3600.0
KM_PER_DEGREE = 111.32

Num = Column | float


def _c(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1: Num, lon1: Num, lat2: Num, lon2: Num) -> Column:
    a1, o1, a2, o2 = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    # h is a sum of non-negative terms; least() would skip a null, so a null is kept by hand.
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def ecef(lat: Num, lon: Num) -> tuple[Column, Column, Column]:
    a, o = F.radians(_c(lat)), F.radians(_c(lon))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(a), 2))
    return n * F.cos(a) * F.cos(o), n * F.cos(a) * F.sin(o), n * (1 - WGS84_E2) * F.sin(a)


def enu(lat: Num, lon: Num, lat0: Num, lon0: Num) -> tuple[Column, Column]:
    """(east, north) metres in the tangent plane at (lat0, lon0)."""
    x, y, z = (p - q for p, q in zip(ecef(lat, lon), ecef(lat0, lon0)))
    a, o = F.radians(_c(lat0)), F.radians(_c(lon0))
    east = -F.sin(o) * x + F.cos(o) * y
    return east, -F.sin(a) * F.cos(o) * x - F.sin(a) * F.sin(o) * y + F.cos(a) * z


def _geodetic(x, y, z, m):
    """Bowring's closed form for points near the ellipsoid; m: a module of sin, cos, atan2, sqrt."""
    b = WGS84_A * (1 - WGS84_F)
    second = WGS84_E2 / (1 - WGS84_E2)
    p = m.sqrt(x * x + y * y)
    th = m.atan2(z * WGS84_A, p * b)
    s, c = m.sin(th), m.cos(th)
    return m.atan2(z + second * b * s * s * s, p - WGS84_E2 * WGS84_A * c * c * c), m.atan2(y, x)


class _NumpyMath:
    sin, cos, sqrt, atan2 = np.sin, np.cos, np.sqrt, np.arctan2


def latlon(east: Num, north: Num, lat0: Num, lon0: Num) -> tuple[Column, Column]:
    """Inverse of `enu`: the point of the plane, lowered to the ellipsoid along the anchor's vertical."""
    e, n = _c(east), _c(north)
    u = -(e * e + n * n) / (2 * WGS84_A)
    a, o = F.radians(_c(lat0)), F.radians(_c(lon0))
    x0, y0, z0 = ecef(lat0, lon0)
    x = x0 - F.sin(o) * e - F.sin(a) * F.cos(o) * n + F.cos(a) * F.cos(o) * u
    y = y0 + F.cos(o) * e - F.sin(a) * F.sin(o) * n + F.cos(a) * F.sin(o) * u
    z = z0 + F.cos(a) * n + F.sin(a) * u
    lat, lon = _geodetic(x, y, z, F)
    return F.degrees(lat), F.degrees(lon)


def with_latlon(df: DataFrame, east: str, north: str, lat0: str, lon0: str, names: tuple[str, str]) -> DataFrame:
    """`latlon` for columns of a frame, in steps: one nested expression would repeat its parts a hundredfold."""
    e, n, a, o = F.col(east), F.col(north), F.radians(lat0), F.radians(lon0)
    u = -(e * e + n * n) / (2 * WGS84_A)
    x0, y0, z0 = ecef(F.col(lat0), F.col(lon0))
    df = df.withColumns({"_x": x0 - F.sin(o) * e - F.sin(a) * F.cos(o) * n + F.cos(a) * F.cos(o) * u, "_y": y0 + F.cos(o) * e - F.sin(a) * F.sin(o) * n + F.cos(a) * F.sin(o) * u, "_z": z0 + F.cos(a) * n + F.sin(a) * u})
    df = df.withColumn("_p", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
    df = df.withColumn("_th", F.atan2(F.col("_z") * WGS84_A, F.col("_p") * (WGS84_A * (1 - WGS84_F))))
    second, b = WGS84_E2 / (1 - WGS84_E2), WGS84_A * (1 - WGS84_F)
    lat = F.atan2(F.col("_z") + second * b * F.pow(F.sin("_th"), 3), F.col("_p") - WGS84_E2 * WGS84_A * F.pow(F.cos("_th"), 3))
    return df.withColumns({names[0]: F.degrees(lat), names[1]: F.degrees(F.atan2("_y", "_x"))}).drop("_x", "_y", "_z", "_p", "_th")


def velocity(sog_kn: Num, cog_deg: Num) -> tuple[Column, Column]:
    v, c = _c(sog_kn) * KNOT_MS, F.radians(_c(cog_deg))
    return v * F.sin(c), v * F.cos(c)


def sog_cog(ve: Num, vn: Num) -> tuple[Column, Column]:
    return F.hypot(_c(ve), _c(vn)) / KNOT_MS, F.pmod(F.degrees(F.atan2(_c(ve), _c(vn))), F.lit(360.0))


def cell(lat: Num, lon: Num, size_m: float, origin: tuple[float, float]) -> Column:
    """Key of the grid cell in the regional plane, a bigint."""
    e, n = enu(lat, lon, *origin)
    return (F.floor(e / size_m) + 50000) * 100000 + F.floor(n / size_m) + 50000


def neighbours(key: Column) -> Column:
    """The cell and the eight around it."""
    return F.array(*(key + dx * 100000 + dy for dx in (-1, 0, 1) for dy in (-1, 0, 1)))


def edge_km(lat: Num, lon: Num, box: tuple[float, float, float, float]) -> Column:
    """Distance to the nearest side of (lat_min, lat_max, lon_min, lon_max)."""
    a, o = _c(lat), _c(lon)
    wide = KM_PER_DEGREE * float(np.cos(np.radians((box[0] + box[1]) / 2)))
    return F.least((a - box[0]) * KM_PER_DEGREE, (box[1] - a) * KM_PER_DEGREE, (o - box[2]) * wide, (box[3] - o) * wide)


def course_bin(cog: Num, bins: int = 12) -> Column:
    return F.pmod(F.floor(F.coalesce(_c(cog), F.lit(0.0)) / (360.0 / bins)), F.lit(bins)).cast("int")


def ellipse(lat0: Num, lon0: Num, cee: Num, cnn: Num, cen: Num, prob: float = 0.9, points: int = 48) -> Column:
    """array<struct<lat, lon>>: the closed ring that holds `prob` of a Gaussian position."""
    k = float(-2 * np.log(1 - prob))
    mid, half = (_c(cee) + _c(cnn)) / 2, F.sqrt(F.pow((_c(cee) - _c(cnn)) / 2, 2) + F.pow(_c(cen), 2))
    major, minor = F.sqrt(k * (mid + half)), F.sqrt(k * F.greatest(mid - half, F.lit(0.0)))
    turn = F.atan2(2 * _c(cen), _c(cee) - _c(cnn)) / 2

    def at(i: Column) -> Column:
        w = i * float(2 * np.pi / points)
        e = major * F.cos(w) * F.cos(turn) - minor * F.sin(w) * F.sin(turn)
        n = major * F.cos(w) * F.sin(turn) + minor * F.sin(w) * F.cos(turn)
        lat, lon = latlon(e, n, lat0, lon0)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(points)), at)


def np_haversine_m(lat1, lon1, lat2, lon2):
    a1, o1, a2, o2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _np_frame(lat0, lon0):
    a, o = np.radians(np.asarray(lat0, float)), np.radians(np.asarray(lon0, float))
    zero = np.zeros_like(a + o)
    east = np.stack([-np.sin(o) + zero, np.cos(o) + zero, zero], -1)
    north = np.stack([-np.sin(a) * np.cos(o), -np.sin(a) * np.sin(o), np.cos(a) + zero], -1)
    return east, north, np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a) + zero], -1)


def np_ecef(lat, lon):
    a, o = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lon, float))
    n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(a) ** 2)
    return np.stack(np.broadcast_arrays(n * np.cos(a) * np.cos(o), n * np.cos(a) * np.sin(o), n * (1 - WGS84_E2) * np.sin(a)), -1)


def np_enu(lat, lon, lat0, lon0):
    d = np_ecef(lat, lon) - np_ecef(lat0, lon0)
    east, north, _ = _np_frame(lat0, lon0)
    return (d * east).sum(-1), (d * north).sum(-1)


def np_latlon(e, n, lat0, lon0):
    e, n = np.asarray(e, float), np.asarray(n, float)
    east, north, up = _np_frame(lat0, lon0)
    u = -(e**2 + n**2) / (2 * WGS84_A)
    p = np_ecef(lat0, lon0) + e[..., None] * east + n[..., None] * north + u[..., None] * up
    lat, lon = _geodetic(p[..., 0], p[..., 1], p[..., 2], _NumpyMath)
    return np.degrees(lat), np.degrees(lon)
