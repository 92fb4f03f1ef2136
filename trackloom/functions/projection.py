"""Map projections and datum shifts as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid and the transverse Mercator scale (fixed values).
A, FLAT, SCALE = 6378137.0, 1 / 298.257223563, 0.9996
_N = FLAT / (2 - FLAT)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the series in the third flattening, to its fourth power.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
#: From the conformal to the geographic latitude.
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = math.sqrt(FLAT * (2 - FLAT))


def utm_zone(lng: Column) -> Column:
    """Zone 1..60."""
    return F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lng + 180) / 6).cast("int") + 1))


def utm_epsg(lng: Column, lat: Column) -> Column:
    """EPSG number of the zone, 326xx north and 327xx south of the equator."""
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lng)


def to_utm(lng: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; southern latitudes get the usual false northing."""
    phi, lam = F.radians(lat), F.radians(lng - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(F.cos(lam) ** 2 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x += a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y += a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x * (SCALE * _RECT) + 500_000, y * (SCALE * _RECT) + F.when(lat < 0, 10_000_000).otherwise(0)


def from_utm(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres."""
    xi, eta = (y - F.when(south, 10_000_000).otherwise(0)) / (SCALE * _RECT), (x - 500_000) / (SCALE * _RECT)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u -= b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v -= b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat += d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + zone * 6 - 183, F.degrees(lat)


def to_mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres."""
    return F.radians(lng) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)


#: Ellipsoid and offsets of the GCJ-02 and BD-09 datums (fixed values): axis and
#: squared eccentricity; BD-09's angle factor, ripple and offsets.
GCJ_A, GCJ_E2 = 6378245.0, 0.00669342162296594323
BD_FACTOR, BD_RADIUS, BD_ANGLE, BD_LNG, BD_LAT = math.pi * 3000 / 180, 0.00002, 0.000003, 0.0065, 0.006
#: Coefficients of the GCJ-02 shift (fixed values) for 1, x, y, x*x, y*y, x*y and the root of |x|.
GCJ_LNG, GCJ_LAT = (300.0, 1.0, 2.0, 0.1, 0.0, 0.1, 0.1), (-100.0, 2.0, 3.0, 0.0, 0.2, 0.1, 0.2)
#: Sizes and periods of its waves (fixed values): those of x in both, those of x in the longitude, those of y in the latitude.
GCJ_WAVES, GCJ_LNG_WAVES, GCJ_LAT_WAVES = ((20, 1 / 3), (20, 1.0)), ((20, 2.0), (40, 6.0), (150, 24.0), (300, 60.0)), ((20, 2.0), (40, 6.0), (160, 24.0), (320, 60.0))


def _gcj_shift(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lng - 105, lat - 35

    def waves(c: Column, sizes: tuple) -> Column:
        return sum((F.sin(c * (2 * math.pi / period)) * size for size, period in sizes), F.lit(0.0))

    def smooth(c: tuple) -> Column:
        return c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * y * y + c[5] * x * y + c[6] * F.sqrt(F.abs(x))

    east = smooth(GCJ_LNG) + (waves(x, GCJ_WAVES) + waves(x, GCJ_LNG_WAVES)) * (2 / 3)
    north = smooth(GCJ_LAT) + (waves(x, GCJ_WAVES) + waves(y, GCJ_LAT_WAVES)) * (2 / 3)
    phi = F.radians(lat)
    m = 1 - GCJ_E2 * F.sin(phi) * F.sin(phi)
    return F.degrees(east * F.sqrt(m) / (GCJ_A * F.cos(phi))), F.degrees(north * m * F.sqrt(m) / (GCJ_A * (1 - GCJ_E2)))


def _gcj_bd(lng: Column, lat: Column) -> tuple[Column, Column]:
    z = F.sqrt(lng * lng + lat * lat) + BD_RADIUS * F.sin(lat * BD_FACTOR)
    a = F.atan2(lat, lng) + BD_ANGLE * F.cos(lng * BD_FACTOR)
    return z * F.cos(a) + BD_LNG, z * F.sin(a) + BD_LAT


def _bd_gcj(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lng - BD_LNG, lat - BD_LAT
    z = F.sqrt(x * x + y * y) - BD_RADIUS * F.sin(y * BD_FACTOR)
    a = F.atan2(y, x) - BD_ANGLE * F.cos(x * BD_FACTOR)
    return z * F.cos(a), z * F.sin(a)


def convert_datum(lng: Column, lat: Column, kind: str) -> tuple[Column, Column]:
    """'gc-bd', 'bd-gc', '84-gc', 'gc-84', '84-bd' or 'bd-84'; any other kind changes nothing.

    From GCJ-02 to WGS84 the shift at the given place is taken off once, as is
    customary; that leaves an error of a metre or two.
    """
    if kind in ("84-gc", "84-bd"):
        dx, dy = _gcj_shift(lng, lat)
        lng, lat = lng + dx, lat + dy
    if kind in ("gc-bd", "84-bd"):
        return _gcj_bd(lng, lat)
    if kind in ("bd-gc", "bd-84"):
        lng, lat = _bd_gcj(lng, lat)
    if kind in ("gc-84", "bd-84"):
        dx, dy = _gcj_shift(lng, lat)
        return lng - dx, lat - dy
    return lng, lat


def convert_points(points: Column, kind: str) -> Column:
    """The datum shift of every point of an array<struct<x,y>>."""
    def one(p: Column) -> Column:
        x, y = convert_datum(p["x"], p["y"], kind)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(points, one)
