"""Ellipsoidal area and UTM coordinates as column arithmetic (WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and UTM (fixed values).
A, FLAT = 6378137.0, 1 / 298.257223563
K0, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
N = FLAT / (2 - FLAT)
#: Rectifying radius and the coefficients of Krüger's series to the fourth order.
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def zone_area(lat: Column) -> Column:
    """Square metres per radian of longitude between the equator and a latitude in degrees."""
    s = F.sin(F.radians(lat))
    return F.lit(A * A * (1 - E2) / 2) * (s / (1 - E2 * s * s) + F.lit(1 / (2 * E)) * F.log((1 + E * s) / (1 - E * s)))


def edge_area(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Signed area between an edge and the equator; summed over a ring it is the ring's."""
    return F.radians(lon1 - lon0) * (zone_area(lat0) + zone_area(lat1)) / 2


def _cosh(x: Column) -> Column:
    return (F.exp(x) + F.exp(-x)) / 2


def _sinh(x: Column) -> Column:
    return (F.exp(x) - F.exp(-x)) / 2


def _atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6 - 183


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of an EPSG code 326zz or 327zz."""
    phi, dl = F.radians(lat), F.radians(lon - central_meridian(epsg))
    t = _sinh(_atanh(F.sin(phi)) - F.lit(E) * _atanh(F.lit(E) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), _atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * _sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * _cosh(2 * j * eta)
    return F.lit(EAST) + K0 * RADIUS * x, F.when(epsg >= 32700, F.lit(SOUTH)).otherwise(0.0) + K0 * RADIUS * y


def to_wgs84(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude; coordinates of EPSG 4326 pass through."""
    xi = (north - F.when(epsg >= 32700, F.lit(SOUTH)).otherwise(0.0)) / (K0 * RADIUS)
    eta = (east - EAST) / (K0 * RADIUS)
    x, y = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * _cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * _sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / _cosh(y))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lon = central_meridian(epsg) + F.degrees(F.atan2(_sinh(y), F.cos(x)))
    return F.when(epsg == 4326, east).otherwise(lon), F.when(epsg == 4326, north).otherwise(F.degrees(phi))
