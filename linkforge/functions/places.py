"""British National Grid to latitude and longitude, as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Airy 1830 and WGS84 ellipsoids, the grid's origin and scale, and the Helmert shift between the datums.
AIRY, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
SCALE, LATITUDE_0, LONGITUDE_0, EASTING_0, NORTHING_0 = 0.9996012717, 49 * pi / 180, -2 * pi / 180, 400000.0, -100000.0
SHIFT, ROTATION, GROWTH = (446.448, -125.157, 542.060), (0.1502, 0.2470, 0.8421), -20.4894e-6


def _meridian(latitude: Column) -> Column:
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = latitude - LATITUDE_0, latitude + LATITUDE_0
    terms = (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )
    return terms * b * SCALE


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _repeat(start: Column, step: Callable[[Column], Column], times: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda x, _: step(x))


def to_latitude_longitude(easting: Column, northing: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Degrees of WGS84, within some metres; null where either coordinate is."""
    a, _ = AIRY
    first = (northing - NORTHING_0) / (a * SCALE) + LATITUDE_0
    foot = _repeat(first, lambda x: x + (northing - NORTHING_0 - _meridian(x)) / (a * SCALE), rounds)
    place = _let(foot, lambda x: _shifted(*_inverse(x, easting - EASTING_0)))
    return place["latitude"], place["longitude"]


def _inverse(latitude: Column, d: Column) -> tuple[Column, Column]:
    """Latitude and longitude on the Airy ellipsoid from the foot point's latitude and the distance from the meridian."""
    a, b = AIRY
    e2 = 1 - (b * b) / (a * a)
    w = 1 - e2 * F.sin(latitude) ** 2
    nu, rho = a * SCALE / F.sqrt(w), a * SCALE * (1 - e2) / w**1.5
    eta, t, sec = nu / rho - 1, F.tan(latitude), 1 / F.cos(latitude)
    phi = (
        latitude - t / (2 * rho * nu) * d**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta - 9 * t**2 * eta) * d**4
        - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * d**6
    )
    lam = (
        LONGITUDE_0 + sec / nu * d - sec / (6 * nu**3) * (nu / rho + 2 * t**2) * d**3
        + sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) * d**5
    )
    return phi, lam


def _shifted(phi: Column, lam: Column) -> Column:
    """(latitude, longitude) in degrees on the other datum."""
    return _let(F.struct(phi.alias("phi"), lam.alias("lam")), lambda p: _let(_moved(p["phi"], p["lam"]), _degrees))


def _moved(phi: Column, lam: Column) -> Column:
    a, b = AIRY
    e2 = 1 - (b * b) / (a * a)
    nu = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    x, y, z = nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), (1 - e2) * nu * F.sin(phi)
    rx, ry, rz = (r / 3600 * pi / 180 for r in ROTATION)
    s = 1 + GROWTH
    return F.struct(
        (SHIFT[0] + s * x - rz * y + ry * z).alias("u"), (SHIFT[1] + rz * x + s * y - rx * z).alias("v"), (SHIFT[2] - ry * x + rx * y + s * z).alias("w")
    )


def _degrees(at: Column) -> Column:
    a, b = WGS84
    e2 = 1 - (b * b) / (a * a)
    u, v, w = at["u"], at["v"], at["w"]
    p = F.sqrt(u * u + v * v)
    latitude = _repeat(F.atan2(w, p * (1 - e2)), lambda x: F.atan2(w + e2 * a / F.sqrt(1 - e2 * F.sin(x) ** 2) * F.sin(x), p), 3)
    return F.struct(F.degrees(latitude).alias("latitude"), F.degrees(F.atan2(v, u)).alias("longitude"))
