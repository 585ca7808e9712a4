"""Map projections in closed form, as Columns: degrees to metres and back."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid (major axis, flattening), and the conic projections: standard parallels, origin, offsets.
MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257222101
E2 = FLATTENING * (2 - FLATTENING)
ALBERS = {3005: (50.0, 58.5, 45.0, -126.0, 1_000_000.0, 0.0)}
LAMBERT = {3978: (49.0, 77.0, 49.0, -95.0, 0.0, 0.0)}


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web-map coordinates (EPSG:3857)."""
    return MAJOR * F.radians(lon), MAJOR * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def _q(s, log):
    """Authalic quantity of a sine of latitude."""
    e = math.sqrt(E2)
    return (1 - E2) * (s / (1 - E2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def albers(lon: Column, lat: Column, epsg: int = 3005) -> tuple[Column, Column]:
    """Equal-area conic coordinates."""
    p1, p2, p0, l0, fx, fy = ALBERS[epsg]
    sines = [math.sin(math.radians(p)) for p in (p1, p2, p0)]
    m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - E2 * s * s) for p, s in zip((p1, p2), sines))
    q1, q2, q0 = (_q(s, math.log) for s in sines)
    n = (m1 * m1 - m2 * m2) / (q2 - q1)
    c = m1 * m1 + n * q1
    rho0 = MAJOR * math.sqrt(c - n * q0) / n
    rho = MAJOR * F.sqrt(c - n * _q(F.sin(F.radians(lat)), F.log)) / n
    theta = n * F.radians(lon - l0)
    return fx + rho * F.sin(theta), fy + rho0 - rho * F.cos(theta)


def lambert(lon: Column, lat: Column, epsg: int = 3978) -> tuple[Column, Column]:
    """Conformal conic coordinates."""
    p1, p2, p0, l0, fx, fy = LAMBERT[epsg]
    e = math.sqrt(E2)

    def t(p: float) -> float:
        s = math.sin(math.radians(p))
        return math.tan(math.pi / 4 - math.radians(p) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)

    m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - E2 * math.sin(math.radians(p)) ** 2) for p in (p1, p2))
    n = (math.log(m1) - math.log(m2)) / (math.log(t(p1)) - math.log(t(p2)))
    f = m1 / (n * t(p1) ** n)
    s = F.sin(F.radians(lat))
    rho = MAJOR * f * F.pow(F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2)), F.lit(n))
    theta = n * F.radians(lon - l0)
    return fx + rho * F.sin(theta), fy + MAJOR * f * t(p0) ** n - rho * F.cos(theta)


def utm_zone(lon: float) -> int:
    """Zone of a longitude, from 1 to 60."""
    return int((lon + 180) // 6) % 60 + 1


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Transverse coordinates of a zone, by series in the third flattening (millimetres within a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    a = MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e, s = math.sqrt(E2), F.sin(F.radians(lat))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(s) - e * atanh(e * s))
    dl = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = eta + sum(c * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, c in enumerate(series, 1))
    y = xi + sum(c * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, c in enumerate(series, 1))
    return 500_000.0 + 0.9996 * a * x, (10_000_000.0 if south else 0.0) + 0.9996 * a * y


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """Coordinates of a place in degrees in a system: degrees, web map, the conics above, or a UTM zone."""
    if epsg in (4326, 4269):
        return lon, lat
    if epsg == 3857:
        return mercator(lon, lat)
    if epsg in ALBERS:
        return albers(lon, lat, epsg)
    if epsg in LAMBERT:
        return lambert(lon, lat, epsg)
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return utm(lon, lat, epsg % 100, epsg >= 32700)
    raise ValueError(f"EPSG:{epsg} isn't known")
