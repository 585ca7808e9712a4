"""Rates of spread of fuel types, and what follows from them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# A, b, c of the spread curve, then bui0, q, p, k1, k2 of the buildup effect (None: none).
CURVES = {
    "C-1": (90, 0.0649, 4.5, 60, 0.92, 0.91, 50, 450), "C-2": (110, 0.0282, 1.5, 35, 0.8, 0.92, 45, 300), "C-3": (110, 0.0444, 3.0, 40, 0.8, 0.90, 45, 350),
    "C-4": (110, 0.0293, 1.5, 35, 0.8, 0.90, 45, 320), "C-5": (30, 0.0697, 4.0, 40, 0.8, 0.90, 45, 350), "C-6": (30, 0.0800, 3.0, 35, 0.8, 0.90, 45, 300),
    "C-7": (45, 0.0305, 2.0, 40, 0.8, 0.90, 45, 350), "D-1": (30, 0.0232, 1.6, 40, 0.8, 0.90, 45, 350), "O-1A": (190, 0.0310, 1.4, None, None, None, None, None),
    "O-1B": (250, 0.0350, 1.7, None, None, None, None, None), "DEAD": (120, 0.0572, 1.4, None, None, None, None, None),
    "S-1": (75, 0.0297, 1.3, 35, 0.8, 0.90, 45, 300), "S-2": (40, 0.0438, 1.7, 35, 0.8, 0.90, 45, 300), "S-3": (55, 0.0829, 3.2, 35, 0.8, 0.90, 45, 300),
}
# Numeric codes of the default map.
FUEL_CODES = {
    1: "C-1", 2: "C-2", 3: "C-3", 4: "C-4", 5: "C-5", 6: "C-6", 7: "C-7", 11: "D-1", 12: "D-1", 13: "D-1", 21: "S-1", 22: "S-2", 23: "S-3", 31: "O-1A", 32: "O-1B",
    40: "M-1", 50: "M-2", 60: "M-3", 70: "M-4",
}
FUELS = ("C-1", "C-2", "C-3", "C-4", "C-5", "C-6", "C-7", "D-1", "M-1", "M-2", "M-3", "M-4", "O-1A", "O-1B", "S-1", "S-2", "S-3")


def curve(fuel: str, isi: Column) -> Column:
    a, b, c = CURVES[fuel][:3]
    return a * F.pow(1.0 - F.exp(-b * F.greatest(isi, F.lit(0.0))), F.lit(float(c)))


def buildup(fuel: str, bui: Column) -> Column:
    start, q, p, k1, k2 = CURVES[fuel][3:]
    if start is None:
        return F.lit(1.0)
    big = q * F.pow(F.greatest(bui - start, F.lit(0.0)), F.lit(float(p)))
    return F.when(bui > start, F.exp(k1 * F.log(big) / (k2 + big))).otherwise(1.0)


def curing_factor(curing: Column) -> Column:
    """Share of the spread of grass that its curing (percent) allows."""
    raw = F.when(curing < 58.8, 0.005 * (F.exp(0.061 * curing) - 1.0)).otherwise(0.176 + 0.02 * (curing - 58.8))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def head_ros(fuel: str, isi: Column, bui: Column, fmc=100.0, curing=85.0, conifer=50.0, dead_fir=50.0) -> Column:
    """Head rate of spread (m/min) of one fuel; 0 for fuels that don't burn or aren't known. A null ``isi`` counts as 0."""
    fuel = {"O-1": "O-1A"}.get(fuel.strip().upper(), fuel.strip().upper())
    isi = F.coalesce(isi.cast("double"), F.lit(0.0))
    bui = bui.cast("double")
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    if fuel in ("M-1", "M-2", "M-3", "M-4"):
        share = F.least(F.greatest(lit(conifer if fuel < "M-3" else dead_fir), F.lit(0.0)), F.lit(100.0)) / 100.0
        leafy = (1.0 if fuel in ("M-1", "M-3") else 0.2) * head_ros("D-1", isi, bui)
        other = head_ros("C-2", isi, bui) if fuel < "M-3" else curve("DEAD", isi)
        return share * other + (1.0 - share) * leafy
    if fuel not in CURVES or fuel == "DEAD":
        return F.lit(0.0)
    rate = curve(fuel, isi)
    if fuel == "C-6":
        moist = F.greatest(lit(fmc), F.lit(0.0))
        crown = F.greatest(1000.0 * F.pow(1.5 - 0.00275 * moist, F.lit(4.0)) / (460.0 + 25.9 * moist), F.lit(0.0))
        burned = F.least(F.greatest(1.0 - F.exp(-0.23 * F.greatest(rate - 10.0, F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
        rate = rate + burned * crown
    if fuel in ("O-1A", "O-1B"):
        return F.greatest(rate * curing_factor(lit(curing)), F.lit(0.0))
    return F.greatest(rate * buildup(fuel, bui), F.lit(0.0))


_CURVE = ("a", "b", "c", "start", "q", "p", "k1", "k2")


def _share(percent: float) -> float:
    return min(max(float(percent), 0.0), 100.0) / 100.0


def _plain_curing(curing: float) -> float:
    raw = 0.005 * (math.exp(0.061 * curing) - 1.0) if curing < 58.8 else 0.176 + 0.02 * (curing - 58.8)
    return min(max(raw, 0.0), 1.0)


def rate_table(fuels: list[str], fmc: float = 100.0, curing: float = 85.0, conifer: float = 50.0, dead_fir: float = 50.0) -> Column:
    """An array with what each fuel's rate is made of: one curve or two, their weights, and the most a crown fire adds.

    Every fuel then has the same expression (``rate_of``), instead of one of its own.
    """
    moist = max(float(fmc), 0.0)
    crown = max(1000.0 * (1.5 - 0.00275 * moist) ** 4 / (460.0 + 25.9 * moist), 0.0)
    entries = []
    for given in fuels:
        fuel = {"O-1": "O-1A"}.get(given.strip().upper(), given.strip().upper())
        first, second, w1, w2 = fuel, None, 1.0, 0.0
        if fuel in ("M-1", "M-2", "M-3", "M-4"):
            w1 = _share(conifer if fuel < "M-3" else dead_fir)
            first, second, w2 = "C-2" if fuel < "M-3" else "DEAD", "D-1", (1.0 - w1) * (1.0 if fuel in ("M-1", "M-3") else 0.2)
        elif fuel in ("O-1A", "O-1B"):
            w1 = _plain_curing(float(curing))
        elif fuel not in CURVES or fuel == "DEAD":
            first, w1 = None, 0.0
        curve_of = lambda f: F.struct(*[F.lit(None if f is None or v is None else float(v)).cast("double").alias(n) for n, v in zip(_CURVE, CURVES.get(f, (None,) * 8))])
        entries.append(F.struct(F.lit(given).alias("fuel"), curve_of(first).alias("one"), F.lit(w1).alias("w1"), curve_of(second).alias("two"), F.lit(w2).alias("w2"), F.lit(crown if fuel == "C-6" else 0.0).alias("crown")))
    return F.array(*entries)


def rate_of(entry: str, isi: Column, bui: Column) -> Column:
    """Head rate (m/min) of an entry of ``rate_table``; a null ``isi`` counts as 0."""
    isi = F.greatest(F.coalesce(isi.cast("double"), F.lit(0.0)), F.lit(0.0))
    bui = bui.cast("double")
    at = lambda side, n: F.col(f"{entry}.{side}.{n}")

    def base(side: str) -> Column:
        return at(side, "a") * F.pow(1.0 - F.exp(-at(side, "b") * isi), at(side, "c"))

    def built(side: str) -> Column:
        big = at(side, "q") * F.pow(F.greatest(bui - at(side, "start"), F.lit(0.0)), at(side, "p"))
        return F.when(bui > at(side, "start"), F.exp(at(side, "k1") * F.log(big) / (at(side, "k2") + big))).otherwise(1.0)

    burned = F.least(F.greatest(1.0 - F.exp(-0.23 * F.greatest(base("one") - 10.0, F.lit(0.0))), F.lit(0.0)), F.lit(1.0))
    crowned = F.when(F.col(f"{entry}.crown") > 0, base("one") + burned * F.col(f"{entry}.crown")).otherwise(base("one"))
    first = F.when(F.col(f"{entry}.w1") > 0, F.col(f"{entry}.w1") * crowned * built("one")).otherwise(0.0)
    second = F.when(F.col(f"{entry}.w2") > 0, F.col(f"{entry}.w2") * base("two") * built("two")).otherwise(0.0)
    return F.greatest(first + second, F.lit(0.0))


def fuel_name(code: Column, lookup: dict[int, str] | None = None) -> Column:
    """Name of a numeric fuel code by ``lookup`` (by default ``FUEL_CODES``); NF for all others.

    Names of other fuels, and ones that don't burn, are NF too.
    """
    known = {n: known_fuel(f) for n, f in (FUEL_CODES if lookup is None else lookup).items()}
    pairs = [x for n, f in known.items() if f != "NF" for x in (F.lit(n), F.lit(f))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), F.lit("NF")) if pairs else F.lit("NF")


def known_fuel(name: str) -> str:
    """A fuel's name as in ``FUELS``; NF if it isn't one of them."""
    plain = name.strip().upper()
    plain = {"O-1": "O-1A"}.get(plain, plain)
    return plain if plain in FUELS else "NF"


def back_ros(head: Column, share=0.2) -> Column:
    return share * head


def flank_ros(head: Column, back: Column, length_to_breadth=2.0) -> Column:
    return (head + back) / (2.0 * length_to_breadth)


def azimuth(wind_direction: Column) -> Column:
    """Where a fire spreads to, in degrees, from where the wind comes from."""
    return F.pmod(wind_direction.cast("double") + 180.0, F.lit(360.0))


# Effect of temperature, of height on it, and of humidity, from what they are counted, and the bounds of the factor.
LAPSE, WARM_AT, DRY_AT, PER_DEGREE, PER_PERCENT, LEAST_FACTOR, MOST_FACTOR = 0.0065, 20.0, 30.0, 0.002, 0.001, 0.7, 1.3


def head_plane(rate, open_, elev, slope, aspect, wind, temp, rh, strength=0.5) -> np.ndarray:
    """Head rates of a plane of cells (arrays) at one instant: ``slope_factor`` and ``elevation_factor`` as there; 0 where a cell is closed or has no height."""
    tilt = 1.0 + strength * np.tan(np.radians(slope)) * np.cos(np.radians(wind - (aspect + 180.0)))
    height = np.clip(1.0 - PER_DEGREE * (temp - LAPSE * elev - WARM_AT) + PER_PERCENT * (rh - DRY_AT), LEAST_FACTOR, MOST_FACTOR)
    return np.nan_to_num(np.where(open_, rate, 0.0) * np.where(np.isnan(tilt), 1.0, np.maximum(tilt, 0.0)) * height)


def slope_factor(slope_deg: Column, aspect_deg: Column, wind_direction: Column, strength=0.5) -> Column:
    """Factor of the spread on a slope; 1 where the aspect is missing."""
    raw = 1.0 + strength * F.tan(F.radians(slope_deg)) * F.cos(F.radians(wind_direction - (aspect_deg + 180.0)))
    return F.when(raw.isNull(), 1.0).when(raw < 0, 0.0).otherwise(raw)


def elevation_factor(elevation: Column, temp: Column, rh: Column, lapse=LAPSE, temp_at=WARM_AT, rh_at=DRY_AT) -> Column:
    raw = 1.0 - PER_DEGREE * (temp - lapse * elevation - temp_at) + PER_PERCENT * (rh - rh_at)
    return F.when(raw < LEAST_FACTOR, LEAST_FACTOR).when(raw > MOST_FACTOR, MOST_FACTOR).otherwise(raw)
