"""Units of temperature, wind speed and precipitation: names, conversions and free text."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value in the common unit = value * factor + shift. Common units: °C, km/h, mm.
CONVERSIONS = {
    "temperature": {"C": (1.0, 0.0), "F": (5 / 9, -160 / 9), "K": (1.0, -273.15)},
    "wind_speed": {"km/h": (1.0, 0.0), "m/s": (3.6, 0.0), "mph": (1.609344, 0.0), "kn": (1.852, 0.0)},
    "precipitation": {"mm": (1.0, 0.0), "cm": (10.0, 0.0), "in": (25.4, 0.0), "0.1mm": (0.1, 0.0), "0.01in": (0.254, 0.0)},
}
COMMON = {"temperature": "C", "wind_speed": "km/h", "precipitation": "mm"}

# Spellings after a number, in small letters without spaces and full stops.
SPELLINGS = {
    "temperature": {
        "C": ("c", "°c", "degc", "degreec", "degreesc", "celsius", "℃"), "F": ("f", "°f", "degf", "degreef", "degreesf", "fahrenheit", "℉"),
        "K": ("k", "kelvin", "degk"),
    },
    "wind_speed": {
        "km/h": ("km/h", "kmh", "kph", "kmph", "kmhr", "km/hr"), "m/s": ("m/s", "mps", "ms-1", "m/sec", "metrespersecond", "meterspersecond"),
        "mph": ("mph", "mi/h", "mi/hr", "milesperhour"), "kn": ("kn", "kt", "kts", "knot", "knots"),
    },
    "precipitation": {
        "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters"), "cm": ("cm", "centimetre", "centimetres", "centimeter", "centimeters"),
        "in": ("in", "inch", "inches", '"', "″", "''"),
    },
}

# How free text names a unit; the first that is found counts.
WORDINGS = {
    "temperature": (("F", r"fahrenheit|\bdeg(rees)? ?f\b|° ?f\b"), ("K", r"\bkelvin\b|[\[=]k[\]/]"), ("C", r"celsius|centigrade|\bdeg(rees)? ?c\b|° ?c\b")),
    "wind_speed": (
        ("mph", r"miles? per hour|\bmph\b|\bmi/h"), ("m/s", r"met(re|er)s? per second|\bm/s\b|\bmps\b"), ("kn", r"\bknots?\b|\bkts?\b|\bkn\b"),
        ("km/h", r"kilomet(re|er)s? per hour|\bkm/h\b|\bkph\b|\bkmh\b"),
    ),
    "precipitation": (
        ("0.01in", r"hundredths? of an inch"), ("0.1mm", r"tenths? of a millimet(re|er)|tenths? of (a )?mm"), ("mm", r"millimet(re|er)s?|\bmm\b"),
        ("cm", r"centimet(re|er)s?|\bcm\b"), ("in", r"\binch(es)?\b|[\[/]in\b"),
    ),
}

_NUMBER = re.compile(r"[-+−]?(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+)")
_BY_SPELLING = {f: {t: u for u, texts in units.items() for t in texts} for f, units in SPELLINGS.items()}
_PATTERNS = {f: [(u, re.compile(p)) for u, p in forms] for f, forms in WORDINGS.items()}
FROM = ("value", "note", "remarks", "none")


@lru_cache(maxsize=200_000)
def read_value(text: str, field: str) -> tuple[float, str | None]:
    """The leading number of a text and the unit after it.

    The number is NaN if there is none; the unit ``""`` if none is written, None if it isn't known.
    Decimal commas and the minus sign U+2212 are read.
    """
    text = text.strip()
    if not (m := _NUMBER.match(text)):
        return float("nan"), None
    rest = text[m.end() :].lower().replace(" ", "").replace(".", "")
    return float(m[0].replace(",", ".").replace("−", "-")), "" if not rest else _BY_SPELLING[field].get(rest)


@lru_cache(maxsize=50_000)
def named_unit(text: str | None, field: str) -> str | None:
    """The unit of ``field`` that free text names, None if none."""
    low = (text or "").lower()
    return next((u for u, pattern in _PATTERNS[field] if pattern.search(low)), None)


def _codes(texts: pa.Array) -> tuple[list, np.ndarray]:
    coded = texts.cast(pa.string()).dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def read_units(values: pa.Array, notes: pa.Array, remarks: pa.Array, field: str) -> tuple[np.ndarray, ...]:
    """Number (NaN: none), unit (index into the field's units, -1: none or unknown), where the unit
    is from (index into ``FROM``) and the value in the common unit (NaN: no unit).

    Equal texts are read once, so the cost a row is that of looking up.
    """
    units = list(CONVERSIONS[field])
    (texts, at), (note, note_at), (remark, remark_at) = _codes(values), _codes(notes), _codes(remarks)
    read = [read_value(t, field) if t is not None else (float("nan"), None) for t in texts]
    index = lambda u: -1 if u is None else -2 if u == "" else units.index(u)
    number = np.array([n for n, _ in read], float)[at]
    own, noted, remarked = (
        np.array([index(u) for u in names], int)[places]
        for names, places in (
            ([u for _, u in read], at), ([named_unit(t, field) for t in note], note_at), ([named_unit(t, field) for t in remark], remark_at),
        )
    )
    bare = own == -2
    unit = np.where(~bare, own, np.where(noted >= 0, noted, remarked))
    source = np.where(~bare, 0, np.where(noted >= 0, 1, np.where(remarked >= 0, 2, 3)))
    factors, shifts = (np.array([*(c[i] for c in CONVERSIONS[field].values()), np.nan]) for i in (0, 1))
    return number, unit, source, number * factors[unit] + shifts[unit]


VALUE = T.StructType([
    T.StructField("number", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("unit_from", T.StringType()), T.StructField("common", T.DoubleType()),
])


def _reader(field: str):
    @F.arrow_udf(VALUE)
    def read(values: pa.Array, notes: pa.Array, remarks: pa.Array) -> pa.Array:
        number, unit, source, common = read_units(values, notes, remarks, field)
        absent = np.isnan(number)
        names = lambda codes, table, none: pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32(), mask=none), pa.array(table)).cast(pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(number, mask=absent), names(unit, list(CONVERSIONS[field]), unit < 0), names(source, FROM, absent), pa.array(common, mask=np.isnan(common))],
            ["number", "unit", "unit_from", "common"],
        )

    return read


#: Per field, an expression of (value, note, remarks) that gives a ``VALUE``.
READERS = {field: _reader(field) for field in CONVERSIONS}


def _milli(field: str):
    @F.arrow_udf(T.LongType())
    def milli(values: pa.Array, notes: pa.Array, remarks: pa.Array) -> pa.Array:
        number, unit, source, common = read_units(values, notes, remarks, field)
        common = np.where(source == 3, number, common)
        return pa.array(np.rint(np.nan_to_num(common) * 1000).astype(np.int64), mask=np.isnan(common))

    return milli


#: Per field, an expression of (value, note, remarks): thousandths of the common unit, which counts where none is given.
MILLI = {field: _milli(field) for field in CONVERSIONS}
