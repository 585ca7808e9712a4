"""Written times parsed by form, a batch at a time.

Texts of equal form (digits, letters and signs in equal places) are parsed together: the form
is read once, which gives the place of every field, and the fields of all its rows come out by
arithmetic on the bytes. Forms are few, so the cost a row is that of the arithmetic.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Offsets of zone letters in minutes. Letters that name several zones are left out.
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

STATUS = ("resolved", "unreadable", "undecided", "nonexistent", "twice", "no_zone", "other_order", "too_long")
RESOLVED, UNREADABLE, UNDECIDED, NONEXISTENT, TWICE, NO_ZONE, OTHER_ORDER, TOO_LONG = range(8)

#: Bytes of the longest text that any form allows; what is longer is of no form.
LONGEST = 80

# Forms are matched on texts whose digits are written 9, capitals A and small letters a.
_DATE_FORMS = [re.compile(x) for x in (
    r"(?P<y>9{4})[-/.](?P<m>99?)[-/.](?P<d>99?)(?!9)", r"(?P<y>9{4})-(?P<doy>9{3})(?!9)", r"(?P<y>9{4})(?P<m>99)(?P<d>99)(?!9)",
    r"(?P<first>99?)[/.](?P<then>99?)[/.](?P<y>9{4}|99)(?!9)",
    r"(?:Aaa+,? )?(?P<d>99?)[ -](?P<name>[Aa]{3,9})\.?[ -](?P<y>9{4})(?!9)", r"(?:Aaa+,? )?(?P<name>[Aa]{3,9})\.? (?P<d>99?),? (?P<y>9{4})(?!9)",
)]
_TIME_FORMS = [re.compile(x) for x in (
    r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,]9+)?)?(?: ?(?P<half>[Aa])[Aa](?![Aa]))?", r"(?P<h>99?) ?(?P<half>[Aa])[Aa](?![Aa])", r"(?P<h>99?)(?P<mark>[Aa])(?P<mi>99)(?!9)",
    r"(?P<h>99?)[.,](?P<part>9{1,12})(?!9)", r"(?P<h>99)(?P<mi>99)(?P<s>99)?(?!9)", r"(?P<h>99?)(?!9)",
)]
_ZONE_FORM = re.compile(r" ?(?:(?P<sign>[+-])(?P<oh>99):?(?P<om>99)|(?P<prefix>AAA)(?P<sign2>[+-])(?P<oh2>99):?(?P<om2>99)|(?P<letters>A{1,5}))?(?:\[[^\]]+\])?$")
_EPOCH_FORM = re.compile(r"(?:9{9,10}|9{12,13}|9{15,16})$")
_JOIN = re.compile(r"(?P<tee>A)|,? +")

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 57, 65, 97
_MIX = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64) | np.uint64(1))


@lru_cache(maxsize=10_000)
def read_form(form: str) -> dict[str, tuple[int, int]] | None:
    """The spans of the fields in texts of this form; None if it is no form of a time."""
    if _EPOCH_FORM.match(form):
        return {"epoch": (0, len(form))}
    for date in _DATE_FORMS:
        if not (a := date.match(form)):
            continue
        ways = [((), a.end())]
        if join := _JOIN.match(form, a.end()):
            ways = [((join, b), b.end()) for t in _TIME_FORMS if (b := t.match(form, join.end()))] + ways
        for clock, end in ways:
            if zone := _ZONE_FORM.match(form, end):
                spans = {k: x.span(k) for x in (a, *clock, zone) for k, v in x.groupdict().items() if v is not None}
                return {k.rstrip("2"): v for k, v in spans.items()}
    return None


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each text, padded with 0, and the lengths."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lengths = np.diff(offsets)
    width = int(min(lengths.max(initial=0), LONGEST))
    at = offsets[:-1, None] + np.arange(width)
    inside = np.arange(width) < lengths[:, None]
    out = np.zeros((len(texts), width), np.uint8)
    out[inside] = data[at[inside]]
    return out, lengths


def _number(rows: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    value = np.zeros(len(rows), np.int64)
    for k in range(*span):
        value = value * 10 + (rows[:, k] - 48)
    return value


def _looked_up(rows: np.ndarray, span: tuple[int, int], table: dict[str, int], missing: int) -> np.ndarray:
    key = np.zeros(len(rows), np.int64)
    for k in range(*span):
        key = key * 256 + rows[:, k]
    known, at = np.unique(key, return_inverse=True)
    size = span[1] - span[0]
    return np.array([table.get(int(x).to_bytes(8, "big")[-size:].decode("latin-1"), missing) for x in known], np.int64)[at]


def civil_days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970, and whether there is such a date."""
    good = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12)
    month = np.where(good, (y - 1970) * 12 + m - 1, 0).astype("datetime64[M]")
    start = month.astype("datetime64[D]").astype(np.int64)
    longest = (month + 1).astype("datetime64[D]").astype(np.int64) - start
    return start + d - 1, good & (d >= 1) & (d <= longest)


class Parsed:
    """Fields of written times: ``day``, ``swapped`` (the day if month comes first), ``secs``,
    ``offset``, ``epoch``, each with what says where it holds."""

    def __init__(self, n: int) -> None:
        integers = lambda: np.zeros(n, np.int64)
        self.day, self.swapped, self.secs, self.offset, self.epoch, self.year = (integers() for _ in range(6))
        self.has_day, self.has_swapped, self.has_secs, self.is_epoch, self.zoned, self.has_offset, self.numeric = (np.zeros(n, bool) for _ in range(7))


def _by_form(texts: pa.Array):
    """Bytes of the texts, and for each form among them the rows of that form and its spans."""
    raw, lengths = _bytes(texts)
    if not raw.size:
        return
    shaped = _CLASS[raw]
    key = shaped.astype(np.uint64) @ _MIX[: raw.shape[1]]
    _, example, form_of = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(form_of, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(form_of[order])) + 1):
        first = example[form_of[rows[0]]]
        if lengths[first] > LONGEST:
            continue
        spans = read_form(shaped[first, : lengths[first]].tobytes().decode("latin-1"))
        if spans:
            yield raw, rows, spans


def parse(texts: pa.Array) -> Parsed:
    """Reads each text (not null, trimmed)."""
    out = Parsed(len(texts))
    for raw, rows, spans in _by_form(texts):
        _fields(raw[rows], spans, rows, out)
    return out


#: Kinds of all-numeric dates by the orders of day and month that they can have.
DAY_FIRST, MONTH_FIRST, EITHER = "day-month-year", "month-day-year", "either order"
_PARTS = {"y": "year", "m": "month", "d": "day", "doy": "day of year", "name": "month name", "epoch": "epoch"}


def kinds(texts: pa.Array) -> np.ndarray:
    """The form of each text's date by its parts in order, all-numeric ones by their possible orders; none where it can't be read."""
    out, p = np.full(len(texts), None, object), parse(texts)
    for _, rows, spans in _by_form(texts):
        held = sorted((v[0], _PARTS[k]) for k, v in spans.items() if k in _PARTS)
        out[rows] = "-".join(n for _, n in held)
    both = p.has_day & p.has_swapped
    out[p.numeric] = np.where(both, EITHER, np.where(p.has_day, DAY_FIRST, np.where(p.has_swapped, MONTH_FIRST, None)))[p.numeric]
    out[~p.numeric & ~p.is_epoch & ~p.has_day] = None
    return out


def _fields(raw: np.ndarray, spans: dict, rows: np.ndarray, out: Parsed) -> None:
    value = lambda k, default=0: _number(raw, spans[k]) if k in spans else np.full(len(rows), default)
    if "epoch" in spans:
        size = spans["epoch"][1]
        out.epoch[rows], out.is_epoch[rows] = value("epoch") // (1 if size <= 10 else 1000 if size <= 13 else 1_000_000), True
        return
    year = value("y") + (2000 if spans["y"][1] - spans["y"][0] == 2 else 0)
    out.year[rows] = year
    if "doy" in spans:
        day, good = civil_days(year, np.ones_like(year), np.ones_like(year))
        last, _ = civil_days(year + 1, np.ones_like(year), np.ones_like(year))
        out.day[rows] = day + value("doy") - 1
        out.has_day[rows] = good & (value("doy") >= 1) & (out.day[rows] < last)
    elif "first" in spans:
        out.day[rows], out.has_day[rows] = civil_days(year, value("then"), value("first"))
        out.swapped[rows], out.has_swapped[rows] = civil_days(year, value("first"), value("then"))
        out.numeric[rows] = True
    else:
        if "name" in spans:
            a, b = spans["name"]
            month = _looked_up(raw[:, a : a + 3] | 32, (0, 3), {name: i + 1 for i, name in enumerate(MONTHS)}, 0)
        else:
            month = value("m")
        out.day[rows], out.has_day[rows] = civil_days(year, month, value("d"))
    if "h" in spans:
        hour, minute, second = value("h"), value("mi"), value("s")
        if "half" in spans:
            letter = raw[:, spans["half"][0]] | 32
            good = (hour >= 1) & (hour <= 12) & ((letter == ord("a")) | (letter == ord("p")))
            hour = hour % 12 + 12 * (letter == ord("p"))
        else:
            good = np.ones(len(rows), bool)
        for k, letter in (("mark", b"h"), ("tee", b"t")):
            if k in spans:
                good &= raw[:, spans[k][0]] | 32 == letter[0]
        if "part" in spans:
            second = value("part") * 3600 // 10 ** (spans["part"][1] - spans["part"][0])
            good &= (hour < 24) | (second == 0)
        else:
            good &= (minute < 60) & (second < 60) & ((hour < 24) | (minute + second == 0))
        out.secs[rows], out.has_secs[rows] = hour * 3600 + minute * 60 + second, good & (hour <= 24)
    if "prefix" in spans:
        out.zoned[rows] = True
        rows, raw = (x[_looked_up(raw, spans["prefix"], {"UTC": 1, "GMT": 1}, 0) == 1] for x in (rows, raw))
    if "sign" in spans:
        east = np.where(raw[:, spans["sign"][0]] == ord("+"), 1, -1)
        seconds = _number(raw, spans["oh"]) * 3600 + _number(raw, spans["om"]) * 60
        out.offset[rows], out.zoned[rows], out.has_offset[rows] = east * seconds, True, seconds <= 15 * 3600
    elif "letters" in spans:
        minutes = _looked_up(raw, spans["letters"], ZONE_MINUTES, 9999)
        out.offset[rows], out.zoned[rows], out.has_offset[rows] = minutes * 60, True, minutes != 9999


@lru_cache(maxsize=1000)
def transitions(zone: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray] | None:
    """UTC seconds from which an offset holds and the offsets, from year ``first`` to ``last``."""
    try:
        info = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None
    at = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(info).utcoffset().total_seconds())
    begin, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (first, last + 1))
    starts, offsets, step = [begin], [at(begin)], 7 * 86400
    for t in range(begin, end, step):
        if at(t + step) != offsets[-1]:
            low, high, old = t, t + step, offsets[-1]
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if at(middle) == old else (low, middle)
            starts.append(high)
            offsets.append(at(high))
    return np.array(starts), np.array(offsets)


def _wall(local: np.ndarray, year: np.ndarray, zone: str, standard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds and status of clock times in one zone."""
    status = np.full(len(local), RESOLVED)
    inside = (year > 1900) & (year < 2200)
    span = (int(min(1990, year[inside].min(initial=1990))) - 1, int(max(2040, year[inside].max(initial=2040))) + 1)
    table = transitions(zone, *span)
    if table is None:
        return local, np.full(len(local), NO_ZONE)
    starts, offsets = table
    at = lambda t: offsets[np.maximum(np.searchsorted(starts, t, "right") - 1, 0)]
    new_year, _ = civil_days(year, np.ones_like(year), np.ones_like(year))
    before, after = np.where(standard, new_year * 86400, local - 86400), np.where(standard, (new_year + 181) * 86400, local + 86400)
    one, two = at(before), at(after)
    fits_one, fits_two = at(local - one) == one, at(local - two) == two
    status[~standard & ~fits_one & ~fits_two] = NONEXISTENT
    status[~standard & fits_one & fits_two & (one != two)] = TWICE
    return local - np.where(standard, np.minimum(one, two), np.where(fits_one, one, two)), status


def instants(
    texts: pa.Array, share: np.ndarray, zones: pa.Array, clocks: pa.Array, min_share: float, min_posterior: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTC seconds (meaningful where resolved), status and posterior of written times.

    ``share``: fitted share of day-before-month dates in the row's source, NaN if unknown;
    ``zones``: IANA names; ``clocks``: ``utc``, ``standard`` or else the wall clock.
    """
    p = parse(texts)
    n = len(texts)
    share = np.where(np.isnan(share), 0.5, share)
    both = p.has_day & p.has_swapped & (p.day != p.swapped)
    posterior = np.where(both, np.maximum(share, 1 - share), 1.0)
    only_swapped = p.has_swapped & ~p.has_day
    swap = np.where(both, share < 0.5, only_swapped)
    unused = (only_swapped & (share > 1 - min_share)) | (p.has_day & ~p.has_swapped & (share < min_share) & p.numeric)
    day = np.where(swap, p.swapped, p.day)
    readable = (p.has_day | p.has_swapped) & ~unused & p.has_secs & (~p.zoned | p.has_offset)
    second, status = np.zeros(n, np.int64), np.full(n, UNREADABLE)
    local = day * 86400 + p.secs
    status[readable] = RESOLVED
    status[unused & p.has_secs & (~p.zoned | p.has_offset)] = OTHER_ORDER
    status[pc.greater(pc.binary_length(texts), LONGEST).fill_null(False).to_numpy(zero_copy_only=False)] = TOO_LONG
    clock = clocks.fill_null("wall").dictionary_encode()
    names = np.array(clock.dictionary.to_pylist() or [""], object)
    kind = names[clock.indices.to_numpy(zero_copy_only=False)]
    utc = readable & ~p.zoned & (kind == "utc")
    second[utc], second[p.is_epoch], status[p.is_epoch] = local[utc], p.epoch[p.is_epoch], RESOLVED
    fixed = readable & p.zoned
    second[fixed] = local[fixed] - p.offset[fixed]
    wall = readable & ~p.zoned & ~utc
    zone = zones.fill_null("").dictionary_encode()
    zone_at = zone.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(zone.dictionary.to_pylist()):
        rows = np.flatnonzero(wall & (zone_at == i))
        if len(rows):
            second[rows], status[rows] = _wall(local[rows], p.year[rows], name, kind[rows] == "standard")
    status[readable & both & (posterior < min_posterior)] = UNDECIDED
    return second, status, posterior


def joined(dates: pa.Array, hours: pa.Array | None) -> pa.Array:
    """Date and hour as one trimmed text, empty for nulls."""
    trim = lambda x: pc.utf8_trim_whitespace(x.cast(pa.string()).fill_null(""))
    return trim(dates) if hours is None else pc.utf8_trim_whitespace(pc.binary_join_element_wise(trim(dates), trim(hours), " "))
