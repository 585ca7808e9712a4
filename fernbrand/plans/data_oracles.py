"""DuckDB SQL for the queries on weather: written independently of the operators, with DuckDB's own parsing and time zones."""

from __future__ import annotations

from fernbrand.plans.constants import LIMITS, ORDINARY_RUNS

# Hours that zones are ahead of UTC, written out for the SQL alone.
ZONE_HOURS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3, "JST": 9, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13, "NST": -3.5, "NDT": -2.5,
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}

_ZONES = " ".join(f"when '{z}' then {int(h * 3600)}" for z, h in ZONE_HOURS.items())
_ZONE = r"(Z|[A-Z]{3}|[+-]\d{2}:?\d{2})(?:\[[^\]]*\])?$"
_OPEN = "['%Y-%m-%d %H:%M:%S','%Y-%m-%dT%H:%M:%S','%Y-%m-%d %H:%M','%Y-%m-%d %H','%Y/%m/%d %H:%M','%Y%m%d %H%M','%Y-%j %H%M','%Y-%m-%d %H%M','%d %b %Y %H','%d %b %Y %H:%M','%d-%b-%Y %H:%M','%b %d, %Y %I:%M %p','%a, %d %b %Y %H:%M:%S']"
_DMY = "['%d/%m/%Y %H','%d/%m/%Y %H:%M','%d/%m/%Y %I %p','%d.%m.%y %Hh%M','%d.%m.%Y %H:%M']"
_MDY = "['%m/%d/%Y %H','%m/%d/%Y %H:%M','%m/%d/%Y %I %p','%m.%d.%y %Hh%M']"


def _instants(rows: str, name: str) -> str:
    """CTEs that end in ``<name>``: rows (key, source, station, clock, t: whole text) with ``s``, the UTC second."""
    last = r"regexp_extract(t, '\d(?: ?)" + _ZONE + "', 1)"
    turn = lambda x: f"epoch(timezone(tz, to_timestamp({x})))"
    return rf"""
    {name}_o as (select source, count(*) filter (where try_cast(regexp_extract(t, '^(\d+)[/.]', 1) as int) > 12) > count(*) filter (where try_cast(regexp_extract(t, '^\d+[/.](\d+)', 1) as int) > 12) dmy
                 from ({rows}) where regexp_matches(t, '^\d{{1,2}}[/.]\d{{1,2}}[/.]\d+') group by 1),
    {name}_z as (select * exclude (t), t, case when regexp_matches(t, '^\d+$') then '' else {last} end z from ({rows})),
    {name}_b as (select *, regexp_replace(case when z = '' then t else regexp_replace(t, ' ?{_ZONE}', '') end, '(:\d{{2}}:\d{{2}})\.\d+$', '\1') b from {name}_z),
    {name}_d as (select {name}_b.*, dmy, regexp_matches(b, ' (24|24:00|2400)$') late, case when regexp_matches(b, ' \d{{1,2}}\.\d+$') then try_cast('0.' || regexp_extract(b, '\.(\d+)$', 1) as decimal(18, 9)) end part
                 from {name}_b left join {name}_o using (source)),
    {name}_c as (select *, case when late then regexp_replace(b, ' (24|24:00|2400)$', ' 00') when part is not null then regexp_replace(b, '\.\d+$', '') else b end c from {name}_d),
    {name}_l as (select *, epoch(coalesce(try_strptime(c, {_OPEN}), case when dmy then try_strptime(c, {_DMY}) else try_strptime(c, {_MDY}) end)) + case when late then 86400 else 0 end + coalesce(floor(part * 3600), 0) l from {name}_c),
    {name}_t as (select {name}_l.*, time_zone tz from {name}_l left join (select station_code, min(time_zone) time_zone from station group by 1) g on g.station_code = station),
    {name}_u as (select *, case when z = '' and clock = 'wall' and tz is not null then epoch(timezone(tz, make_timestamp((l * 1e6)::bigint))) end u from {name}_t),
    {name} as (select key, station, s::bigint s from (select *, case when regexp_matches(t, '^\d{{9,10}}$') then t::bigint when regexp_matches(t, '^\d{{12,13}}$') then t::bigint // 1000
        when l is null then null when z like '+%' or z like '-%' then l - (case when z[1] = '+' then 1 else -1 end) * (z[2:3]::int * 3600 + right(z, 2)::int * 60)
        when z <> '' then l - (case z {_ZONES} end) when clock = 'utc' then l when tz is null then null
        when clock = 'standard' then l - (select min(o) from (select {turn("epoch(make_timestamp(year(make_timestamp((l * 1e6)::bigint)), m, 1, 0, 0, 0))")} - epoch(make_timestamp(year(make_timestamp((l * 1e6)::bigint)), m, 1, 0, 0, 0)) o from (values (1), (7)) v(m)))
        when {turn('u')} <> l or {turn('u + 3600')} = l or {turn('u - 3600')} = l then null else u end s from {name}_u) where s is not null)"""


_CLOCK = r"case when regexp_matches(lower(coalesce(remarks, '')), '\b(utc|gmt|zulu|greenwich|universal time)\b') then 'utc' when regexp_matches(lower(coalesce(remarks, '')), '\bstandard time\b') then 'standard' else 'wall' end"
_WEATHER = f"select obs_id key, w.feed_id source, station_code station, coalesce({_CLOCK}, 'wall') clock, trim(trim(coalesce(obs_date, '')) || ' ' || trim(coalesce(obs_hour, ''))) t from weather w left join weather_feed f on f.feed_id = w.feed_id"
_RECORD = "select record_id key, station_code source, station_code station, 'wall' clock, trim(coalesce(obs_datetime, '')) t from weather_record"

_NUMBER = "try_cast(replace(replace(regexp_extract(trim({c}), '^[-+−]?[0-9]+(?:[.,][0-9]+)?'), ',', '.'), '−', '-') as double)"
_UNIT = {
    "temperature": ("case when {x} in ('c','degc','°c') then 'C' when {x} in ('f','degf','°f') then 'F' when {x} in ('k') then 'K' end",
                    "case when regexp_matches({n}, 'fahrenheit|deg ?f') then 'F' when regexp_matches({n}, 'kelvin|\\[k\\]|=k/') then 'K' when regexp_matches({n}, 'celsius|deg ?c') then 'C' end",
                    "case {u} when 'F' then ({v} - 32e0) * 5e0 / 9e0 when 'K' then {v} - 273.15e0 else {v} end", "C"),
    "wind_speed": ("case when {x} in ('m/s','mps') then 'm/s' when {x} in ('mph','mi/h') then 'mph' when {x} in ('kts','kt','kn','knots') then 'kn' when {x} in ('kph','km/h') then 'km/h' end",
                   "case when regexp_matches({n}, 'miles per hour|mph') then 'mph' when regexp_matches({n}, 'metres per second|m/s') then 'm/s' when regexp_matches({n}, 'knots|\\bkn\\b') then 'kn' end",
                   "case {u} when 'm/s' then {v} * 3.6e0 when 'mph' then {v} * 1.609344e0 when 'kn' then {v} * 1.852e0 else {v} end", "km/h"),
    "precipitation": ("case when {x} in ('in','inches','\"') then 'in' when {x} = 'cm' then 'cm' when {x} = 'mm' then 'mm' end",
                      "case when regexp_matches({n}, 'hundredths of an inch') then 'h' when regexp_matches({n}, 'tenths of a millimetre') then 't' when regexp_matches({n}, 'millimetre|\\bmm\\b') then 'mm' when regexp_matches({n}, '\\binch(es)?\\b|\\[in\\]|/in$') then 'in' end",
                      "case {u} when 'in' then {v} * 25.4e0 when 'cm' then {v} * 10e0 when 'h' then {v} * 0.254e0 when 't' then {v} * 0.1e0 else {v} end", "mm"),
}


def _values(field: str) -> str:
    """SQL: obs_id, unit and thousandths of each readable value of a field."""
    own, named, common, usual = _UNIT[field]
    text = f"replace(replace(lower(regexp_replace(trim({field}), '^[-+−]?[0-9]+(?:[.,][0-9]+)?', '')), ' ', ''), '.', '')"
    inner = f"select obs_id, {_NUMBER.format(c=field)} v, {text} x, lower(coalesce(unit_note, '')) n, lower(coalesce(remarks, '')) r from weather w left join weather_feed f on f.feed_id = w.feed_id"
    unit = f"case when x <> '' then {own.format(x='x')} else coalesce({named.format(n='n')}, {named.format(n='r')}, '{usual}') end"
    return f"(select obs_id, u, round({common.format(u='u', v='v')} * 1000)::bigint milli from (select obs_id, v, {unit} u from ({inner}) where v is not null) where u is not null)"


_ROWS = f"""w as materialized (select station_code, logger_id, s, {{fields}} from weather join p on key = weather.obs_id {{joins}})"""


def _readings(fields: dict[str, str]) -> str:
    joins = " ".join(f"left join {_values(f)} {a} on {a}.obs_id = weather.obs_id" for f, a in fields.items())
    return f"with {_instants(_WEATHER, 'p')}, " + _ROWS.format(fields=", ".join(f"{a}.milli {a}m" for a in fields.values()), joins=joins)


_P3 = _readings({"temperature": "t", "wind_speed": "v"}) + """,
    h as (select distinct station_code, logger_id, s // 3600 h from w where tm is not null and vm is not null),
    g as (select station_code, logger_id, unnest(range(min(h), max(h) + 1)) h from h group by 1, 2)
    select station_code, logger_id, h * 3600 utc_hour_start from g where not exists (select 1 from h where h.station_code is not distinct from g.station_code and h.logger_id is not distinct from g.logger_id and h.h = g.h)"""

_P5 = _readings({"precipitation": "p", "temperature": "t"}).replace("join p on key", "join p on p.key") + """,
    o as (select station_code, logger_id, s // 86400 d, pm, tm from (select station_code, logger_id, s, max(pm) pm, max(tm) tm from w group by 1, 2, 3)),
    d as (select station_code, logger_id, d, coalesce(sum(pm), 0) p, coalesce(sum(tm), 0) t, count(tm) n from o group by 1, 2, 3),
    g as (select station_code, logger_id, min(d) a, unnest(range(min(d), max(d) + 1)) d from d group by 1, 2),
    k as (select g.*, sum(coalesce(p, 0)) over (x rows 6 preceding) p7, sum(coalesce(p, 0)) over (x rows 29 preceding) p30, sum(coalesce(t, 0)) over (x rows 6 preceding) t7, sum(coalesce(n, 0)) over (x rows 6 preceding) n7
          from g left join d using (station_code, logger_id, d) window x as (partition by station_code, logger_id order by d))
    select station_code, logger_id, strftime(make_date(d::int), '%Y-%m-%d') utc_day, kind from k, (values ('wet7'), ('dry30')) v(kind)
    where case kind when 'wet7' then p7 >= 40000 else p30 < 1000 and d - a >= 29 and n7 > 0 and t7 >= 20000 * n7 end"""


def _flags(field: str) -> str:
    low, high = LIMITS[field]
    series = f"(select station, s, max(round({field} * 1000)::bigint) v from r where s is not null and {field} is not null and not isnan({field}) group by 1, 2)"
    numbered = f"(select *, row_number() over x i, v - lag(v) over x step, s // 3600 - lag(s // 3600) over x gap from {series} window x as (partition by station order by s))"
    facts = f"(select station, median(abs(step)) filter (where gap = 1) change, median(v) filter (where v > 0) positive from {numbered} group by 1)"
    if field == "precipitation":
        jumps = f"select station, s from {numbered} join {facts} using (station) where v > 8 * positive"
    else:
        spans = " union all ".join(
            f"select station, i, {k} k, list_min([v{''.join(f', lead(v, {j}) over x' for j in range(1, k))}]) lo, list_max([v{''.join(f', lead(v, {j}) over x' for j in range(1, k))}]) hi, lag(v) over x b, lead(v, {k}) over x a from {numbered} window x as (partition by station order by s)"
            for k in (1, 2, 3)
        )
        height = "greatest(lo - greatest(a, b), least(a, b) - hi)"
        jumps = f"select n.station, n.s from {numbered} n join (select * from ({spans}) join {facts} using (station) where a is not null and b is not null and {height} > 0 and {height} >= 8 * change) j on j.station = n.station and n.i >= j.i and n.i < j.i + k"
    usual = f"v <> {int(ORDINARY_RUNS[field] * 1000)}" if field in ORDINARY_RUNS else "true"
    runs = f"select station, s from (select *, count(*) over (partition by station, v, g) n from (select *, i - row_number() over (partition by station, v order by s) g from {numbered})) where n >= 10 and {usual}"
    return f"""select record_id, '{field}' field_name from r where {field} is not null and not isnan({field}) and ({field} < {low}e0 or {field} > {high}e0
        or (station, s) in (select station, s from ({jumps} union {runs})))"""


ORACLES = {
    "p1_found": f"with {_instants(_WEATHER, 'a')}, {_instants(_RECORD, 'b')} select 'weather' table_name, key row_id, s utc_second from a union all select 'weather_record', key, s from b",
    "p3_found": _P3,
    "p4_found": " union all ".join(f"select obs_id, '{f}' field_name, milli common_milli from {_values(f)} where u <> '{_UNIT[f][3]}'" for f in _UNIT),
    "p5_found": _P5,
    "p6_found": f"with {_instants(_RECORD, 'b')}, r as materialized (select weather_record.*, station_code station, s from weather_record left join b on key = record_id) " + " union all ".join(map(_flags, LIMITS)),
}
