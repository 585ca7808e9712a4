"""Queries of the fire-weather and fire-growth operators, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand.functions import fwi, ros
from fernbrand.operators import cells as grid
from fernbrand.operators import climate, fires, fireweather, ignitions
from fernbrand.plans import constants
from fernbrand.plans.fixtures import duck, load

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LEFT, TOP, SIZE = 0.0, 0.0, 30.0


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _r(c, name: str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + 0.0, digits).alias(name)


def _rounded(names: str, digits: int = 6) -> str:
    """SQL that rounds the named columns."""
    return ", ".join(f"round({n} + 0e0, {digits}) {n}" for n in names.split())


# --- fire-weather indices -------------------------------------------------------------------

_FFMC = "(60e0 + (event_id % 40))"
_MO = "(147.2e0 * (101e0 - {f}) / (59.5e0 + {f}))"
_ISI = "(0.208e0 * 91.9e0 * exp(-0.1386e0 * {m}) * (1e0 + power({m}, 5.31e0) / 4.93e7) * exp(0.05039e0 * {w}))"


@query(f"select event_id, round({_ISI.format(m=_MO.format(f=_FFMC), w='ws')}, 6) isi from {duck('obs')}")
def fwi_isi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "obs").select("event_id", _r(fwi.isi_or_zero(60.0 + F.col("event_id") % 40, F.col("ws")), "isi"))


_BUI = "case when p = 0 and c = 0 then 0e0 when p <= 0.4e0 * c then 0.8e0 * p * c / (p + 0.4e0 * c) else p - (1e0 - 0.8e0 * c / (p + 0.4e0 * c)) * (0.92e0 + power(0.0114e0 * p, 1.7e0)) end"
_FWI = "case when b > 1 then exp(2.72e0 * power(0.434e0 * ln(b), 0.647e0)) else b end"
_FD = "case when bui <= 80 then 0.626e0 * power(bui, 0.809e0) + 2e0 else 1000e0 / (25e0 + 108.64e0 * exp(-0.023e0 * bui)) end"


@query(f"""with o as (select event_id, isi, (event_id % 90) * 1e0 p, (event_id % 400) * 1e0 c from {duck('obs')}),
    u as (select *, {_BUI} bui from o), v as (select *, 0.1e0 * isi * ({_FD}) b from u), w as (select *, {_FWI} fwi from v)
    select event_id, round(bui, 6) bui, round(fwi, 6) fwi, round(0.0272e0 * power(fwi, 1.77e0), 6) dsr from w""")
def fwi_bui_fwi_dsr(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "obs").withColumn("bui", fwi.bui(F.col("event_id") % 90 * 1.0, F.col("event_id") % 400 * 1.0))
    o = o.withColumn("fwi", fwi.fwi(F.col("isi"), F.col("bui")))
    return o.select("event_id", _r("bui", "bui"), _r("fwi", "fwi"), _r(fwi.dsr(F.col("fwi")), "dsr"))


def _sql_ffmc(t: str, h: str, w: str, p: str, f: str) -> str:
    """One day's fine fuel moisture code in SQL."""
    mo = f"(select case when {p} > 0.5e0 then least(250e0, m0 + 42.5e0 * ({p} - 0.5e0) * exp(-100e0 / (251e0 - m0)) * (1e0 - exp(-6.93e0 / ({p} - 0.5e0))) + case when m0 > 150 then 0.0015e0 * (m0 - 150) * (m0 - 150) * sqrt({p} - 0.5e0) else 0e0 end) else m0 end from (select {_MO.format(f=f)} m0))"
    both = f"0.18e0 * (21.1e0 - {t}) * (1e0 - exp(-0.115e0 * {h}))"
    k = "(0.424e0 * (1e0 - power({x}, 1.7e0)) + 0.0694e0 * sqrt({w}) * (1e0 - power({x}, 8e0))) * 0.581e0 * exp(0.0365e0 * {t})"
    dry, wet = k.format(x=f"({h} / 100e0)", w=w, t=t), k.format(x=f"((100e0 - {h}) / 100e0)", w=w, t=t)
    left = f"case when mo > ed then ed + (mo - ed) * power(10e0, -({dry})) when mo < ew then ew - (ew - mo) * power(10e0, -({wet})) else mo end"
    ends = f"0.942e0 * power({h}, 0.679e0) + 11e0 * exp(({h} - 100e0) / 10e0) + {both} ed, 0.618e0 * power({h}, 0.753e0) + 10e0 * exp(({h} - 100e0) / 10e0) + {both} ew"
    return f"(select least(101e0, greatest(0e0, 59.5e0 * (250e0 - ml) / (147.2e0 + ml))) from (select {left} ml from (select {mo} mo, {ends})))"


def _sql_dmc(t: str, h: str, p: str, d: str, month: str) -> str:
    b = f"case when {d} <= 33 then 100e0 / (0.5e0 + 0.3e0 * {d}) when {d} <= 65 then 14e0 - 1.3e0 * ln({d}) else 6.2e0 * ln({d}) - 17.2e0 end"
    rain = f"greatest(0e0, 244.72e0 - 43.43e0 * ln(exp(5.6348e0 - {d} / 43.43e0) + 1000e0 * (0.92e0 * {p} - 1.27e0) / (48.77e0 + ({b}) * (0.92e0 * {p} - 1.27e0))))"
    day = f"(case {month} " + " ".join(f"when {i + 1} then {v}e0" for i, v in enumerate(constants.DMC_DAY)) + " end)"
    return f"(case when {p} > 1.5e0 then {rain} else {d} end + case when {t} > -1.1e0 then 100e0 * 1.894e0 * ({t} + 1.1e0) * (100e0 - {h}) * {day} * 1e-6 else 0e0 end)"


def _sql_dc(t: str, p: str, d: str, month: str) -> str:
    day = f"(case {month} " + " ".join(f"when {i + 1} then {v}e0" for i, v in enumerate(constants.DC_DAY)) + " end)"
    rain = f"greatest(0e0, 400e0 * ln(800e0 / (800e0 * exp(-{d} / 400e0) + 3.937e0 * (0.83e0 * {p} - 1.27e0))))"
    return f"(case when {p} > 2.8e0 then {rain} else {d} end + 0.5e0 * case when {t} > -2.8e0 then greatest(0e0, 0.36e0 * ({t} + 2.8e0) + {day}) else 0e0 end)"


@query(f"""select event_id, round({_sql_ffmc('temp', 'rh', 'ws', 'precip', _FFMC)}, 6) ffmc,
    round({_sql_dmc('temp', 'rh', 'precip', '((event_id % 90) * 1e0)', 'month(obs_date)')}, 6) dmc,
    round({_sql_dc('temp', 'precip', '((event_id % 400) * 1e0)', 'month(obs_date)')}, 6) dc from {duck('obs')}""")
def fwi_codes_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, month = load(spark, sf_dir, "obs"), F.month("obs_date")
    t, h, w, p = (F.col(c) for c in ("temp", "rh", "ws", "precip"))
    return o.select("event_id", _r(fwi.ffmc_step(t, h, w, p, 60.0 + F.col("event_id") % 40), "ffmc"), _r(fwi.dmc_step(t, h, p, F.col("event_id") % 90 * 1.0, month), "dmc"),
                    _r(fwi.dc_step(t, p, F.col("event_id") % 400 * 1.0, month), "dc"))


_INDICES = f"""select {{keys}}, round(ffmc, 4) ffmc, round(dmc, 4) dmc, round(dc, 4) dc, round(isi, 4) isi, round(bui, 4) bui, round(fwi, 4) fwi, round(0.0272e0 * power(fwi, 1.77e0), 4) dsr
    from (select *, {_FWI} fwi from (select *, 0.1e0 * isi * ({_FD}) b from (select *, {_ISI.format(m=_MO.format(f='ffmc'), w='ws')} isi, {_BUI.replace('case when p = 0 and c = 0', 'case when dmc = 0 and dc = 0').replace(' p ', ' dmc ').replace(' c ', ' dc ').replace('* c', '* dc').replace('* p', '* dmc').replace('else p', 'else dmc').replace('(p ', '(dmc ')} bui from ({{r}}))))"""


@query(f"""with recursive d as (select *, row_number() over (partition by station_code order by obs_date) i from {duck('daily')}),
    r as (select d.station_code, d.obs_date, d.i, {_sql_ffmc('d.temp', 'd.rh', 'd.ws', 'd.precip', '85e0')} ffmc,
            {_sql_dmc('d.temp', 'd.rh', 'd.precip', '6e0', 'month(d.obs_date)')} dmc, {_sql_dc('d.temp', 'd.precip', '15e0', 'month(d.obs_date)')} dc from d where i = 1
          union all select d.station_code, d.obs_date, d.i, {_sql_ffmc('d.temp', 'd.rh', 'd.ws', 'd.precip', 'r.ffmc')},
            {_sql_dmc('d.temp', 'd.rh', 'd.precip', 'r.dmc', 'month(d.obs_date)')}, {_sql_dc('d.temp', 'd.precip', 'r.dc', 'month(d.obs_date)')}
          from r join d on d.station_code = r.station_code and d.i = r.i + 1)
    {_INDICES.format(r='select r.*, ws from r join d using (station_code, obs_date)', keys='station_code, obs_date')}""")
def fwi_daily_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fireweather.recurrence(load(spark, sf_dir, "daily"), ["station_code"])
    return days.select("station_code", "obs_date", *[_r(c, c, 4) for c in fireweather.CODES])


# --- weather --------------------------------------------------------------------------------


@query(f"select station_code, obs_date, {_rounded('temp rh ws wd')} from (select station_code, obs_date, avg(temp) temp, avg(rh) rh, avg(ws) ws, avg(wd) wd from {duck('obs')} where obs_hour = 12 group by 1, 2)")
def weather_daily_noon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.noon_rows(load(spark, sf_dir, "obs"), ["station_code"]).select("station_code", "obs_date", *[_r(c, c) for c in fireweather.MEASURES])


@query(f"select station_code, obs_date, {_rounded('isi temp rh ws wd')} from (select station_code, obs_date, max(isi) isi, avg(temp) temp, avg(rh) rh, avg(ws) ws, avg(wd) wd from {duck('obs')} group by 1, 2)")
def weather_daily_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.daily_max(load(spark, sf_dir, "obs"), ["station_code"]).select("station_code", "obs_date", *[_r(c, c) for c in ("isi", *fireweather.MEASURES)])


@query(f"select station_code, obs_date, round(sum(precip), 6) precip_24h from {duck('obs')} group by 1, 2")
def weather_rain_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.rain_24h(load(spark, sf_dir, "obs"), ["station_code"]).select("station_code", "obs_date", _r("precip_24h", "precip_24h"))


_CLASS = "case when isi >= 12.6e0 then 'extreme' when isi >= 8.6e0 then 'high' else 'moderate' end"


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "obs").withColumn("category", fireweather.category(F.col("isi")))


@query(f"select station_code, {_CLASS} category, count(*) n, round(median(isi), 6) median_isi from {duck('obs')} group by 1, 2")
def weather_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).groupBy("station_code", "category").agg(F.count("*").alias("n"), _r(F.expr("percentile(isi, 0.5)"), "median_isi"))


@query(f"select event_id, {_CLASS} category from {duck('obs')} where {_CLASS} in ('high', 'extreme')")
def weather_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.keep_categories(_classed(spark, sf_dir), ["high", "extreme"]).select("event_id", "category")


@query(f"select o.event_id, o.station_code, s.n_fires from {duck('obs')} o left join (select 'view' station_code, count(*) n_fires from supplier) s on s.station_code = o.station_code")
def weather_station_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    station = load(spark, sf_dir, "ignitions").agg(F.count("*").alias("n_fires")).withColumn("station_code", F.lit("view"))
    return fireweather.with_station(load(spark, sf_dir, "obs"), station).select("event_id", "station_code", "n_fires")


@query(f"""with o as (select *, {_CLASS} category from {duck('obs')}), h as (select * from o where category in ('high', 'extreme'))
    select round(median(temp), 6) temp, round(median(rh), 6) rh, round(median(ws), 6) ws, round(median(wd), 6) wd, round(median(isi), 6) isi from h""")
def weather_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.representative(_classed(spark, sf_dir)).select(*[_r(c, c) for c in ("temp", "rh", "ws", "wd", "isi")])


_SECOND = "cast(floor(epoch(ts)) as bigint)"
_SPAN = f"(select min({_SECOND}) // 1800 * 1800 lo, max({_SECOND}) hi from {duck('obs')})"


@query(f"""with o as (select station_code, {_SECOND} s, max({{'t': temp, 'h': rh, 'd': wd}}) v from {duck('obs')} group by 1, 2),
    p as (select *, lead(s) over w s1, lead(v) over w v1, row_number() over w i from o window w as (partition by station_code order by s)),
    k as (select step::int step, lo + step * 1800 at_second from (select lo, unnest(range((hi - lo) // 1800 + 2)) step from {_SPAN})),
    j as (select station_code, step, at_second, v, coalesce(v1, v) v1, case when s1 is null or at_second <= s then 0e0 else (at_second - s) * 1e0 / (s1 - s) end w
          from p join k on (at_second > s or i = 1) and (s1 is null or at_second <= s1)),
    a as (select *, degrees(atan2(sin(radians(v.d)) * (1 - w) + sin(radians(v1.d)) * w, cos(radians(v.d)) * (1 - w) + cos(radians(v1.d)) * w)) d from j)
    select station_code, step, at_second, round(v.t * (1 - w) + v1.t * w, 6) temp, round(v.h * (1 - w) + v1.h * w, 6) rh, round(case when d < 0 then d + 360e0 else d end, 5) wd from a""")
def weather_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = load(spark, sf_dir, "obs").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    span = obs.agg(F.min("second").alias("lo"), F.max("second").alias("hi")).first()
    first, last = (span["lo"] or 0) // 1800 * 1800, span["hi"] or 0
    out = fireweather.interpolate(obs, ["station_code"], "second", ["temp", "rh"], ["wd"], first, 1800, (last - first) // 1800 + 2)
    return out.select("station_code", "step", F.col("second").cast("long").alias("at_second"), _r("temp", "temp"), _r("rh", "rh"), _r("wd", "wd", 5))


_UNIFORM = "((('0x' || substr(md5({key}), 1, 12))::bigint + 0.5e0) / 281474976710656e0)"
# Poisson of mean 3.76 by inversion: a step for each cumulative share that the number is above.
_POISSON = "(1 + " + " + ".join(f"(u > {sum(2.718281828459045**-3.76 * 3.76**j / math.factorial(j) for j in range(k + 1))!r}e0)::int" for k in range(1, 60)) + ")"


@query(f"select event_id, {_POISSON} event_days from (select event_id, {_UNIFORM.format(key="'0:' || event_id")} u from {duck('obs')})")
def spread_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.spread_event_days(load(spark, sf_dir, "obs"), F.col("event_id")).select("event_id", "event_days")


@query(f"select event_id, station_code from {duck('obs')} order by {_UNIFORM.format(key="'0:' || event_id")}, event_id limit 500")
def weather_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.sample_rows(load(spark, sf_dir, "obs"), 500, F.col("event_id")).select("event_id", "station_code")


# --- rates of spread ------------------------------------------------------------------------


def _sql_ros(fuel: str, isi: str = "isi", bui: str = "bui", curing: str = "85e0", share: str = "0.5e0") -> str:
    if fuel[0] == "M":
        leafy = f"{1 if fuel in ('M-1', 'M-3') else 0.2}e0 * {_sql_ros('D-1', isi, bui)}"
        other = _sql_ros("C-2", isi, bui) if fuel < "M-3" else f"120e0 * power(1e0 - exp(-0.0572e0 * {isi}), 1.4e0)"
        return f"({share} * {other} + (1e0 - {share}) * {leafy})"
    a, b, c, start, q, p, k1, k2 = constants.CURVES[fuel]
    rate = f"{a}e0 * power(1e0 - exp(-{b}e0 * {isi}), {c}e0)"
    if start is None:
        grass = f"least(1e0, greatest(0e0, case when {curing} < 58.8e0 then 0.005e0 * (exp(0.061e0 * {curing}) - 1e0) else 0.176e0 + 0.02e0 * ({curing} - 58.8e0) end))"
        return f"({rate} * {grass})"
    if fuel == "C-6":
        crown = "greatest(0e0, 1000e0 * power(1.5e0 - 0.275e0, 4e0) / (460e0 + 2590e0))"
        rate = f"({rate} + least(1e0, greatest(0e0, 1e0 - exp(-0.23e0 * greatest(0e0, {rate} - 10e0)))) * {crown})"
    big = f"{q}e0 * power({bui} - {start}, {p}e0)"
    return f"({rate} * case when {bui} > {start} then exp({k1}e0 * ln({big}) / ({k2}e0 + {big})) else 1e0 end)"


_WEATHER = "select event_id, isi, (event_id % 120) * 1e0 bui from " + duck("obs")


@query(" union all ".join(f"select event_id, '{f}' fuel, round({_sql_ros(f)}, 6) head_ros from ({_WEATHER})" for f in constants.FUELS))
def ros_all_fuels(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = load(spark, sf_dir, "obs").select("event_id", "isi", (F.col("event_id") % 120 * 1.0).alias("bui"))
    return grid.fuel_rates(weather).select("event_id", "fuel", _r("head_ros", "head_ros"))


@query(f"select event_id, round(0.2e0 * h, 6) back_ros, round(1.2e0 * h / 4e0, 6) flank_ros, round((wd + 180e0) % 360e0, 6) azimuth from (select event_id, wd, {_sql_ros('C-3', bui='80e0')} h from {duck('obs')})")
def ros_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "obs").withColumn("h", ros.head_ros("C-3", F.col("isi"), F.lit(80.0)))
    back = ros.back_ros(F.col("h"))
    return o.select("event_id", _r(back, "back_ros"), _r(ros.flank_ros(F.col("h"), back), "flank_ros"), _r(ros.azimuth(F.col("wd")), "azimuth"))


@query(f"select event_id, round({_sql_ros('O-1A', curing='rh')}, 6) o1a, round({_sql_ros('O-1B', curing='rh')}, 6) o1b from {duck('obs')}")
def ros_grass_curing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda f: ros.head_ros(f, F.col("isi"), F.lit(80.0), curing=F.col("rh"))
    return load(spark, sf_dir, "obs").select("event_id", _r(rate("O-1a"), "o1a"), _r(rate("o-1b"), "o1b"))


@query("select event_id, " + ", ".join(f"round({_sql_ros(f, bui='80e0', share='(rh / 100e0)')}, 6) {f.lower().replace('-', '')}" for f in ("M-1", "M-2", "M-3", "M-4")) + f" from {duck('obs')}")
def ros_mixedwood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = lambda f: ros.head_ros(f, F.col("isi"), F.lit(80.0), conifer=F.col("rh"), dead_fir=F.col("rh"))
    return load(spark, sf_dir, "obs").select("event_id", *[_r(rate(f), f.lower().replace("-", "")) for f in ("M-1", "M-2", "M-3", "M-4")])


_BY_FUEL = "case fuel_id " + " ".join(f"when {code} then {_sql_ros(f, '10e0', '80e0')}" for code, f in constants.FUEL_CODES.items()) + " else 0e0 end"


@query(f"select grid_row, grid_col, round({_BY_FUEL}, 6) head_ros from {duck('cells')}")
def ros_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    weather = spark.range(1).select(F.lit(10.0).alias("isi"), F.lit(80.0).alias("bui"))
    rates = grid.fuel_rates(weather).select("fuel", "head_ros")
    cells = load(spark, sf_dir, "cells").withColumn("_f", ros.fuel_name(F.col("fuel_id")))
    return cells.join(F.broadcast(rates), F.col("_f") == F.col("fuel"), "left").select("grid_row", "grid_col", _r(F.coalesce("head_ros", F.lit(0.0)), "head_ros"))


# --- terrain and cells ----------------------------------------------------------------------

_DX = "case when lag(elev) over c is null then (lead(elev) over c - elev) / 30e0 when lead(elev) over c is null then (elev - lag(elev) over c) / 30e0 else (lead(elev) over c - lag(elev) over c) / 60e0 end"
_SLOPE = f"""(select *, least(90e0, greatest(0e0, degrees(atan(sqrt(dx * dx + dr * dr))))) slope_deg,
    case when sqrt(dx * dx + dr * dr) >= 1e-6 then (degrees(atan2(dx, -dr)) + 360e0) % 360e0 end aspect_deg
    from (select *, {_DX} dx, {_DX.replace('over c', 'over r')} dr from {duck('cells')}
          window c as (partition by grid_row order by grid_col), r as (partition by grid_col order by grid_row)))"""


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.slope_aspect(load(spark, sf_dir, "cells"), "elev", SIZE)


@query(f"select grid_row, grid_col, round(slope_deg, 6) slope_deg, round(aspect_deg, 6) aspect_deg from {_SLOPE}")
def terrain_slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terrain(spark, sf_dir).select("grid_row", "grid_col", _r("slope_deg", "slope_deg"), _r("aspect_deg", "aspect_deg"))


@query(f"select case when slope_deg < 5 then '0-5' when slope_deg < 15 then '5-15' when slope_deg < 30 then '15-30' when slope_deg < 45 then '30-45' else '45+' end slope_class, count(*) n_cells from {_SLOPE} group by 1")
def slope_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.slope_histogram(_terrain(spark, sf_dir))


_SF = "coalesce(case when {s} < 0 then 0e0 else {s} end, 1e0)"
_RAWSF = "(1e0 + 0.5e0 * tan(radians(slope_deg)) * cos(radians({wd} - (aspect_deg + 180e0))))"


@query(f"select grid_row, grid_col, round({_SF.format(s=_RAWSF.format(wd='225e0'))}, 6) factor from {_SLOPE}")
def slope_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terrain(spark, sf_dir).select("grid_row", "grid_col", _r(ros.slope_factor(F.col("slope_deg"), F.col("aspect_deg"), F.lit(225.0)), "factor"))


_EF = "least(1.3e0, greatest(0.7e0, 1e0 - 0.002e0 * ({t} - 0.0065e0 * elev - 20e0) + 0.001e0 * ({h} - 30e0)))"


@query(f"select grid_row, grid_col, round({_EF.format(t='28e0', h='35e0')}, 6) factor from {duck('cells')}")
def elevation_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "cells").select("grid_row", "grid_col", _r(ros.elevation_factor(F.col("elev"), F.lit(28.0), F.lit(35.0)), "factor"))


@query(f"""with c as {duck('cells')}, t as (select grid_row, grid_col, x * 0.8e0 + 7e0 x, y * 0.8e0 - 7e0 y from c)
    select t.grid_row, t.grid_col, c.fuel_id source_fuel_id from t left join c on c.grid_row = floor(-t.y / 30e0) and c.grid_col = floor(t.x / 30e0)""")
def fuel_resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "cells")
    target = cells.select("grid_row", "grid_col", (F.col("x") * 0.8 + 7.0).alias("x"), (F.col("y") * 0.8 - 7.0).alias("y"))
    return grid.resample_nearest(target, cells, "fuel_id", LEFT, TOP, SIZE).select("grid_row", "grid_col", "source_fuel_id")


_A, _B = (0.0, -15.0), (1500.0, -465.0)
_ALONG = "least(1e0, greatest(0e0, ((x - 0e0) * 1500e0 + (y + 15e0) * -450e0) / (1500e0 * 1500e0 + 450e0 * 450e0)))"
_BREAK = f"(power(x - {_ALONG} * 1500e0, 2e0) + power(y + 15e0 + {_ALONG} * 450e0, 2e0) <= 2025e0 and fuel_id not in (0, 101, 102, 106, -9999))"


def _mask() -> Column:
    return grid.near_segment(F.col("x"), F.col("y"), *_A, *_B, 45.0)


@query(f"select grid_row, grid_col, case when {_BREAK} then 102 else fuel_id end fuel_id from {duck('cells')}")
def fuel_break_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fuel_break(load(spark, sf_dir, "cells"), _mask(), "fuel_code", 102).select("grid_row", "grid_col", "fuel_id")


@query(f"select grid_row, grid_col, {_BREAK} zero_ros from {duck('cells')}")
def fuel_break_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.fuel_break(load(spark, sf_dir, "cells"), _mask(), "zero_ros").select("grid_row", "grid_col", "zero_ros")


def _timeline(spark: SparkSession, steps: int) -> DataFrame:
    return spark.range(steps).select(
        F.col("id").cast("int").alias("step"), (8.0 + F.col("id")).alias("isi"), (60.0 + F.col("id") * 5).alias("bui"), (F.col("id") * 40.0).alias("wd"),
        (20.0 + F.col("id")).alias("temp"), (40.0 - F.col("id")).alias("rh"))


def _cube(spark: SparkSession, sf_dir: str, steps: int) -> DataFrame:
    cells = grid.fuel_break(_terrain(spark, sf_dir), _mask(), "zero_ros")
    return grid.spread_grid(cells, _timeline(spark, steps))


_CUBE_HEAD = f"case when {_BREAK} then 0e0 else (case fuel_id " + " ".join(f"when {code} then {_sql_ros(f, 'isi', 'bui')}" for code, f in constants.FUEL_CODES.items()) + f" else 0e0 end) * {_SF.format(s=_RAWSF.format(wd='wd'))} end * {_EF.format(t='temp', h='rh')}"


@query(f"""select grid_row, grid_col, step, round(h, 6) head_ros, round(0.2e0 * h, 6) back_ros, round(0.3e0 * h, 6) flank_ros, round((wd + 180e0) % 360e0, 6) azimuth from (
    select *, {_CUBE_HEAD} h from {_SLOPE} cross join (select range::int step, 8e0 + range isi, 60e0 + range * 5 bui, range * 40e0 wd, 20e0 + range temp, 40e0 - range rh from range(4)))""")
def ros_cube_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cube(spark, sf_dir, 4).select("grid_row", "grid_col", "step", *[_r(c, c) for c in ("head_ros", "back_ros", "flank_ros", "azimuth")])


@query(f"""with c as {duck('cells')}, m as (select max(grid_row) + 1 nr from c),
    p as (select fire_id, vertex_id, x, y, least(49e0 - 1e-6, greatest(0e0, x / 30e0 - 0.5e0)) fx, least(nr - 1 - 1e-6, greatest(0e0, -y / 30e0 - 0.5e0)) fy from {duck('ring')} cross join m),
    k as (select *, (case when i = 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case when j = 1 then fx - floor(fx) else 1 - fx + floor(fx) end) w from p, (values (0), (1)) a(i), (values (0), (1)) b(j))
    select fire_id, vertex_id, round(sum(w * elev), 5) elev from k join c on grid_row = floor(fy) + i and grid_col = floor(fx) + j group by 1, 2""")
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, ring = load(spark, sf_dir, "cells"), load(spark, sf_dir, "ring")
    rows = cells.agg(F.max("grid_row")).first()[0] + 1
    return grid.bilinear_sample(ring, cells, "elev", LEFT, TOP, SIZE, rows, 50).select("fire_id", "vertex_id", _r("elev", "elev", 5))


@query("""select k, coalesce(min(v) filter (where n = top), 255) v from (select *, max(n) over (partition by k) top from (
    select l_suppkey k, l_linenumber v, count(*) n from lineitem where l_linenumber <> 255 group by 1, 2)) group by 1""")
def class_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("v"))
    return grid.class_mode(rows, ["k"], "v")


# --- ignitions ------------------------------------------------------------------------------

_P = f"(select grid_row, grid_col, x, y, fuel_id, case when p_size % 11 = 0 then null else p_size % 25 end eco_id, p_size / 50e0 p, 'Human' cause, 'Summer' season from {duck('cells')})"


def _probable(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "cells")
    eco = F.when(F.col("p_size") % 11 != 0, F.col("p_size") % 25)
    return c.select("grid_row", "grid_col", "x", "y", "fuel_id", eco.alias("eco_id"), (F.col("p_size") / 50.0).alias("p"), F.lit("Human").alias("cause"), F.lit("Summer").alias("season"))


@query(f"select grid_row, grid_col, round(case when c.eco_id is null then 0e0 else p * coalesce(e_rate, 1e0) / (case when coalesce(f_rate, 1e0) = 0 then 1e0 else coalesce(f_rate, 1e0) end) end, 6) p from {_P} c left join {duck('rates')} r on r.eco_id = c.eco_id")
def ignition_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignitions.adjusted(_probable(spark, sf_dir), load(spark, sf_dir, "rates")).select("grid_row", "grid_col", _r("p", "p"))


@query(f"select grid_row, grid_col, round(case when fuel_id in (2, 3, 31) then 0e0 else p end, 6) p from {_P}")
def ignition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(2, "Human", "Summer"), (3, "human", "any"), (31, "Human", None), (4, "Lightning", "Summer"), (5, "Human", "Fall")], "fuel_id int, cause string, season string")
    return ignitions.ruled(_probable(spark, sf_dir), rules).select("grid_row", "grid_col", _r("p", "p"))


@query(f"select grid_row, grid_col, round(p / sum(p) over (), 9) p from {_P}")
def ignition_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignitions.normalised(_probable(spark, sf_dir), []).select("grid_row", "grid_col", _r("p", "p", 9))


_SHARES = {1: 0.2, 2: 0.3, 3: 0.3, 4: 0.2}


def _sql_draws(cells: str, iterations: int, p: str) -> str:
    """Ignitions drawn with the weights ``p``: points on the line of all weights, the first different cells of each iteration."""
    n = "case when u < 0.2e0 then 1 when u < 0.5e0 then 2 when u < 0.8e0 then 3 else 4 end"
    return f"""with c as (select *, {p} w from {cells}), k as (select *, sum(w) over (order by grid_row, grid_col) upto from c where w > 0),
        i as (select iteration, {n} n from (select range::int iteration, {_UNIFORM.format(key="'0:n:' || range")} u from range({iterations}))),
        d as (select iteration, n, j, {_UNIFORM.format(key="'0:at:' || iteration || ':' || j")} * (select max(upto) from k) at_ from i, (select unnest(range(32)) j)),
        h as (select iteration, n, j, grid_row, grid_col, x, y from d join k on at_ >= upto - w and at_ < upto),
        f as (select iteration, n, grid_row, grid_col, x, y, min(j) j from h group by all),
        r as (select *, row_number() over (partition by iteration order by j) fire_no from f)"""


@query(f"{_sql_draws(_P, 10, 'p')} select iteration, fire_no::int fire_no, grid_row, grid_col, x, y from r where fire_no <= n")
def ignition_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ignitions.sample_ignitions(_probable(spark, sf_dir), ignitions.fires_per_iteration(10, _SHARES, spark))


@query(f"""{_sql_draws(_P, 50, 'case when fuel_id in (2, 3) or eco_id is null or p <= 0 then 0e0 else p end')} select iteration * 4 + fire_no - 1 fire_id, iteration, x, y, 'Human' cause, 'Summer' season from r where fire_no <= n""")
def ignition_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(2, "Human", "Summer"), (3, "human", None)], "fuel_id int, cause string, season string")
    even = spark.createDataFrame([(-1, 1.0, 1.0)], "eco_id int, e_rate double, f_rate double")
    return ignitions.monte_carlo(_probable(spark, sf_dir).drop("cause", "season"), 50, _SHARES, "Human", "Summer", rules, even)


@query(f"select distinct iteration from {duck('ignitions')}")
def ignition_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "ignitions").select("iteration").distinct()


# --- fronts ---------------------------------------------------------------------------------

_AROUND = f"""(select *, coalesce(lead({{c}}) over w, first_value({{c}}) over w2) {{c}}1, coalesce(lag({{c}}) over w, last_value({{c}}) over w2) {{c}}0 from {{t}}
    window w as (partition by fire_id order by vertex_id), w2 as (partition by fire_id order by vertex_id rows between unbounded preceding and unbounded following))"""
_NEXT = _AROUND.format(c="y", t=_AROUND.format(c="x", t=duck("ring")))
_TANGENT = f"(select *, (x1 - x0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) xs, (y1 - y0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) ys from {_NEXT})"
_RATES = "5e0 + fire_id % 3 h, 1e0 b, 2e0 f, radians((fire_id * 45e0) % 360) z"


@query(f"select fire_id, vertex_id, round(xs, 6) xs, round(ys, 6) ys from {_TANGENT}")
def front_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.derivatives(load(spark, sf_dir, "ring"), ["fire_id"]).select("fire_id", "vertex_id", _r("xs", "xs"), _r("ys", "ys"))


def _moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = fires.derivatives(load(spark, sf_dir, "ring"), ["fire_id"])
    rates = {"head_ros": 5.0 + F.col("fire_id") % 3, "back_ros": F.lit(1.0), "flank_ros": F.lit(2.0), "azimuth": F.col("fire_id") * 45.0 % 360}
    return fires.front_velocity(ring.withColumns(rates), ["fire_id"])


_VELOCITY = f"""(select *, (f * f * cos(z) * v - a * a * sin(z) * u) / d + c * sin(z) vx, (-f * f * sin(z) * v - a * a * cos(z) * u) / d + c * cos(z) vy from (
    select *, sqrt(a * a * u * u + f * f * v * v) + 1e-12 * (a + f + 1e-12) d from (
    select *, (h + b) / 2 a, (h - b) / 2 c, xs * cos(z) - ys * sin(z) u, xs * sin(z) + ys * cos(z) v from (select *, {_RATES} from {_TANGENT}))))"""


@query(f"select fire_id, vertex_id, round(vx, 6) vx, round(vy, 6) vy from {_VELOCITY}")
def front_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moving(spark, sf_dir).select("fire_id", "vertex_id", _r("vx", "vx"), _r("vy", "vy"))


@query(f"select fire_id, vertex_id, round(x + vx, 5) x, round(y + vy, 5) y from {_VELOCITY}")
def front_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moving(spark, sf_dir).select("fire_id", "vertex_id", _r(F.col("x") + F.col("vx"), "x", 5), _r(F.col("y") + F.col("vy"), "y", 5))


_TURN = "((({a} + pi()) - floor(({a} + pi()) / (2e0 * pi())) * 2e0 * pi()) - pi())"
_ANGLE = "atan2(y1 - py, x1 - px) - atan2(y - py, x - px)"


@query(f"""with p as (select fire_id, 0 point_id, x px, y py from {duck('ignitions')} union all select fire_id, 1, x + 40e0, y from {duck('ignitions')})
    select fire_id, point_id, cast(round(sum({_TURN.format(a=_ANGLE)}) / (2e0 * pi())) as int) turning_number from p join {_NEXT} using (fire_id) group by 1, 2""")
def front_turning(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = load(spark, sf_dir, "ignitions")
    points = at.select("fire_id", F.lit(0).alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py")).unionByName(
        at.select("fire_id", F.lit(1).alias("point_id"), (F.col("x") + 40.0).alias("px"), F.col("y").alias("py")))
    return fires.turning(points, load(spark, sf_dir, "ring"), ["fire_id"])


@query(f"""with p as (select fire_id, vertex_id point_id, x + ys px, y - xs py from {_TANGENT})
    select fire_id, point_id, cast(round(sum({_TURN.format(a=_ANGLE)}) / (2e0 * pi())) as int) = 0 active from p join {_NEXT} using (fire_id) group by 1, 2""")
def front_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = fires.derivatives(load(spark, sf_dir, "ring"), ["fire_id"])
    points = ring.select("fire_id", F.col("vertex_id").alias("point_id"), (F.col("x") + F.col("ys")).alias("px"), (F.col("y") - F.col("xs")).alias("py"))
    return fires.turning(points, ring.select("fire_id", "vertex_id", "x", "y"), ["fire_id"]).select("fire_id", "point_id", (F.col("turning_number") == 0).alias("active"))


_MEASURED = f"(select fire_id, abs(sum(x * y1 - x1 * y)) / 2 / 1e4 area_ha, sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))) perimeter_m from {_NEXT} group by 1)"


@query(f"select fire_id, round(area_ha, 6) area_ha, round(perimeter_m, 5) perimeter_m from {_MEASURED}")
def ring_area_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.ring_measures(load(spark, sf_dir, "ring"), ["fire_id"]).select("fire_id", _r("area_ha", "area_ha"), _r("perimeter_m", "perimeter_m", 5))


@query(f"select i.*, round(area_ha, 6) area_ha, round(perimeter_m, 5) perimeter_m from {duck('ignitions')} i join {_MEASURED} using (fire_id)")
def fire_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "ignitions").join(ring_area_perimeter(spark, sf_dir), "fire_id")


@query(f"select cause, season, count(*) n_fires, round(sum(area_ha), 5) total_ha from {duck('ignitions')} join {_MEASURED} using (fire_id) group by cube (cause, season)")
def fire_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = load(spark, sf_dir, "ignitions").join(fires.ring_measures(load(spark, sf_dir, "ring"), ["fire_id"]), "fire_id")
    return joined.cube("cause", "season").agg(F.count("*").alias("n_fires"), _r(F.sum("area_ha"), "total_ha", 5))


@query(f"""with e as {_NEXT}, n as (select count(distinct fire_id) n from e),
    h as (select grid_row, grid_col, fire_id from (select grid_row, grid_col, x cx, y cy from {duck('cells')}) c join e on (y <= cy and cy < y1) or (y1 <= cy and cy < y)
          where x + (cy - y) / (y1 - y) * (x1 - x) > cx group by 1, 2, 3 having count(*) % 2 = 1)
    select c.grid_row, c.grid_col, round(coalesce(k, 0) / n, 6) burn_probability from {duck('cells')} c cross join n left join (select grid_row, grid_col, count(*) * 1e0 k from h group by 1, 2) using (grid_row, grid_col)""")
def burn_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fires.burn_probability(load(spark, sf_dir, "ring"), load(spark, sf_dir, "cells"), grid.bounds(load(spark, sf_dir, "cells")))
    return out.select("grid_row", "grid_col", _r("burn_probability", "burn_probability"))


@query(f"""with e as {_NEXT} select fire_id, grid_row, grid_col from (select grid_row, grid_col, x cx, y cy from {duck('cells')}) c join e on (y <= cy and cy < y1) or (y1 <= cy and cy < y)
    where x + (cy - y) / (y1 - y) * (x1 - x) > cx group by 1, 2, 3 having count(*) % 2 = 1""")
def polygon_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "cells")
    held = fires.cells_inside(load(spark, sf_dir, "ring"), grid.bounds(cells))
    return held.join(cells.select("grid_row", "grid_col"), ["grid_row", "grid_col"], "left_semi").select("fire_id", "grid_row", "grid_col")


_CLIP = (300.0, -90.0, 900.0, 0.0)


def _sql_clip(rings: str, box: tuple[float, float, float, float]) -> str:
    """Area of rings cut to a box, side after side, in SQL."""
    ctes, at = [f"c0 as (select fire_id, vertex_id v, x, y from {rings})"], 0
    for axis, bound, sign in (("x", box[0], 1), ("y", box[1], 1), ("x", box[2], -1), ("y", box[3], -1)):
        a, b = f"({sign}e0 * ({axis} - {bound}e0))", f"({sign}e0 * (n{axis} - {bound}e0))"
        nexts = ", ".join(f"coalesce(lead({c}) over w, first_value({c}) over (partition by fire_id order by v rows between unbounded preceding and unbounded following)) n{c}" for c in "xy")
        ctes.append(f"""p{at} as (select *, {nexts} from c{at} window w as (partition by fire_id order by v)),
            c{at + 1} as (select fire_id, row_number() over (partition by fire_id order by v, h) - 1 v, x, y from (
                select fire_id, v, 0 h, x, y from p{at} where {a} >= 0 union all
                select fire_id, v, 1 h, x + {a} / ({a} - {b}) * (nx - x) x, y + {a} / ({a} - {b}) * (ny - y) y from p{at} where ({a} >= 0) <> ({b} >= 0)))""")
        at += 1
    last = f"(select *, coalesce(lead(x) over w, first_value(x) over (partition by fire_id order by v rows between unbounded preceding and unbounded following)) nx, coalesce(lead(y) over w, first_value(y) over (partition by fire_id order by v rows between unbounded preceding and unbounded following)) ny from c{at} window w as (partition by fire_id order by v))"
    return f"with {', '.join(ctes)} select fire_id, round(abs(sum(x * ny - nx * y)) / 2 / 1e4, 6) area_ha from {last} group by 1"


@query(_sql_clip(duck("ring"), _CLIP))
def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.ring_measures(fires.clip_rings(load(spark, sf_dir, "ring"), _CLIP), ["fire_id"]).select("fire_id", _r("area_ha", "area_ha"))


@query(f"""select round(min(h) filter (h > 0), 6) least, round(max(h) filter (h > 0), 6) most, round(avg(h) filter (h > 0), 6) mean, count(*) filter (h > 0) n, round(quantile_cont(h, 0.99), 6) p99
    from (select {_BY_FUEL} h from {duck('cells')})""")
def ros_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fires.rate_statistics(ros_grid(spark, sf_dir))
    return out.select(*[_r(c, c) for c in ("least", "most", "mean")], "n", _r("p99", "p99"))


@query(f"""select fire_id, fuel_id, elev from {duck('ignitions')} i left join (select grid_row, grid_col, fuel_id, elev from {duck('cells')}) c
    on c.grid_row = floor(-i.y / 30e0) and c.grid_col = floor(i.x / 30e0)""")
def ignition_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col = grid.cell_at(F.col("x"), F.col("y"), LEFT, TOP, SIZE)
    return fires.ignition_diagnostics(load(spark, sf_dir, "ignitions"), load(spark, sf_dir, "cells"), row, col, ["fuel_id", "elev"]).select("fire_id", "fuel_id", "elev")


@query("""with r as (select final_area_ha a from fire_result where final_area_ha > 0 and not isnan(final_area_ha)), f as (select min(a) lo, max(a) hi, avg(a) m, median(a) d from r)
    select cast(least(29, floor(case when hi > lo then (a - lo) / ((hi - lo) / 30) else 0e0 end)) as int) bin, round(m, 4) mean_area, round(d, 6) median_area, count(*) n_fires from r cross join f group by all""")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fires.size_histogram(spark.read.parquet(f"{sf_dir}/fire_result.parquet"), "final_area_ha")
    return out.select("bin", _r("mean_area", "mean_area", 4), _r("median_area", "median_area"), "n_fires")


@query(f"select round(min(x) - 0.1e0 * g, 5) x_min, round(max(x) + 0.1e0 * g, 5) x_max, round(min(y) - 0.1e0 * g, 5) y_min, round(max(y) + 0.1e0 * g, 5) y_max from {duck('ring')} cross join (select greatest(max(x) - min(x), max(y) - min(y)) g from {duck('ring')}) group by g")
def front_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.extent(load(spark, sf_dir, "ring")).select(*[_r(c, c, 5) for c in ("x_min", "x_max", "y_min", "y_max")])


def _grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    ground = grid.fuel_break(_terrain(spark, sf_dir), _mask(), "zero_ros")
    return fires.grow_fires(load(spark, sf_dir, "ignitions"), ground, _timeline(spark, 10), 10, grid.bounds(ground), n=60, every=5)


@query()
def fire_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.ring_measures(_grown(spark, sf_dir), ["fire_id", "t_min"]).select("fire_id", "t_min", _r("area_ha", "area_ha"), _r("perimeter_m", "perimeter_m", 4))


@query()
def fire_history_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fires.thin(_grown(spark, sf_dir), 2).groupBy("fire_id", "t_min").agg(F.count("*").alias("n_vertices"))


# --- enumerations ---------------------------------------------------------------------------


@query("select lat, lon, (case when lat >= 0 then 'N' else 'S' end) || lpad(abs(lat)::varchar, 2, '0') || (case when lon >= 0 then 'E' else 'W' end) || lpad(abs(lon)::varchar, 3, '0') tile from (select unnest(range(48, 55, 3))::int lat), (select unnest(range(-120, -110, 3))::int lon)")
def tile_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the three-degree tiles that cover a box."""
    return climate.tile_names(spark, (-119.5, 48.2, -110.5, 55.0)).withColumns({"lat": F.col("lat").cast("int"), "lon": F.col("lon").cast("int")})


@query("select d::date first_day, least(d + interval 9 day, timestamp '2020-10-01')::date last_day from (select unnest(range(timestamp '2020-05-01', timestamp '2020-10-02', interval 10 day)) d)")
def date_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of ten days that cover a season, as a download takes them."""
    return climate.date_spans(spark, "2020-05-01", "2020-10-01")


@query("select station_code, latitude, longitude from station where longitude - 0.5e0 < -60 and longitude + 0.5e0 > -120 and latitude - 0.5e0 < 60 and latitude + 0.5e0 > 50")
def bbox_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/station.parquet")
    x, y = F.col("longitude"), F.col("latitude")
    return s.where(fires.overlaps((-120.0, 50.0, -60.0, 60.0), x - 0.5, y - 0.5, x + 0.5, y + 0.5)).select("station_code", "latitude", "longitude")
