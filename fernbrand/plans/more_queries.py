"""Further queries of the reference operators: fallbacks, whole pipelines, grids, maps; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand import config
from fernbrand.functions import ros, sql
from fernbrand.operators import cells as grid
from fernbrand.operators import climate, fires, fireweather, ignitions, regions
from fernbrand.plans import reference_queries as rq
from fernbrand.plans import simulation
from fernbrand.plans.fixtures import duck, load
from fernbrand.plans.reference_queries import _r, _rounded
from fernbrand.sources import shapes

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


# --- weather: fallbacks and the whole list ----------------------------------------------------

_MEANS = "avg(temp) temp, avg(rh) rh, avg(ws) ws, avg(wd) wd"
_DAYS = "select station_code, obs_date, {what} from (select station_code, obs_date, {how} from {rows} group by 1, 2)"


@query(_DAYS.format(what=_rounded("temp rh ws wd"), how=_MEANS, rows=f"{duck('obs')} where obs_hour = 13"))
def weather_noon_at_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row at noon: those of 13 h."""
    obs = load(spark, sf_dir, "obs").where("obs_hour <> 12")
    return fireweather.noon_rows(obs, ["station_code"]).select("station_code", "obs_date", *[_r(c, c) for c in fireweather.MEASURES])


@query(_DAYS.format(what=_rounded("temp rh ws wd"), how=_MEANS, rows=f"{duck('obs')} where obs_hour < 12"))
def weather_noon_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No row at noon or 13 h: means of the day."""
    obs = load(spark, sf_dir, "obs").where("obs_hour < 12")
    return fireweather.noon_rows(obs, ["station_code"]).select("station_code", "obs_date", *[_r(c, c) for c in fireweather.MEASURES])


@query(_DAYS.format(what=_rounded("isi temp rh ws wd"), how="max(isi) isi, " + _MEANS, rows=f"{duck('obs')} where obs_hour <> 12"))
def weather_daily_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's weather at noon where no row is at noon: the greatest index and means."""
    days = fireweather.daily_weather(load(spark, sf_dir, "obs").where("obs_hour <> 12"), ["station_code"])
    return days.select("station_code", "obs_date", *[_r(c, c) for c in ("isi", *fireweather.MEASURES)])


@query(f"select category, count(*) n_days from (select {rq._CLASS} category from {duck('obs')}) group by 1")
def weather_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.category_counts(rq._classed(spark, sf_dir))


@query(f"select round(avg(event_days), 6) mean_days, min(event_days) least_days, max(event_days) most_days from ({rq.ORACLES['spread_event_days']})")
def weather_event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fireweather.event_statistics(rq.spread_event_days(spark, sf_dir)).select(_r("mean_days", "mean_days"), "least_days", "most_days")


@query(f"""with h as (select * from {duck('obs')} where isi < 8.6e0)
    select round(median(temp), 6) temp, round(median(rh), 6) rh, round(quantile_cont(ws, 0.75), 6) ws, round(median(wd), 6) wd, round(quantile_cont(isi, 0.75), 6) isi, 70e0 bui, 85e0 ffmc from h""")
def weather_representative_calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No day high or extreme: upper quartiles; what isn't known is usual."""
    calm = rq._classed(spark, sf_dir).where("isi < 8.6")
    return fireweather.representative(calm).select(*[_r(c, c) for c in ("temp", "rh", "ws", "wd", "isi", "bui", "ffmc")])


_FORMS = ("%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M", "%Y/%m/%d", "%d.%m.%Y %H:%M", "no date")


@query(f"""select event_id, case when event_id % 5 <> 4 then cast(ts as date) end obs_date, case event_id % 5 when 2 then 0 when 4 then null else hour(ts) end::int obs_hour from {duck('obs')}""")
def weather_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of readings written in several forms, read back."""
    forms = {0: "yyyy-MM-dd HH:mm:ss", 1: "dd/MM/yyyy HH:mm", 2: "yyyy/MM/dd", 3: "dd.MM.yyyy HH:mm"}
    written = F.lit("no date")
    for k, form in forms.items():
        written = F.when(F.col("event_id") % 5 == k, F.date_format("ts", form)).otherwise(written)
    raw = load(spark, sf_dir, "obs").select("event_id", written.alias("HOURLY"))
    return fireweather.with_times(fireweather.canonical(raw)).select("event_id", "obs_date", "obs_hour")


_NOON = f"""d as (select obs_date, avg(temp) temp, avg(rh) rh, avg(ws) ws, avg(wd) wd, coalesce(any_value(p), 0) precip, row_number() over (order by obs_date) i
    from (select o.*, sum(precip) over (partition by obs_date) p from {duck('obs')} o) where obs_hour = 12 group by 1),
    r as (select d.obs_date, d.i, {rq._sql_ffmc('d.temp', 'd.rh', 'd.ws', 'd.precip', '85e0')} ffmc, {rq._sql_dmc('d.temp', 'd.rh', 'd.precip', '6e0', 'month(d.obs_date)')} dmc,
            {rq._sql_dc('d.temp', 'd.precip', '15e0', 'month(d.obs_date)')} dc from d where i = 1
          union all select d.obs_date, d.i, {rq._sql_ffmc('d.temp', 'd.rh', 'd.ws', 'd.precip', 'r.ffmc')}, {rq._sql_dmc('d.temp', 'd.rh', 'd.precip', 'r.dmc', 'month(d.obs_date)')},
            {rq._sql_dc('d.temp', 'd.precip', 'r.dc', 'month(d.obs_date)')} from r join d on d.i = r.i + 1)"""
_LISTED = f"""with recursive {_NOON}, e as ({rq._INDICES.format(r='select r.*, ws, temp, precip from r join d using (obs_date)', keys='obs_date, round(temp, 4) temp, round(precip, 4) precip')}),
    l as (select *, {rq._CLASS} category, {rq._POISSON} event_days from (select *, {rq._UNIFORM.format(key="'0:' || obs_date")} u from e))"""
_LIST_COLUMNS = ("obs_date", "temp", "precip", "ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr", "category", "event_days")


def _listed(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...]) -> DataFrame:
    hourly = load(spark, sf_dir, "obs").drop("isi")
    return fireweather.fire_weather_list(hourly, None, wanted).select(*[_r(c, c, 4) if c not in ("obs_date", "category", "event_days") else F.col(c) for c in _LIST_COLUMNS])


@query(f"{_LISTED} select {', '.join(_LIST_COLUMNS)} from l where category in ('high', 'moderate')")
def fire_weather_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From hourly readings without indices to classed days with event days."""
    return _listed(spark, sf_dir, ("high", "moderate"))


@query(f"{_LISTED} select {', '.join(_LIST_COLUMNS)} from l")
def fire_weather_pipeline_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No day of the wanted class: all are kept."""
    return _listed(spark, sf_dir, ("none such",))


@query(f"""with o as (select s, max({{'t': temp, 'h': rh}}) v from (select *, epoch(obs_date)::bigint + obs_hour * 3600 s from {duck('obs')} where station_code = 'view') group by 1),
    p as (select *, lead(s) over w s1, lead(v) over w v1, row_number() over w i from o window w as (order by s)),
    k as (select range::int step, (select min(s) from o) + 90 * range t from range(400)),
    j as (select step, v, coalesce(v1, v) v1, case when s1 is null or t <= s then 0e0 else (t - s) * 1e0 / (s1 - s) end w from p join k on (t > s or i = 1) and (s1 is null or t <= s1))
    select step, round(v.t * (1 - w) + v1.t * w, 5) temp, round(v.h * (1 - w) + v1.h * w, 5) rh, 50e0 bui from j""")
def weather_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather of one station at each step of a run, a minute and a half apart; what isn't known is usual."""
    obs = fireweather.observation_second(load(spark, sf_dir, "obs").where("station_code = 'view'").select("obs_date", "obs_hour", "temp", "rh"))
    first = obs.agg(F.min("second")).first()[0] or 0
    return fireweather.weather_sequence(obs, first, 400, 1.5).select("step", _r("temp", "temp", 5), _r("rh", "rh", 5), "bui")


@query(f"""select event_id, round({rq._ISI.format(m=rq._MO.format(f=rq._FFMC), w='ws')}, 6) isi, round(32e0 + 0e0 * ws, 6) bui, round({rq._sql_ros('C-3', 'isi', '80e0')}, 6) head_ros from {duck('obs')}""")
def formulas_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas as functions of a query's text."""
    sql.register(spark)
    return spark.sql(
        "select event_id, round(fwi_isi(60 + event_id % 40, ws), 6) isi, round(fwi_bui(20D, 200D), 6) bui, round(ros_head('c-3', isi, 80D), 6) head_ros from {o}", o=load(spark, sf_dir, "obs")
    )


# --- grids --------------------------------------------------------------------------------------

_DX = "(case when lag(elev) over c is null then (lead(elev) over c - elev) / {s}e0 when lead(elev) over c is null then (elev - lag(elev) over c) / {s}e0 else (lead(elev) over c - lag(elev) over c) / {d}e0 end)"


def _sloped(where: str, sx: float, sy: float, z: str = "elev") -> str:
    along, down = _DX.format(s=sx, d=2 * sx), _DX.format(s=sy, d=2 * sy).replace("over c", "over r")
    return f"""(select *, least(90e0, greatest(0e0, degrees(atan(sqrt(dx * dx + dr * dr))))) slope_deg, case when sqrt(dx * dx + dr * dr) >= 1e-6 then (degrees(atan2(dx, -dr)) + 360e0) % 360e0 end aspect_deg
        from (select *, {along} dx, {down} dr from {where} window c as (partition by grid_row order by grid_col), r as (partition by grid_col order by grid_row)))"""


_HOLED = f"(select grid_row, grid_col, case when p_size % 20 = 0 then 'nan'::double else elev end elev from {duck('cells')})"


@query(f"select grid_row, grid_col, round(case when isnan(slope_deg) then null else slope_deg end, 6) slope_deg from {_sloped(_HOLED, 30.0, 30.0)}")
def terrain_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes without filling: next to a hole there is none."""
    holed = load(spark, sf_dir, "cells").withColumn("elev", F.when(F.col("p_size") % 20 != 0, F.col("elev")))
    return grid.simple_slope_aspect(holed, "elev", SIZE).select("grid_row", "grid_col", _r("slope_deg", "slope_deg"))


@query(f"""select grid_row, grid_col, round(case when p_size % 20 <> 0 then slope_deg end, 6) slope_deg from {_sloped(f"(select grid_row, grid_col, p_size, case when p_size % 20 <> 0 then elev else (select median(elev) from {duck('cells')} where p_size % 20 <> 0) end elev from {duck('cells')})", 30.0, 30.0)}""")
def terrain_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes beside holes, which take the median height."""
    holed = load(spark, sf_dir, "cells").withColumn("elev", F.when(F.col("p_size") % 20 != 0, F.col("elev")))
    return grid.slope_aspect(holed, "elev", SIZE).select("grid_row", "grid_col", _r("slope_deg", "slope_deg"))


_METRES = 111320.0 * 0.6427876096865394


@query(f"select grid_row, grid_col, round(slope_deg, 6) slope_deg from {_sloped(duck('cells'), 0.001 * _METRES, 0.001 * 111320.0)}")
def terrain_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of a grid in degrees at 50 degrees north, cells a thousandth wide."""
    wide, high = grid.metres_per_degree(50.0)
    return grid.slope_aspect(load(spark, sf_dir, "cells"), "elev", 0.001 * wide, 0.001 * high).select("grid_row", "grid_col", _r("slope_deg", "slope_deg"))


@query(f"select round(min(elev), 6) least_elev, round(max(elev), 6) most_elev, round(avg(elev), 6) mean_elev, round(min(slope_deg), 6) least_slope, round(max(slope_deg), 6) most_slope, round(avg(slope_deg), 6) mean_slope from {rq._SLOPE}")
def terrain_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.terrain_statistics(rq._terrain(spark, sf_dir))
    return out.select(*[_r(c, c) for c in out.columns])


@query(f"select grid_row, grid_col, round(greatest(0e0, {rq._ISI.format(m=rq._MO.format(f='(60e0 + p_size % 40)'), w='(p_size % 30)')}), 6) isi from {duck('cells')}")
def isi_over_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = load(spark, sf_dir, "cells").withColumns({"code": 60.0 + F.col("p_size") % 40, "wind": (F.col("p_size") % 30).cast("double")})
    return climate.isi_grid(cells, "code", "wind").select("grid_row", "grid_col", _r("isi", "isi"))


_LOOKUP = {1: "M-1", 2: "c-3", 3: "NF", 21: "O-1a", 31: "S-2", 40: "D-1"}
_BY_LOOKUP = "case fuel_id " + " ".join(f"when {k} then {rq._sql_ros(v.upper(), '10e0', '80e0')}" for k, v in _LOOKUP.items() if v != "NF") + " else 0e0 end"


@query(f"select grid_row, grid_col, round({_BY_LOOKUP}, 6) head_ros from {duck('cells')}")
def ros_by_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a grid whose codes have a map of their own; codes that it doesn't name don't burn."""
    weather = spark.range(1).select(F.lit(10.0).alias("isi"), F.lit(80.0).alias("bui"))
    rates = grid.fuel_rates(weather, [*ros.FUELS, "NF"]).select("fuel", "head_ros")
    cells = load(spark, sf_dir, "cells").withColumn("_f", ros.fuel_name(F.col("fuel_id"), _LOOKUP))
    return cells.join(F.broadcast(rates), F.col("_f") == F.col("fuel")).select("grid_row", "grid_col", _r("head_ros", "head_ros"))


_STATIC = rq._CUBE_HEAD.replace("isi", "10e0").replace("bui", "70e0").replace("wd", "180e0").replace("temp", "25e0").replace(", rh", ", 40e0").replace("(rh", "(40e0")


@query(f"select grid_row, grid_col, round(h, 6) head_ros, round(0.2e0 * h, 6) back_ros from (select grid_row, grid_col, {_STATIC} h from {rq._SLOPE})")
def ros_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of one representative weather, as a run without hourly weather uses them throughout."""
    weather = fireweather.representative(spark.createDataFrame([], "isi double")).withColumns({"step": F.lit(0), "rh": F.lit(40.0)})
    cells = grid.fuel_break(rq._terrain(spark, sf_dir), rq._mask(), "zero_ros")
    return grid.spread_grid(cells, weather.select("step", "isi", "bui", "wd", "temp", "rh")).select("grid_row", "grid_col", _r("head_ros", "head_ros"), _r("back_ros", "back_ros"))


@query(f"""with f as (select grid_row, grid_col, case when {{b}} then 102 else fuel_id end fuel_id from {duck('cells')})
    select grid_row, grid_col, case when grid_col % 10 = 3 and fuel_id not in (0, 101, 102, 106, -9999) then 31 else fuel_id end fuel_id from f""".replace("{b}", rq._BREAK))
def fuel_breaks_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two barriers, a line and a grid, one after the other."""
    cells = load(spark, sf_dir, "cells")
    box = grid.bounds(cells)
    line = spark.createDataFrame([(*rq._A, *rq._B)], "ax double, ay double, bx double, by double")
    layer = cells.select("grid_row", "grid_col", "x", "y", (F.col("grid_col") % 10 == 3).cast("int").alias("value"))
    first = grid.fuel_break(grid.masked(cells, grid.cells_near(line, 45.0, box), "_hit"), F.col("_hit"), "fuel_code", 102).drop("_hit")
    second = grid.fuel_break(grid.raster_mask(first, layer, "value", box, "_hit"), F.col("_hit"), "fuel_code", 31)
    return second.select("grid_row", "grid_col", "fuel_id")


_BOTH = rq.ORACLES["bilinear_sample"].replace("round(sum(w * elev), 5) elev", "round(sum(w * elev), 5) elev, round(sum(w * fuel_id), 5) fuel")


@query(_BOTH)
def bilinear_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several values of a grid at the same points at once."""
    cells, ring = load(spark, sf_dir, "cells").withColumn("fuel", F.col("fuel_id").cast("double")), load(spark, sf_dir, "ring")
    box = grid.bounds(cells)
    out = grid.bilinear_sample(ring, cells, ["elev", "fuel"], box["left"], box["top"], box["size"], box["rows"], box["cols"])
    return out.select("fire_id", "vertex_id", _r("elev", "elev", 5), _r("fuel", "fuel", 5))


# --- shapes and fires ---------------------------------------------------------------------------


# Off the centres of cells, so that no outline meets an edge of a cell in a point only.
_MOVED = f"(select fire_id, vertex_id, x + 1.3e0 x, y + 0.7e0 y from {duck('ring')})"
_TOUCHED = f"""with h as ({rq.ORACLES['polygon_rasterise']}), c as (select grid_row, grid_col from {duck('cells')}),
    e as (select fire_id, x ax, y ay, x1 bx, y1 bz from {rq._NEXT}),
    t as (select distinct fire_id, c.grid_row, c.grid_col from e join (select grid_row, grid_col, grid_col * 30e0 x0, (grid_col + 1) * 30e0 x1, -(grid_row + 1) * 30e0 y0, -grid_row * 30e0 y1 from c) c
          on least(ax, bx) <= x1 and greatest(ax, bx) >= x0 and least(ay, bz) <= y1 and greatest(ay, bz) >= y0
          and not (greatest((bx - ax) * (y0 - ay) - (bz - ay) * (x0 - ax), (bx - ax) * (y0 - ay) - (bz - ay) * (x1 - ax), (bx - ax) * (y1 - ay) - (bz - ay) * (x0 - ax), (bx - ax) * (y1 - ay) - (bz - ay) * (x1 - ax)) < 0
              or least((bx - ax) * (y0 - ay) - (bz - ay) * (x0 - ax), (bx - ax) * (y0 - ay) - (bz - ay) * (x1 - ax), (bx - ax) * (y1 - ay) - (bz - ay) * (x0 - ax), (bx - ax) * (y1 - ay) - (bz - ay) * (x1 - ax)) > 0))
    select fire_id, count(*) n_cells from (select fire_id, grid_row, grid_col from h union select fire_id, grid_row, grid_col from t) group by 1"""


@query(_TOUCHED.replace(duck("ring"), _MOVED))
def polygon_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells inside shapes or passed by their outlines."""
    cells = load(spark, sf_dir, "cells")
    ring = load(spark, sf_dir, "ring").withColumns({"x": F.col("x") + 1.3, "y": F.col("y") + 0.7})
    touched = fires.cells_touched(ring, grid.bounds(cells)).join(cells.select("grid_row", "grid_col"), ["grid_row", "grid_col"], "left_semi")
    return touched.groupBy("fire_id").agg(F.count("*").alias("n_cells"))


@query(f"""select c.grid_row, c.grid_col, coalesce(max(h.fire_id), -1)::double code from {duck('cells')} c left join ({rq.ORACLES['polygon_rasterise']}) h on h.grid_row = c.grid_row and h.grid_col = c.grid_col group by 1, 2""")
def polygon_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of the values of the shapes over it, the last of several."""
    cells, ring = load(spark, sf_dir, "cells"), load(spark, sf_dir, "ring")
    values = ring.select("fire_id").distinct().withColumn("code", F.col("fire_id").cast("double"))
    return fires.rasterise(cells.select("grid_row", "grid_col"), fires.cells_inside(ring, grid.bounds(cells)), values, "code", -1.0)


@query(f"""with r as (select fire_id, vertex_id, (x - avg(x) over (partition by fire_id)) * {_METRES}e0 x, (y - avg(y) over (partition by fire_id)) * 111320e0 y from {duck('ring')}),
    n as {rq._AROUND.format(c='y', t=rq._AROUND.format(c='x', t='r'))}
    select fire_id, round(abs(sum(x * y1 - x1 * y)) / 2 / 1e4, 3) area_ha, round(sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))), 3) perimeter_m from n group by 1""")
def ring_measures_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and lengths of rings whose coordinates are degrees."""
    return fires.ring_measures(load(spark, sf_dir, "ring"), ["fire_id"], 50.0).select("fire_id", _r("area_ha", "area_ha", 3), _r("perimeter_m", "perimeter_m", 3))


@query(f"""select fire_id, count(*) + 1 n_points, round(max(x) filter (vertex_id = 0), 6) x_end from {duck('ring')} group by 1""")
def ring_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings as polygons: the first vertex again at the end."""
    lines = regions.outlines(load(spark, sf_dir, "ring"), "fire_id")
    closed = F.concat("xs", F.slice("xs", 1, 1))
    return lines.select("fire_id", F.size(closed).cast("long").alias("n_points"), _r(F.element_at(closed, -1), "x_end"))


@query(f"select fire_id, round(avg(x), 5) x, round(avg(y), 5) y from {duck('ring')} group by 1")
def ignition_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignitions from shapes that aren't points: the middle of each."""
    lines = regions.outlines(load(spark, sf_dir, "ring"), "fire_id")
    shape = lines.select(F.col("fire_id").alias("shape_id"), F.lit(0).alias("part"), F.lit("ring").alias("kind"), F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y"))).alias("vertices"))
    closed = shape.withColumn("vertices", F.concat("vertices", F.slice("vertices", 1, 1))).withColumn("properties", F.create_map(F.lit("ITERATION"), F.col("shape_id").cast("string")))
    return shapes.points(closed).select(F.col("iteration").cast("long").alias("fire_id"), _r("x", "x", 5), _r("y", "y", 5))


@query(f"select grid_row, grid_col, round(case when fuel_id in (3, 31, 40) then 0e0 else p end, 6) p from {rq._P}")
def ignition_rules_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that name fuels: all codes of a name, whatever its case."""
    lookup = {3: "C-3", 31: "O-1a", 40: "M-1", 41: "M-1"}
    codes = ignitions.fuel_codes(["c-3", "O-1A", "M-1"], lookup)
    rules = spark.createDataFrame([(c, "Human", None) for c in codes], "fuel_id int, cause string, season string")
    return ignitions.ruled(rq._probable(spark, sf_dir), rules).select("grid_row", "grid_col", _r("p", "p"))


def _settings(steps: int) -> config.Config:
    made, _ = config.parse({
        "simulation": {"max_duration": steps, "n_vertices": 60, "store_every": 5}, "fuel": {"lookup": _LOOKUP | {4: "C-2", 5: "C-2", 6: "C-7", 7: "C-4", 11: "D-1"}},
        "weather": {"keep": ["high", "extreme"]},
    })
    return made


@query()
def run_simulation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run: hourly readings to indices and a timeline, ground, ignitions (some off the grid), growth, summary."""
    weather = load(spark, sf_dir, "obs").drop("isi")
    off = load(spark, sf_dir, "ignitions").withColumn("x", F.when(F.col("fire_id") % 10 == 0, F.col("x") + 1e6).otherwise(F.col("x")))
    _, summary = simulation.simulate(weather, None, load(spark, sf_dir, "cells").drop("p_size"), off, _settings(20))
    return summary.select("fire_id", "cause", "season", "iteration", _r("area_ha", "area_ha"), _r("perimeter_m", "perimeter_m", 4), "dur_min")


@query(f"select fire_id, fire_id % 10 = 0 is_off, case when fire_id % 10 = 0 then 0e0 else 20e0 end dur_min from {duck('ignitions')}")
def run_off_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ignition has its row, those off the grid with nothing burned."""
    flat = load(spark, sf_dir, "cells").drop("p_size").withColumns({"fuel_id": F.lit(2), "elev": F.lit(1000.0)})
    off = load(spark, sf_dir, "ignitions").withColumn("x", F.when(F.col("fire_id") % 10 == 0, F.col("x") + 1e6).otherwise(F.col("x")))
    _, summary = simulation.simulate(load(spark, sf_dir, "obs").drop("isi"), None, flat, off, _settings(20))
    return summary.select("fire_id", (F.col("area_ha") == 0).alias("is_off"), "dur_min")


def _sql_growth(steps: int, n: int) -> str:
    """Rings of fires on even ground after each of some steps, a step after another, in SQL."""
    rate = f"{rq._sql_ros('C-2', '(8e0 + {t})', '(60e0 + {t} * 5)')} * {rq._EF.format(t='(20e0 + {t})', h='(40e0 - {t})').replace('elev', '1000e0')}"
    ctes = [f"""r0 as (select fire_id, i::int vertex_id, x + 0.5e0 * cos(2e0 * pi() * i / {n}e0) x, y + 0.5e0 * sin(2e0 * pi() * i / {n}e0) y
        from (select *, unnest(range({n})) i from {duck('ignitions')}))"""]
    for t in range(steps):
        around = rq._AROUND.format(c="y", t=rq._AROUND.format(c="x", t=f"r{t}"))
        h = f"({rate.format(t=t)})"
        ctes.append(f"""n{t} as {around}, t{t} as (select *, (x1 - x0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) xs, (y1 - y0) / sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) ys from n{t}),
        v{t} as (select *, {h} h, radians(({t * 40}e0 + 180) % 360) z from t{t}),
        u{t} as (select *, 0.6e0 * h a, 0.4e0 * h c, 0.3e0 * h f, xs * cos(z) - ys * sin(z) u, xs * sin(z) + ys * cos(z) v from v{t}),
        m{t} as (select *, (f * f * cos(z) * v - a * a * sin(z) * u) / sqrt(a * a * u * u + f * f * v * v) + c * sin(z) vx, (-f * f * sin(z) * v - a * a * cos(z) * u) / sqrt(a * a * u * u + f * f * v * v) + c * cos(z) vy from u{t}),
        w{t} as (select p.fire_id, p.vertex_id, sum(case when e.y <= p.y - p.xs and e.y1 > p.y - p.xs and (e.x1 - e.x) * (p.y - p.xs - e.y) - (p.x + p.ys - e.x) * (e.y1 - e.y) > 0 then 1
                when e.y > p.y - p.xs and e.y1 <= p.y - p.xs and (e.x1 - e.x) * (p.y - p.xs - e.y) - (p.x + p.ys - e.x) * (e.y1 - e.y) < 0 then -1 else 0 end) k
            from t{t} p join n{t} e using (fire_id) group by 1, 2),
        r{t + 1} as (select fire_id, vertex_id, x + case when k = 0 then vx else 0e0 end x, y + case when k = 0 then vy else 0e0 end y from m{t} join w{t} using (fire_id, vertex_id))""")
    measured = " union all ".join(
        f"select fire_id, {t}e0 t_min, abs(sum(x * y1 - x1 * y)) / 2 / 1e4 area_ha, sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))) perimeter_m from {rq._AROUND.format(c='y', t=rq._AROUND.format(c='x', t=f'r{t}'))} group by 1"
        for t in range(steps + 1)
    )
    return f"with {', '.join(ctes)} select fire_id, t_min, round(area_ha, 5) area_ha, round(perimeter_m, 3) perimeter_m from ({measured})"


@query(_sql_growth(5, 24))
def fire_growth_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth on even ground, where the rates are those of the weather alone, each step of it."""
    cells = load(spark, sf_dir, "cells")
    ground = cells.select("grid_row", "grid_col", "x", "y", F.lit(1000.0).alias("elev"), F.lit(2).alias("fuel_id"), F.lit(0.0).alias("slope_deg"), F.lit(None).cast("double").alias("aspect_deg"), F.lit(False).alias("zero_ros"))
    rings = fires.grow_fires(load(spark, sf_dir, "ignitions"), ground, rq._timeline(spark, 5), 5, grid.bounds(cells), n=24, every=1, slab=2)
    return fires.ring_measures(rings, ["fire_id", "t_min"]).select("fire_id", "t_min", _r("area_ha", "area_ha", 5), _r("perimeter_m", "perimeter_m", 3))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rings a fire, one for fires of an odd number."""
    return load(spark, sf_dir, "ring").withColumn("t_min", F.explode(F.sequence(F.lit(0), F.when(F.col("fire_id") % 2 == 0, 9).otherwise(0)))).withColumn("t_min", F.col("t_min") * 10.0)


_TIMES = f"(select *, unnest(range(case when fire_id % 2 = 0 then 10 else 1 end)) i from {duck('ring')})"


@query(f"select fire_id, i * 10e0 t_min, count(*) n_vertices from {_TIMES} where i % 4 = 0 or i = case when fire_id % 2 = 0 then 9 else 0 end group by 1, 2")
def history_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth ring of a fire and its last."""
    return fires.thin(_history(spark, sf_dir), 4).groupBy("fire_id", "t_min").agg(F.count("*").alias("n_vertices"))


@query(f"select fire_id, case when fire_id % 2 = 0 then 90e0 else 0e0 end t_min, count(*) n_vertices from {duck('ring')} group by 1")
def history_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ring of each fire."""
    return fires.final_rings(_history(spark, sf_dir)).groupBy("fire_id", "t_min").agg(F.count("*").alias("n_vertices"))


_LINE = "select range::int t, 8e0 + range isi, 60e0 + range * 5 bui, range * 40e0 wd, 20e0 + range temp, 40e0 - range rh from range({steps})"


def _sql_grown(steps: int, n: int, every: int, line: str = _LINE, head: str = rq._CUBE_HEAD, points: str = duck("ignitions"), before: str = "with") -> str:
    """CTEs that end in ``rings`` (``fire_id``, ``t_min``, ``vertex_id``, ``x``, ``y``): growth over the ground of the cells, a step after another.

    ``line``: the weather of each step ``t``; ``head``: a cell's rate in it.
    """
    ctes = [
        f"line as materialized ({line.replace('{steps}', str(steps))})",
        f"cube as materialized (select grid_row, grid_col, t, coalesce({head}, 0e0) hc from {rq._SLOPE} cross join line)",
        f"box as (select max(grid_row) + 1 nr, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from {duck('cells')})",
        f"""r0 as (select fire_id, i::int vertex_id, x + 0.5e0 * cos(2e0 * pi() * i / {n}e0) x, y + 0.5e0 * sin(2e0 * pi() * i / {n}e0) y
            from (select i.*, unnest(range({n})) i from {points} i cross join box where i.x between x0 and x1 and i.y between box.y0 and box.y1))""",
    ]
    for t in range(steps):
        around = rq._AROUND.format(c="y", t=rq._AROUND.format(c="x", t=f"r{t}"))
        ctes.append(f"""n{t} as materialized {around},
        s{t} as (select fire_id, vertex_id, sum(w * hc) h from (select *, (case when i = 1 then fy - floor(fy) else 1 - fy + floor(fy) end) * (case when j = 1 then fx - floor(fx) else 1 - fx + floor(fx) end) w from (
                select fire_id, vertex_id, least(49e0 - 1e-6, greatest(0e0, x / 30e0 - 0.5e0)) fx, least(nr - 1 - 1e-6, greatest(0e0, -y / 30e0 - 0.5e0)) fy from r{t} cross join box), (values (0), (1)) a(i), (values (0), (1)) b(j))
            join cube on t = {t} and grid_row = floor(fy) + i and grid_col = floor(fx) + j group by 1, 2),
        g{t} as (select fire_id from s{t} group by 1 having max(h) >= 0.01e0),
        t{t} as (select n{t}.*, h, radians(((select wd from line where t = {t}) + 180) % 360) z, case when l > 0 then (x1 - x0) / l else 0e0 end xs, case when l > 0 then (y1 - y0) / l else 0e0 end ys
            from (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) l from n{t}) n{t} join s{t} using (fire_id, vertex_id) join g{t} using (fire_id)),
        u{t} as (select *, 0.6e0 * h a, 0.4e0 * h c, 0.3e0 * h f, xs * cos(z) - ys * sin(z) u, xs * sin(z) + ys * cos(z) v from t{t}),
        m{t} as (select *, (f * f * cos(z) * v - a * a * sin(z) * u) / (sqrt(a * a * u * u + f * f * v * v) + 1e-15) + c * sin(z) vx, (-f * f * sin(z) * v - a * a * cos(z) * u) / (sqrt(a * a * u * u + f * f * v * v) + 1e-15) + c * cos(z) vy from u{t}),
        w{t} as (select p.fire_id, p.vertex_id, sum(case when e.y <= p.y - p.xs and e.y1 > p.y - p.xs and (e.x1 - e.x) * (p.y - p.xs - e.y) - (p.x + p.ys - e.x) * (e.y1 - e.y) > 0 then 1
                when e.y > p.y - p.xs and e.y1 <= p.y - p.xs and (e.x1 - e.x) * (p.y - p.xs - e.y) - (p.x + p.ys - e.x) * (e.y1 - e.y) < 0 then -1 else 0 end) k
            from t{t} p join n{t} e using (fire_id) group by 1, 2),
        r{t + 1} as materialized (select fire_id, vertex_id, x + case when k = 0 then vx else 0e0 end x, y + case when k = 0 then vy else 0e0 end y from m{t} join w{t} using (fire_id, vertex_id))""")
    rings = " union all ".join(f"select fire_id, {t}e0 t_min, vertex_id, x, y from r{t}" for t in range(0, steps + 1, every))
    return f"{before} {', '.join(ctes)}, rings as materialized ({rings})"


_RINGS = _sql_grown(10, 60, 5)
_RING_AROUND = rq._AROUND.format(c="y", t=rq._AROUND.format(c="x", t="rings")).replace("partition by fire_id", "partition by fire_id, t_min")
GROWTH_ORACLES = {
    "fire_growth": f"{_RINGS} select fire_id, t_min, round(abs(sum(x * y1 - x1 * y)) / 2 / 1e4, 6) area_ha, round(sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))), 4) perimeter_m from {_RING_AROUND} group by 1, 2",
    "fire_history_thinned": f"{_RINGS} select fire_id, t_min, count(*) n_vertices from (select *, dense_rank() over (partition by fire_id order by t_min) k, max(t_min) over (partition by fire_id) m from rings) where k % 2 = 1 or t_min = m group by 1, 2",
    "fire_final_rings": f"{_RINGS} select fire_id, t_min, count(*) n_vertices from (select *, max(t_min) over (partition by fire_id) m from rings) where t_min = m group by 1, 2",
}
_NAMED = _LOOKUP | {4: "C-2", 5: "C-2", 6: "C-7", 7: "C-4", 11: "D-1"}
_RUN_HEAD = "(case fuel_id " + " ".join(f"when {k} then {rq._sql_ros(v.upper(), 'isi', 'bui')}" for k, v in _NAMED.items() if v != "NF") + f" else 0e0 end) * {rq._SF.format(s=rq._RAWSF.format(wd='wd'))} * {rq._EF.format(t='temp', h='rh')}"
# The weather of a run: indices of its typical day, readings of all stations between the hours from noon of the middle day on.
_RUN_LINE = """select k.t, isi, bui, case when d < 0 then d + 360e0 else d end wd, tt temp, hh rh from (
        select t, v.t * (1 - w) + v1.t * w tt, v.h * (1 - w) + v1.h * w hh,
            degrees(atan2(sin(radians(v.d)) * (1 - w) + sin(radians(v1.d)) * w, cos(radians(v.d)) * (1 - w) + cos(radians(v1.d)) * w)) d
        from (select t, v, coalesce(v1, v) v1, case when s1 is null or at_ <= s then 0e0 else (at_ - s) * 1e0 / (s1 - s) end w
            from pairs join (select range::int t, (select day from middle) + range * 60 at_ from range({steps})) on (at_ > s or i = 1) and (s1 is null or at_ <= s1))) k cross join typical"""
_RUN_BEFORE = f"""{_LISTED}, severe as (select * from l where category in ('high', 'extreme')),
    typical as (select quantile_cont(p.isi, 0.75) isi, quantile_cont(p.bui, 0.75) bui from exact p),
    hours as (select *, epoch(obs_date)::bigint + obs_hour * 3600 s from {duck('obs')}), once as (select s, max({{'t': temp, 'h': rh, 'w': ws, 'd': wd}}) v from hours group by 1),
    pairs as (select *, lead(s) over w s1, lead(v) over w v1, row_number() over w i from once window w as (order by s)),
    middle as (select epoch(obs_date)::bigint + 43200 as day from (select obs_date, row_number() over (order by obs_date) - 1 k, count(*) over () // 2 m from hours) where k = m),"""
# The typical day needs the indices as they are, not as they are shown. Only severe days are kept, or, if there are none, all: upper quartiles either way.
_RUN_BEFORE = _RUN_BEFORE.replace("typical as (", f"""exact as (select isi, bui from (select *, {rq._CLASS} category from (select obs_date, {rq._ISI.format(m=rq._MO.format(f='ffmc'), w='ws')} isi,
        {rq._BUI.replace('case when p = 0 and c = 0', 'case when dmc = 0 and dc = 0').replace(' p ', ' dmc ').replace(' c ', ' dc ').replace('* c', '* dc').replace('* p', '* dmc').replace('else p', 'else dmc').replace('(p ', '(dmc ')} bui
        from (select r.*, ws from r join d using (obs_date)))) where category in ('high', 'extreme') or not exists (select 1 from severe)),
    typical as (""")
_OFF = f"(select fire_id, iteration, case when fire_id % 10 = 0 then x + 1e6 else x end x, y, cause, season from {duck('ignitions')})"
_RUN = _sql_grown(20, 60, 5, _RUN_LINE, _RUN_HEAD, _OFF, _RUN_BEFORE)
GROWTH_ORACLES["run_simulation_summary"] = f"""{_RUN}, last as (select *, max(t_min) over (partition by fire_id) m from rings),
    sized as (select fire_id, t_min, round(abs(sum(x * y1 - x1 * y)) / 2 / 1e4, 6) area_ha, round(sum(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y))), 4) perimeter_m
        from {rq._AROUND.format(c='y', t=rq._AROUND.format(c='x', t='(select fire_id, vertex_id, x, y, t_min from last where t_min = m)'))} group by 1, 2)
    select i.fire_id, cause, season, iteration, coalesce(area_ha, 0) area_ha, coalesce(perimeter_m, 0) perimeter_m, coalesce(t_min, 0) dur_min from {_OFF} i left join sized using (fire_id)"""
ORACLES |= GROWTH_ORACLES


@query()
def fire_growth_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth at its usual size: 300 vertices, 480 steps of a minute, a ring every 10."""
    ground = grid.fuel_break(rq._terrain(spark, sf_dir), rq._mask(), "zero_ros")
    begun, rings = fires.grow_places(load(spark, sf_dir, "ignitions"), ground, rq._timeline(spark, 10), 480, grid.bounds(ground))
    return fires.of_fires(begun, fires.measured(rings)).select("fire_id", "t_min", _r("area_ha", "area_ha", 3), _r("perimeter_m", "perimeter_m", 3))


@query()
def fire_final_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = fires.final_rings(rq._grown(spark, sf_dir))
    return last.groupBy("fire_id", "t_min").agg(F.count("*").alias("n_vertices"))


# --- maps ---------------------------------------------------------------------------------------

_TILES = f"""(select grid_row, grid_col, x, y, t tile, case when t = 0 and p_size % 3 = 0 then null when t = 1 and p_size % 7 = 0 then null else elev + t end v from {duck('cells')}, (select unnest([0, 1]) t) where t = 0 or grid_col > 20)"""


@query(f"select grid_row, grid_col, coalesce(max(v) filter (tile = 0), max(v) filter (tile = 1)) v from {_TILES} where x between 100 and 1300 group by 1, 2")
def raster_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles as one grid, cut to a box: the first tile that has a value counts."""
    cells = load(spark, sf_dir, "cells")
    first = cells.select("grid_row", "grid_col", "x", "y", F.lit(0).alias("tile"), F.when(F.col("p_size") % 3 != 0, F.col("elev")).alias("v"))
    second = cells.where("grid_col > 20").select("grid_row", "grid_col", "x", "y", F.lit(1).alias("tile"), F.when(F.col("p_size") % 7 != 0, F.col("elev") + 1).alias("v"))
    return climate.mosaic(first.unionByName(second), "v", "tile", (100.0, -1e9, 1300.0, 1e9)).select("grid_row", "grid_col", "v")


_BOXES = "(select distinct station_code, longitude - 0.5e0 west, latitude - 0.25e0 south, longitude + 0.5e0 east, latitude + 0.25e0 north from station where longitude is not null and latitude is not null)"
_N, _C, _RHO0 = "0.8093559065590653e0", "1.6497467841324622e0", "5629257.038419455e0"
_S = "sin(radians(la))"
_AQ = f"(0.9933056199770992e0 * ({_S} / (1 - 0.006694380022900787e0 * {_S} * {_S}) - ln((1 - 0.08181919104281579e0 * {_S}) / (1 + 0.08181919104281579e0 * {_S})) / 0.16363838208563158e0))"
_RHO = f"(6378137e0 * sqrt({_C} - {_N} * {_AQ}) / {_N})"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/station.parquet").where("longitude is not null and latitude is not null")
    x, y = F.col("longitude"), F.col("latitude")
    return s.select("station_code", (x - 0.5).alias("west"), (y - 0.25).alias("south"), (x + 0.5).alias("east"), (y + 0.25).alias("north")).distinct()


@query(f"""with c as (select b.*, unnest([west, west, east, east]) lo, unnest([south, north, south, north]) la from {_BOXES} b),
    p as (select station_code, west, south, 1000000e0 + {_RHO} * sin({_N} * radians(lo + 126)) px, {_RHO0} - {_RHO} * cos({_N} * radians(lo + 126)) py from c)
    select station_code, round(min(px), 3) west, round(min(py), 3) south, round(max(px), 3) east, round(max(py), 3) north from p group by station_code, p.west, p.south""")
def bbox_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in an equal-area projection: the bounds of their corners."""
    out = climate.projected_boxes(_boxes(spark, sf_dir), 3005)
    return out.select("station_code", *[_r(c, c, 3) for c in ("west", "south", "east", "north")])


@query(f"select station_code from {_BOXES} where west < -60 and east > -120 and south < 58 and north > 50")
def tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of an index that overlap a box."""
    return climate.tiles_within(_boxes(spark, sf_dir), (-120.0, 50.0, -60.0, 58.0)).select("station_code")


_GRIDDED = "(select event_id, ts, ((event_id * 7) % 360)::double lon, ((event_id * 11) % 180 - 90)::double lat, value from events)"


def _gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("time"), ((F.col("event_id") * 7) % 360).cast("double").alias("lon"), ((F.col("event_id") * 11) % 180 - 90).cast("double").alias("lat"), F.col("value").alias("2m_temperature"), "user_id")


@query(f"select lat, case when lon > 180 then lon - 360 else lon end lon, count(*) n, round(sum(value), 4) t2m from {_GRIDDED} where lat between 40 and 60 and lon between 235 and 310 and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-21' group by 1, 2")
def weather_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded weather of a box and span of days, its longitudes counted from 0 to 360."""
    rows = climate.weather_window(_gridded(spark, sf_dir), (-125.0, 40.0, -50.0, 60.0), "2024-01-03", "2024-01-20")
    return rows.groupBy("lat", "lon").agg(F.count("*").alias("n"), _r(F.sum("t2m"), "t2m", 4))


@query(f"select lat, case when lon > 180 then lon - 360 else lon end lon, count(*) n from {_GRIDDED} where lat between -10 and 10 and (lon >= 340 or lon <= 30) group by 1, 2")
def window_across_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window over the zero meridian takes both sides of it."""
    return climate.weather_window(_gridded(spark, sf_dir), (-20.0, -10.0, 30.0, 10.0), "2000-01-01", "2100-01-01").groupBy("lat", "lon").agg(F.count("*").alias("n"))


@query("select l_suppkey, year(l_shipdate) as year, max(l_quantity)::double burn_day from lineitem where l_quantity > 0 group by 1, 2")
def yearly_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value of each cell and year."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", F.col("l_quantity").cast("double").alias("burn_day"))
    return climate.yearly_greatest(rows, ["l_suppkey"], "l_shipdate", "burn_day")


_BURNED = "(select s_suppkey, -140e0 + (s_suppkey * 13) % 90 west, 42e0 + (s_suppkey * 7) % 40 south, -139e0 + (s_suppkey * 13) % 90 east, 43e0 + (s_suppkey * 7) % 40 north, 2000 + s_suppkey % 20 as year, (s_suppkey % 50) * 1.5e0 size_ha from supplier)"


@query(f"select year, count(*) n_fires, round(sum(size_ha), 4) size_ha from {_BURNED} where west < -80 and east > -125 and south < 65 and north > 45 and year between 2003 and 2012 group by 1")
def burned_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burned areas of a box by year."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    west, south = -140.0 + (k * 13) % 90, 42.0 + (k * 7) % 40
    burned = s.select(west.alias("west"), south.alias("south"), (west + 1).alias("east"), (south + 1).alias("north"), (2000 + k % 20).cast("long").alias("year"), ((k % 50) * 1.5).alias("size_ha"))
    _, sums = climate.burned_extract(burned, (-125.0, 45.0, -80.0, 65.0), 2003, 2012)
    return sums.select("year", "n_fires", _r("size_ha", "size_ha", 4))


@query("select station_code, longitude lon, latitude lat from station where longitude between -120 and -70 and latitude between 49 and 57")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections within a box."""
    s = spark.read.parquet(f"{sf_dir}/station.parquet")
    return climate.within(s.select("station_code", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")), (-120.0, 49.0, -70.0, 57.0))


@query("select year(d)::int as year, month(d)::int as month from (select unnest(generate_series(timestamp '2020-11-01', timestamp '2021-03-01', interval 1 month)) d)")
def months_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that a span of days touches."""
    return climate.months_of(spark, "2020-11-17", "2021-03-02")


# --- points in regions --------------------------------------------------------------------------

_STAR = """(select s_suppkey region_id, i::int vertex_id, -1450000e0 + (s_suppkey * 6007) % 600000 + (case when i % 2 = 0 then 9000e0 else 3500e0 end) * cos(2e0 * pi() * i / 14e0) x,
    450000e0 + (s_suppkey * 7919) % 55000 + (case when i % 2 = 0 then 9000e0 else 3500e0 end) * sin(2e0 * pi() * i / 14e0) y from supplier cross join (select unnest(range(14)) i))"""


def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i = F.col("s_suppkey"), F.col("i")
    each = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("i"))
    far, turn = F.when(i % 2 == 0, 9000.0).otherwise(3500.0), 2.0 * F.pi() * i / 14.0
    x, y = -1450000.0 + (k * 6007) % 600000 + far * F.cos(turn), 450000.0 + (k * 7919) % 55000 + far * F.sin(turn)
    return each.select(k.alias("region_id"), i.alias("vertex_id"), x.alias("x"), y.alias("y"))


_HELD = f"""with v as {_STAR}, n as (select *, lead(x, 1) over w lx, lead(y, 1) over w ly, first_value(x) over w fx, first_value(y) over w fy from v window w as (partition by region_id order by vertex_id)),
    e as (select region_id, x x0, y y0, coalesce(lx, fx) x1, coalesce(ly, fy) y1 from n),
    p as (select distinct ignition_id, x, y from ignition where ignition_id is not null and isfinite(x) and isfinite(y)),
    h as (select ignition_id, p.x, p.y, region_id from p join e on (y0 > y) <> (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0) group by 1, 2, 3, 4 having count(*) % 2 = 1)"""


@query(f"{_HELD} select distinct ignition_id, region_id from h")
def p2_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ignition with the regions (stars that overlap in places) that hold it."""
    points = spark.read.parquet(f"{sf_dir}/ignition.parquet").select("ignition_id", "x", "y").where("ignition_id is not null")
    return regions.points_in_regions(points, regions.outlines(_stars(spark, sf_dir)), 10_000.0, "ignition_id")


@query(f"{_HELD} select ignition_id, min(region_id) region_id from h group by 1")
def p2_region_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region for each ignition that is in any."""
    return regions.owners(p2_regions(spark, sf_dir), "ignition_id")
