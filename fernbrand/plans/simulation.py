"""A whole run: weather, ground, barriers, ignitions, growth, summary."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand.config import Break, Config, absent
from fernbrand.functions import ros
from fernbrand.operators import cells, fires, fireweather, ignitions
from fernbrand.session import cut
from fernbrand.sources import rasters, tables


def timeline(weather: DataFrame, station: DataFrame | None, settings: Config) -> DataFrame:
    """``step`` and its weather: indices of the representative day throughout; wind, temperature and
    humidity interpolated between readings, if readings have times and the run varies in time."""
    w, sim = settings.weather, settings.simulation
    spark = weather.sparkSession
    days = fireweather.fire_weather_list(weather, station, tuple(w.keep), w.compute_indices, w.latitude, w.event_days_mean, settings.seed, w.high, w.extreme)
    typical = fireweather.representative(days).first().asDict()
    if sim.time_varying and "obs_date" in weather.columns and weather.where("obs_date is not null").limit(1).count():
        start = int(datetime.fromisoformat(sim.start).replace(tzinfo=timezone.utc).timestamp()) if sim.start else fireweather.middle_start(weather, sim.start_hour)
        line = fireweather.weather_sequence(weather, start, sim.steps, sim.dt)
        kept = [c for c in ("isi", "bui") if c not in weather.columns]
        return line.withColumns({c: F.lit(typical[c]) for c in kept}).select("step", "isi", "bui", "wd", "temp", "rh")
    return spark.range(1).select(F.lit(0).alias("step"), *[F.lit(typical[c]).alias(c) for c in ("isi", "bui", "wd", "temp", "rh")])


def with_breaks(ground: DataFrame, box: dict, breaks: tuple[Break, ...], metres: float = 1.0) -> DataFrame:
    """``ground`` under the enabled barriers, in their order; ``metres``: those of a unit of the coordinates."""
    spark = ground.sparkSession
    for b in breaks:
        if not b.enabled:
            continue
        if b.kind == "grid":
            layer = rasters.read_grid(spark, b.path, "value")
            ground = cells.raster_mask(ground, layer, "value", cells.bounds(layer), "_hit")
        else:
            lines = spark.read.parquet(b.path)
            hits = cells.cells_near(lines, b.buffer_m / metres, box)
            ground = cells.masked(ground, hits.unionByName(cells.cells_crossed(lines, box)) if b.all_touched else hits, "_hit")
        ground = cells.fuel_break(ground, F.col("_hit"), b.treatment, b.fuel_code, b.keep_non_fuel).drop("_hit")
    return ground


def starts(spark: SparkSession, settings: Config, ground: DataFrame) -> DataFrame:
    """Ignitions as the settings say: ``fire_id``, ``x``, ``y``, ``cause``, ``season``, ``iteration``."""
    i = settings.ignition
    if i.source == "points":
        points = tables.read_points(spark, settings.inputs.ignitions)
        defaults = {"cause": F.lit(i.cause), "season": F.lit(i.season), "iteration": F.lit(0)}
        given = {c: F.coalesce(F.col(c), v) if c in points.columns else v for c, v in defaults.items()}
        fire = F.col("fire_id").cast("long") if "fire_id" in points.columns else F.monotonically_increasing_id()
        return cut(points.select(fire.alias("fire_id"), "x", "y", *[v.alias(c) for c, v in given.items()]))
    grid = rasters.read_grid(spark, settings.inputs.probabilities, "p")
    fuel = ground.select(F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), "fuel_id")
    grid = grid.drop("fuel_id").join(fuel, (F.col("grid_row") == F.col("_r")) & (F.col("grid_col") == F.col("_c")), "left").drop("_r", "_c")
    lookup = settings.fuel.lookup or ros.FUEL_CODES
    rules = [(code, r.get("cause") or i.cause, r.get("season")) for r in i.rules for code in ignitions.fuel_codes(list(r.get("fuels", [])), lookup)]
    ruled = spark.createDataFrame(rules, "fuel_id int, cause string, season string") if rules else None
    rates = spark.createDataFrame([(int(k), float(v[0]), float(v[1])) for k, v in i.rates.items()], "eco_id int, e_rate double, f_rate double") if i.rates and "eco_id" in grid.columns else None
    return cut(ignitions.monte_carlo(grid, i.n_iterations, i.fires_per_iteration, i.cause, i.season, ruled, rates, settings.seed))


def simulate(weather: DataFrame, station: DataFrame | None, ground: DataFrame, points: DataFrame, settings: Config) -> tuple[DataFrame, DataFrame]:
    """Rings and summary of the fires that begin at ``points`` on ``ground`` (cells with ``elev`` and ``fuel_id``)."""
    box = cells.bounds(ground)
    middle = (box["y0"] + box["y1"]) / 2
    latitude = middle if cells.is_geographic(settings.crs, box["size"]) else None
    wide, high = cells.metres_per_degree(middle) if latitude is not None else (1.0, 1.0)
    if not {"slope_deg", "aspect_deg"} <= set(ground.columns):
        ground = cells.slope_aspect(ground, "elev", box["size"] * wide, box["size"] * high)
    ground = ground if "zero_ros" in ground.columns else ground.withColumn("zero_ros", F.lit(False))
    ground = with_breaks(ground, box, settings.breaks, (wide + high) / 2)
    sim, spread = settings.simulation, settings.spread
    line = cut(timeline(weather, station, settings))
    rings = cut(fires.grow_fires(
        points, ground, line, sim.steps, box, sim.n_vertices, sim.initial_radius, sim.store_every, sim.use_markers, sim.dt, sim.min_ros, spread.slope_strength, spread.backing_share,
        spread.length_to_breadth, settings.fuel.lookup or None, latitude, sim.marker_step, fuel_options={"fmc": spread.fmc, "curing": spread.curing},
    ))
    return rings, fires.summaries(points, rings, latitude)


def run(spark: SparkSession, settings: Config) -> DataFrame:
    """Runs a configuration, writes rings and summary to its output folder, and gives the summary."""
    ground = rasters.read_grid(spark, settings.inputs.cells, "elev")
    # Weather and stations aren't required: what isn't there counts as not named.
    given = {n: None if absent(p := getattr(settings.inputs, n)) else p for n in ("weather", "stations")}
    weather = tables.read_weather(spark, given["weather"], given["stations"], settings.weather.time_form)
    station = tables.read_stations(spark, given["stations"]) if given["stations"] and given["weather"] else None
    rings, summary = simulate(weather, station, ground, starts(spark, settings, ground), settings)
    summary = cut(summary)
    tables.write_results(rings, summary, settings.output)
    return summary
