"""Fire fronts: one step as relations, whole fires as tasks, and their summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernbrand.functions import fronts, ros
from fernbrand.operators.cells import crossed, fuel_rates, metres_per_degree
from fernbrand.operators.quantiles import exact_quantiles
from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small


def _around(keys: list[str]):
    """The vertices before and after, around the ring, of ``x`` and ``y``."""
    order = Window.partitionBy(*keys).orderBy("vertex_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    before = lambda c: F.coalesce(F.lag(c).over(order), F.last(c).over(whole))
    return before, after


def derivatives(rings: DataFrame, keys: list[str]) -> DataFrame:
    """``xs``, ``ys``: unit tangents; 0 where the neighbours coincide."""
    before, after = _around(keys)
    change = rings.withColumns({"_dx": after("x") - before("x"), "_dy": after("y") - before("y")})
    size = F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2)
    return change.select(*rings.columns, F.when(size > 0, F.col("_dx") / size).otherwise(0.0).alias("xs"), F.when(size > 0, F.col("_dy") / size).otherwise(0.0).alias("ys"))


def front_velocity(rings: DataFrame, keys: list[str]) -> DataFrame:
    """``vx``, ``vy`` from ``xs``, ``ys``, ``head_ros``, ``back_ros``, ``flank_ros`` and ``azimuth`` (degrees)."""
    along, offset, across = (F.col("head_ros") + F.col("back_ros")) / 2, (F.col("head_ros") - F.col("back_ros")) / 2, F.col("flank_ros")
    placed = rings.withColumns({"_a": along, "_c": offset, "_cos": F.cos(F.radians("azimuth")), "_sin": F.sin(F.radians("azimuth"))})
    placed = placed.withColumns({"_u": F.col("xs") * F.col("_cos") - F.col("ys") * F.col("_sin"), "_v": F.col("xs") * F.col("_sin") + F.col("ys") * F.col("_cos")})
    a2, b2, u, v, cos, sin = F.col("_a") ** 2, across**2, F.col("_u"), F.col("_v"), F.col("_cos"), F.col("_sin")
    size = F.sqrt(a2 * u**2 + b2 * v**2) + fronts.STILL
    vx, vy = (b2 * cos * v - a2 * sin * u) / size + F.col("_c") * sin, (-b2 * sin * v - a2 * cos * u) / size + F.col("_c") * cos
    return placed.select(*rings.columns, vx.alias("vx"), vy.alias("vy"))


def ring_measures(rings: DataFrame, keys: list[str], latitude: float | None = None) -> DataFrame:
    """``area_ha`` and ``perimeter_m`` of each ring. ``latitude``: coordinates are degrees, and metres those at that latitude."""
    _, after = _around(keys)
    if latitude is not None:
        wide, high = metres_per_degree(latitude)
        # Distances from the ring's own mean, so that products of large coordinates don't cancel.
        group = Window.partitionBy(*keys)
        rings = rings.withColumns({"x": (F.col("x") - F.avg("x").over(group)) * wide, "y": (F.col("y") - F.avg("y").over(group)) * high})
    pairs = rings.withColumns({"_x": after("x"), "_y": after("y")})
    area = F.abs(F.sum(F.col("x") * F.col("_y") - F.col("_x") * F.col("y"))) / 2 / 10_000
    length = F.sum(F.sqrt((F.col("_x") - F.col("x")) ** 2 + (F.col("_y") - F.col("y")) ** 2))
    return pairs.groupBy(*keys).agg(area.alias("area_ha"), length.alias("perimeter_m"))


def turning(points: DataFrame, rings: DataFrame, keys: list[str]) -> DataFrame:
    """``turning_number`` of each point (``px``, ``py``, ``point_id``) in the ring of its key.

    Joined by key only: a ring has some hundred vertices.
    """
    _, after = _around(keys)
    pairs = rings.withColumns({"_x": after("x"), "_y": after("y")})
    joined = points.join(pairs, keys)
    angle = lambda x, y: F.atan2(F.col(y) - F.col("py"), F.col(x) - F.col("px"))
    turn = F.pmod(angle("_x", "_y") - angle("x", "y") + F.pi(), 2 * F.pi()) - F.pi()
    return joined.groupBy(*keys, "point_id").agg(F.rint(F.sum(turn) / (2 * F.pi())).cast("int").alias("turning_number"))


#: Steps times fuels whose rates the driver holds and sends to the tasks at once.
MOST_RATES = 2_000_000
#: Steps that a task goes before it is given the cells around the front anew.
SLAB = 120
#: Fires of a task, where there are many.
TOGETHER = 50
STATE = "place bigint, step int, spreads boolean, xs array<double>, ys array<double>, t_min double"


def _timeline(weather: DataFrame, first: int, last: int, fuels: list[str], options: dict | None = None) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Steps from ``first`` to before ``last`` that have weather, in order; wind, temperature and humidity of each, and the rates of each fuel (columns)."""
    rows = fuel_rates(weather.where((F.col("step") >= first) & (F.col("step") < last)), fuels, **(options or {})).select("step", "fuel", "head_ros", "wd", "temp", "rh").collect()
    times = sorted({r["step"] for r in rows})
    at = {t: i for i, t in enumerate(times)}
    rates, lines = np.zeros((len(times), len(fuels))), {k: np.zeros(len(times)) for k in ("wd", "temp", "rh")}
    for r in rows:
        rates[at[r["step"]], fuels.index(r["fuel"])] = r["head_ros"]
        for k, line in lines.items():
            line[at[r["step"]]] = r[k]
    return np.array(times, int), lines, rates


def on_grid(ignitions: DataFrame, grid: dict) -> DataFrame:
    """Ignitions between the centres of the grid's outermost cells."""
    return ignitions.where(F.col("x").between(grid["x0"], grid["x1"]) & F.col("y").between(grid["y0"], grid["y1"]))


def grow_fires(ignitions: DataFrame, cells: DataFrame, weather: DataFrame, steps: int, grid: dict, *args, **options) -> DataFrame:
    """Stored rings of each fire (``fire_id``, ``x``, ``y``), a row a vertex. A fire off the grid has no ring.

    Arguments are those of ``grow_places``.
    """
    fires_, rings = grow_places(ignitions, cells, weather, steps, grid, *args, **options)
    return _vertices(of_fires(fires_, rings))


def grow_places(
    ignitions: DataFrame, cells: DataFrame, weather: DataFrame, steps: int, grid: dict, n: int = 300, radius: float = 0.5, every: int = 10, markers: bool = True, dt: float = 1.0,
    least: float = 0.01, strength: float = 0.5, back_share: float = 0.2, length_to_breadth: float = 2.0, lookup: dict[int, str] | None = None, latitude: float | None = None, marker_step: float = 1.0,
    slab: int = SLAB, fuel_options: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fires on the grid (``fire_id``, ``place``) and the stored rings of each place (``place``, ``t_min``, arrays ``xs``, ``ys``).

    Fires that begin at one point burn alike: the point is a place, and is grown once for all of them.
    ``cells``: ``grid_row``, ``grid_col``, ``fuel_id``, ``elev``, ``slope_deg``, ``aspect_deg``, ``zero_ros``;
    ``weather``: ``step``, ``isi``, ``bui``, ``wd``, ``temp``, ``rh``; its last step holds on. ``grid`` as ``cells.bounds``
    gives it. ``latitude``: coordinates are degrees; rates are over the mean of the metres of a
    degree of longitude and latitude there. The grid of rates by steps is never made: the rates of
    each fuel on the grid at each step, which are few, go to every task, and the rest follows from
    the cell. Fires go ``slab`` steps at a time: in these no front can leave the square
    of the sum of the greatest rates around it, so only that square's cells are joined to it.
    Between slabs fronts are written, so lost executors cost a slab at most.
    """
    spark, size, left, top = ignitions.sparkSession, grid["size"], grid["left"], grid["top"]
    scale = 1.0 if latitude is None else sum(metres_per_degree(latitude)) / 2
    # Terrain is written once, not made anew for each slab.
    named = cut(cells.select("grid_row", "grid_col", "elev", "slope_deg", "aspect_deg", "zero_ros", ros.fuel_name(F.col("fuel_id"), lookup).alias("_name")))
    facts = named.agg(F.max(F.when(~F.isnan("slope_deg"), F.col("slope_deg"))).alias("slope"), F.collect_set("_name").alias("fuels")).first()
    fuels = [f for f in ros.FUELS if f in (facts["fuels"] or [])] + ["NF"]
    steepest = 1.3 * (1 + abs(strength) * np.tan(np.radians(min(facts["slope"] or 0.0, 89.0))))
    number = F.lit(len(fuels) - 1)
    for i, f in enumerate(fuels):
        number = F.when(F.col("_name") == f, i).otherwise(number)
    # Tiles of a fixed side, whatever the reach, so that the cells are laid out once.
    tile = 64
    tiled = lambda c: F.floor(c / tile).cast("int")
    ground = named.select("grid_row", "grid_col", number.alias("fuel"), "elev", "slope_deg", "aspect_deg", "zero_ros", tiled(F.col("grid_row")).alias("_tr"), tiled(F.col("grid_col")).alias("_tc"))
    turn = [2 * np.pi * i / n for i in range(n)]
    ring = lambda c, f: F.transform(F.array(*[F.lit(float(v)) for v in turn]), lambda a: F.col(c) + radius / scale * f(a))
    begun = cut(on_grid(ignitions, grid).select(F.col("fire_id").cast("long").alias("fire_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct())
    places = cut(begun.select("x", "y").distinct().withColumn("place", F.monotonically_increasing_id()))
    same = broadcast_if_small(places.withColumnsRenamed({"x": "_x", "y": "_y"}))
    fires_ = begun.join(same, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).select("fire_id", "place")
    start = places.select("place", F.lit(0).alias("step"), F.lit(True).alias("spreads"), ring("x", F.cos).alias("xs"), ring("y", F.sin).alias("ys"))
    state = cut(start.withColumn("t_min", F.lit(0.0)))
    stored = [state]
    last_weather = weather.agg(F.max("step")).first()[0]
    if last_weather is None:
        return fires_, state.select("place", "t_min", "xs", "ys")
    slab = max(1, min(slab, MOST_RATES // len(fuels)))
    for first in range(0, steps, slab):
        end = min(first + slab, steps)
        times, lines, rates = _timeline(weather, min(first, last_weather), max(end, min(first, last_weather) + 1), fuels, fuel_options)
        held = np.clip(np.searchsorted(times, np.arange(first, end), "right") - 1, 0, max(len(times) - 1, 0))
        reach = float(rates.max(1)[held].sum() * steepest * dt) / scale + 2 * size
        near = {
            "_r0": F.floor((top - F.array_max("ys") - reach) / size), "_r1": F.floor((top - F.array_min("ys") + reach) / size),
            "_c0": F.floor((F.array_min("xs") - reach - left) / size), "_c1": F.floor((F.array_max("xs") + reach - left) / size),
        }
        inside = {k: F.least(F.greatest(v, F.lit(0)), F.lit(grid["rows" if "r" in k else "cols"] - 1)).cast("int") for k, v in near.items()}
        front = state.where("spreads").select("place", "xs", "ys")
        burning = front.count()
        if not burning:
            break
        wanted = front.withColumns(inside).select("place", "_r0", "_r1", "_c0", "_c1", F.explode(F.sequence(tiled(F.col("_r0")), tiled(F.col("_r1")))).alias("_wr"))
        wanted = wanted.select("*", F.explode(F.sequence(tiled(F.col("_c0")), tiled(F.col("_c1")))).alias("_wc"))
        joined = wanted.join(ground, (F.col("_wr") == F.col("_tr")) & (F.col("_wc") == F.col("_tc")))
        joined = joined.where(F.col("grid_row").between(F.col("_r0"), F.col("_r1")) & F.col("grid_col").between(F.col("_c0"), F.col("_c1")))
        joined = joined.select(F.col("place").alias("fire"), "grid_row", "grid_col", "fuel", "elev", "slope_deg", "aspect_deg", "zero_ros")
        settings = (first, end, held, lines, rates, left, top, size, scale, dt, least, every, markers, marker_step, strength, back_share, length_to_breadth)
        # Small rings are long work: as many tasks as that takes, not as few as their bytes would fill.
        tasks = min(burning, max(4 * spark.sparkContext.defaultParallelism, burning // TOGETHER))
        grown = cut(joined.repartition(tasks, "fire").groupBy("fire").cogroup(front.repartition(tasks, "place").groupBy("place")).applyInPandas(_stepper(settings), STATE))
        stored.append(grown.where("t_min is not null"))
        state = grown.where("t_min is null")
    return fires_, reduce(DataFrame.unionByName, stored).select("place", "t_min", "xs", "ys")


def of_fires(fires_: DataFrame, by_place: DataFrame) -> DataFrame:
    """What is known of each place (rings, or measures of them), for each fire that began there."""
    small = broadcast_if_small(fires_.withColumnRenamed("place", "_place"))
    return by_place.join(small, F.col("place") == F.col("_place")).drop("place", "_place").select("fire_id", *[c for c in by_place.columns if c != "place"])


def measured(rings: DataFrame) -> DataFrame:
    """As ``ring_measures`` in metres, of rings held as arrays ``xs``, ``ys``; other columns stay."""
    kept = [c for c in rings.columns if c not in ("xs", "ys")]

    def sizes(batches):
        for batch in batches:
            held = [np.stack([np.asarray(batch.column(c)[i].values) for c in ("xs", "ys")], 1) for i in range(batch.num_rows)]
            by = [pa.array([f(r) for r in held], pa.float64()) for f in (lambda r: fronts.area(r) / 10_000, fronts.perimeter)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *by], names=[*kept, "area_ha", "perimeter_m"])

    return rings.mapInArrow(sizes, rings.select(*kept, F.lit(0.0).alias("area_ha"), F.lit(0.0).alias("perimeter_m")).schema)


def _stepper(settings: tuple):
    def one(ground: pd.DataFrame, front: pd.DataFrame) -> pd.DataFrame:
        return _slab(ground, front, *settings)

    return one


def _vertices(rings: DataFrame) -> DataFrame:
    """A row a vertex of rings held as arrays."""
    each = rings.select("fire_id", "t_min", F.posexplode(F.arrays_zip("xs", "ys")).alias("vertex_id", "p"))
    return each.select("fire_id", "t_min", F.col("vertex_id").cast("int").alias("vertex_id"), F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


def _slab(ground, front, first, end, held, lines, rates, left, top, size, scale, dt, least, every, markers, marker_step, strength, back_share, length_to_breadth) -> pd.DataFrame:
    """A place's stored rings in a slab of steps, and the ring at its end (without a time)."""
    out = lambda fire, rings: pd.DataFrame({
        "place": [fire] * len(rings), "step": [end] * len(rings), "spreads": [r[2] for r in rings], "xs": [r[1][:, 0] for r in rings], "ys": [r[1][:, 1] for r in rings],
        "t_min": pd.array([r[0] for r in rings], "Float64"),
    })
    if not len(front):
        return pd.DataFrame({c.split()[0]: [] for c in STATE.split(", ")})
    fire, ring = front["place"].iloc[0], np.stack([np.asarray(front["xs"].iloc[0], float), np.asarray(front["ys"].iloc[0], float)], 1)
    if not len(ground):
        return out(fire, [(None, ring, False)])
    rows, cols = np.arange(ground["grid_row"].min(), ground["grid_row"].max() + 1), np.arange(ground["grid_col"].min(), ground["grid_col"].max() + 1)
    at = (ground["grid_row"] - rows[0], ground["grid_col"] - cols[0])

    def plane(values, empty):
        grid = np.full((len(rows), len(cols)), empty)
        grid[at] = values
        return grid

    fuel = plane(ground["fuel"], rates.shape[1] - 1)
    elev, slope, aspect = (plane(ground[c].astype(float), np.nan) for c in ("elev", "slope_deg", "aspect_deg"))
    open_ = plane(~ground["zero_ros"].fillna(False).astype(bool), False)
    xs, ys = left + (cols + 0.5) * size, top - (rows + 0.5) * size
    known: dict[int, np.ndarray] = {}

    def heads(k: int) -> np.ndarray:
        if k not in known:
            known.clear()
            known[k] = ros.head_plane(rates[k][fuel], open_, elev, slope, aspect, lines["wd"][k], lines["temp"][k], lines["rh"][k], strength)
        return known[k]

    def sample(step: int, vertices: np.ndarray):
        k = held[step - first]
        head = fronts.bilinear(heads(k), xs, ys, vertices)
        back = back_share * head
        return head, back, (head + back) / (2 * length_to_breadth), np.full(len(vertices), np.radians((lines["wd"][k] + 180) % 360))

    stored, ring, spreads = fronts.grow(ring, sample, first, end, dt, least, every, markers, marker_step, scale)
    return out(fire, [(t, r, False) for t, r in stored] + [(None, ring, spreads)])


def summaries(ignitions: DataFrame, rings: DataFrame, latitude: float | None = None) -> DataFrame:
    """A row for each ignition, with ``area_ha``, ``perimeter_m`` and ``dur_min`` of its last ring; 0 where it has none."""
    measured = ring_measures(final_rings(rings), ["fire_id", "t_min"], latitude).select(F.col("fire_id").alias("_f"), "area_ha", "perimeter_m", F.col("t_min").alias("dur_min"))
    return ignitions.join(measured, F.col("fire_id") == F.col("_f"), "left").drop("_f").fillna(0.0, ["area_ha", "perimeter_m", "dur_min"])


def final_rings(rings: DataFrame) -> DataFrame:
    """The last stored ring of each fire.

    The times, which are few, may be broadcast; the vertices never are, however small their source seems.
    """
    last = cut(rings.groupBy("fire_id").agg(F.max("t_min").alias("_t")).withColumnRenamed("fire_id", "_f"))
    last = broadcast_if_small(last.hint("merge"))
    return rings.join(last, (F.col("fire_id") == F.col("_f")) & (F.col("t_min") == F.col("_t"))).drop("_f", "_t")


def cells_inside(rings: DataFrame, grid: dict) -> DataFrame:
    """``fire_id``, ``grid_row``, ``grid_col`` of the cells whose centre lies strictly in a ring.

    A ring is cut along each row of cells that it spans, and every span between two cuts gives its
    first and last column: no cell is compared with any ring, and the work is that of the result.
    """
    left, top, size = grid["left"], grid["top"], grid["size"]
    _, after = _around(["fire_id"])
    edges = rings.withColumns({"_x": after("x"), "_y": after("y")})
    low, high = F.least("y", "_y"), F.greatest("y", "_y")
    # The centre of row k is at top - (k + 0.5) * size; an edge crosses it if low <= centre < high.
    first, last = F.floor((top - high) / size - 0.5) + 1, F.floor((top - low) / size - 0.5)
    first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(grid["rows"] - 1))
    crossed = edges.withColumns({"_a": first, "_b": last}).where(F.col("_a") <= F.col("_b")).withColumn("_k", F.explode(F.sequence("_a", "_b")))
    centre = top - (F.col("_k") + 0.5) * size
    cut_ = crossed.select("fire_id", "_k", (F.col("x") + (centre - F.col("y")) / (F.col("_y") - F.col("y")) * (F.col("_x") - F.col("x"))).alias("_cx"))
    order = Window.partitionBy("fire_id", "_k").orderBy("_cx")
    spans = cut_.withColumns({"_i": F.row_number().over(order), "_end": F.lead("_cx").over(order)}).where((F.col("_i") % 2 == 1) & F.col("_end").isNotNull())
    begin = F.greatest(F.floor((F.col("_cx") - left) / size - 0.5) + 1, F.lit(0))
    end = F.least(F.ceil((F.col("_end") - left) / size - 0.5) - 1, F.lit(grid["cols"] - 1))
    wide = spans.withColumns({"_c0": begin, "_c1": end}).where(F.col("_c0") <= F.col("_c1"))
    return wide.select("fire_id", F.col("_k").cast("int").alias("grid_row"), F.explode(F.sequence(F.col("_c0").cast("int"), F.col("_c1").cast("int"))).alias("grid_col")).distinct()


def cells_touched(rings: DataFrame, grid: dict) -> DataFrame:
    """As ``cells_inside``, with the cells whose squares the ring itself passes."""
    _, after = _around(["fire_id"])
    edges = rings.select("fire_id", F.col("x").alias("ax"), F.col("y").alias("ay"), after("x").alias("bx"), after("y").alias("by"))
    passed = crossed(edges, grid["left"], grid["top"], grid["size"], 0.0).where(F.col("grid_row").between(0, grid["rows"] - 1) & F.col("grid_col").between(0, grid["cols"] - 1))
    return cells_inside(rings, grid).unionByName(passed.select("fire_id", "grid_row", "grid_col")).distinct()


def rasterise(cells: DataFrame, inside: DataFrame, values: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """``cells`` with the ``value`` of the shape (``fire_id``) that holds each, of several the last; ``fill`` outside all."""
    best = inside.join(values.select("fire_id", value), "fire_id").groupBy("grid_row", "grid_col").agg(F.max_by(value, "fire_id").alias(value))
    return cells.join(best, ["grid_row", "grid_col"], "left").fillna(fill, [value])


def burn_probability(rings: DataFrame, cells: DataFrame, grid: dict) -> DataFrame:
    """Share of the rings that strictly hold each cell's centre."""
    n = rings.select("fire_id").distinct().count()
    held = cells_inside(rings, grid).groupBy("grid_row", "grid_col").agg(F.count("*").alias("_n"))
    return cells.select("grid_row", "grid_col").join(held, ["grid_row", "grid_col"], "left").select("grid_row", "grid_col", (F.coalesce("_n", F.lit(0)) / float(max(n, 1))).alias("burn_probability"))


def clip_rings(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rings cut to a box (west, south, east, north), one side of it after another; rings outside it are left out.

    Each vertex within a side stays, and an edge that crosses the side gives the point where it does.
    """
    out = rings.select("fire_id", "vertex_id", "x", "y")
    _, after = _around(["fire_id"])
    order = Window.partitionBy("fire_id").orderBy("vertex_id", "_half")
    for axis, bound, sign in (("x", box[0], 1.0), ("y", box[1], 1.0), ("x", box[2], -1.0), ("y", box[3], -1.0)):
        pairs = out.withColumns({"_x": after("x"), "_y": after("y")})
        a, b = sign * (F.col(axis) - bound), sign * (F.col(f"_{axis}") - bound)
        t = a / (a - b)
        kept = F.struct(F.lit(0).alias("h"), F.col("x").alias("x"), F.col("y").alias("y"))
        crossing = F.struct(F.lit(1).alias("h"), (F.col("x") + t * (F.col("_x") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("_y") - F.col("y"))).alias("y"))
        points = F.array_compact(F.array(F.when(a >= 0, kept), F.when((a >= 0) != (b >= 0), crossing)))
        out = pairs.select("fire_id", "vertex_id", F.explode(points).alias("_p")).select("fire_id", "vertex_id", F.col("_p.h").alias("_half"), "_p.x", "_p.y")
        out = out.withColumn("vertex_id", F.row_number().over(order) - 1).drop("_half")
    return out


def size_histogram(results: DataFrame, area: str, bins: int = 30) -> DataFrame:
    """Counts of fires by ``bins`` equal intervals of their area (over 0), with mean and median of all."""
    real = results.where((F.col(area) > 0) & ~F.isnan(area))
    facts = real.agg(F.min(area).alias("low"), F.max(area).alias("high"), F.avg(area).alias("mean")).first()
    low, high, mean = (float("nan") if v is None else float(v) for v in facts)
    median = exact_quantiles(real, {area: [0.5]})[area][0]
    width = (high - low) / bins
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col(area) - low) / width)).cast("int") if width > 0 else F.lit(0)
    counts = real.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n_fires"))
    return counts.select("bin", F.lit(mean).alias("mean_area"), F.lit(median).cast("double").alias("median_area"), "n_fires")


def thin(rings: DataFrame, every: int) -> DataFrame:
    """Every ``every``-th stored ring of a fire, and its last."""
    times = rings.select("fire_id", "t_min").distinct()
    order = Window.partitionBy("fire_id").orderBy("t_min")
    kept = times.withColumns({"_i": F.row_number().over(order) - 1, "_last": F.lead("t_min").over(order).isNull()}).where((F.col("_i") % every == 0) | F.col("_last"))
    return rings.join(kept.select("fire_id", "t_min"), ["fire_id", "t_min"], "left_semi")


def extent(points: DataFrame, margin: float = 0.1) -> DataFrame:
    """Bounds of the points, widened by a share of the greater side."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    by = margin * F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return box.select((F.col("x0") - by).alias("x_min"), (F.col("x1") + by).alias("x_max"), (F.col("y0") - by).alias("y_min"), (F.col("y1") + by).alias("y_max"))


def overlaps(box: tuple[float, float, float, float], x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether boxes overlap (west, south, east, north)."""
    return (x0 < box[2]) & (x1 > box[0]) & (y0 < box[3]) & (y1 > box[1])


def ignition_diagnostics(points: DataFrame, cells: DataFrame, row: Column, col: Column, values: list[str]) -> DataFrame:
    """``points`` with the values of the cell that holds each; null outside the grid."""
    side = cells.select(F.col("grid_row").alias("_gr"), F.col("grid_col").alias("_gc"), *values)
    return points.withColumns({"_pr": row, "_pc": col}).join(side, (F.col("_pr") == F.col("_gr")) & (F.col("_pc") == F.col("_gc")), "left").drop("_pr", "_pc", "_gr", "_gc")


def rate_statistics(rates: DataFrame, value: str = "head_ros") -> DataFrame:
    """Least, greatest and mean rate over 0, their number, and the 99th percentile of all."""
    v = F.when(~F.isnan(value), F.col(value))
    positive = F.when(v > 0, v)
    high = exact_quantiles(rates, {value: [0.99]})[value][0]
    return rates.agg(F.min(positive).alias("least"), F.max(positive).alias("most"), F.avg(positive).alias("mean"), F.count(positive).alias("n")).withColumn("p99", F.lit(high).cast("double"))
