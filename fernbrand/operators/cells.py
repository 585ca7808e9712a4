"""Grids as tables of cells (``grid_row``, ``grid_col``): terrain, fuel and rates of spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernbrand.functions import ros
from fernbrand.operators.quantiles import exact_quantiles
from fernbrand.sizing import broadcast_if_small

NON_FUEL = (0, 101, 102, 106, -9999)


def _step(value: str, along: str, across: str, size: float) -> Column:
    """Change per unit along an axis: central inside, one-sided at edges; a single cell has none."""
    order = Window.partitionBy(across).orderBy(along)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    return F.when(before.isNull(), (after - F.col(value)) / size).when(after.isNull(), (F.col(value) - before) / size).otherwise((after - before) / (2 * size))


#: Metres of a degree of latitude.
DEGREE = 111_320.0


def is_geographic(crs: str | None, size: float) -> bool:
    """Whether coordinates are degrees: by the system's name, or, without one, by cells smaller than 1."""
    if crs:
        return crs.strip().upper().removeprefix("EPSG:") in ("4326", "4269", "4258", "CRS84", "OGC:CRS84", "WGS84")
    return abs(size) < 1


def metres_per_degree(latitude: float) -> tuple[float, float]:
    """Metres of a degree of longitude and of latitude."""
    return DEGREE * math.cos(math.radians(latitude)), DEGREE


def slope_aspect(cells: DataFrame, elevation: str = "elev", size: float = 30.0, size_y: float | None = None) -> DataFrame:
    """``slope_deg`` (0 to 90) and ``aspect_deg`` (null on flat ground) of every cell.

    Missing heights take the median of all for their neighbours' sake, and have no slope
    themselves. Rows run from north to south; ``size`` and ``size_y`` are the sides of a cell in metres.
    """
    known = F.col(elevation).isNotNull() & ~F.isnan(elevation)
    holes = cells.where(~known).limit(1).count()
    middle = exact_quantiles(cells, {elevation: [0.5]})[elevation][0] if holes else None
    filled = cells.withColumn("_z", F.when(known, F.col(elevation)).otherwise(F.lit(middle).cast("double")))
    return _sloped(filled, known, cells.columns, size, size_y or size)


def simple_slope_aspect(cells: DataFrame, elevation: str = "elev", size: float = 30.0, size_y: float | None = None) -> DataFrame:
    """As ``slope_aspect``, without filling: cells beside a missing height have no slope either."""
    z = F.when(~F.isnan(elevation), F.col(elevation))
    out = _sloped(cells.withColumn("_z", F.coalesce(z, F.lit(float("nan")))), F.lit(True), cells.columns, size, size_y or size)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("slope_deg", "aspect_deg")})


def _sloped(filled: DataFrame, known: Column, columns: list[str], size: float, size_y: float) -> DataFrame:
    rise = filled.withColumns({"_dx": _step("_z", "grid_col", "grid_row", size), "_dr": _step("_z", "grid_row", "grid_col", size_y)})
    steep = F.sqrt(F.col("_dx") ** 2 + F.col("_dr") ** 2)
    slope = F.least(F.greatest(F.degrees(F.atan(steep)), F.lit(0.0)), F.lit(90.0))
    aspect = F.pmod(F.degrees(F.atan2(F.col("_dx"), -F.col("_dr"))) + 360.0, F.lit(360.0))
    return rise.select(*columns, F.when(known, slope).alias("slope_deg"), F.when(known & (steep >= 1e-6), aspect).alias("aspect_deg"))


def slope_histogram(cells: DataFrame) -> DataFrame:
    """Cells with slopes under 5, 15, 30, 45 degrees and above."""
    label = F.when(F.col("slope_deg") < 5, "0-5").when(F.col("slope_deg") < 15, "5-15").when(F.col("slope_deg") < 30, "15-30").when(F.col("slope_deg") < 45, "30-45").otherwise("45+")
    return cells.where(F.col("slope_deg").isNotNull()).groupBy(label.alias("slope_class")).agg(F.count("*").alias("n_cells"))


def terrain_statistics(cells: DataFrame, elevation: str = "elev") -> DataFrame:
    """Least, greatest and mean height and slope of the cells that have one."""
    given = {c: F.when(~F.isnan(c), F.col(c)) for c in (elevation, "slope_deg")}
    return cells.agg(*[f(v).alias(f"{n}_{'elev' if c == elevation else 'slope'}") for c, v in given.items() for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))])


def bounds(cells: DataFrame) -> dict[str, float]:
    """Corner and size of a grid's cells, its numbers of rows and columns, and its bounds."""
    c = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.max("grid_col").alias("c"), F.max("grid_row").alias("r")).first()
    if c["x0"] is None:
        raise ValueError("the grid has no cells")
    size = (c["x1"] - c["x0"]) / c["c"] if c["c"] else (c["y1"] - c["y0"]) / c["r"] if c["r"] else 30.0
    return {"left": c["x0"] - size / 2, "top": c["y1"] + size / 2, "size": size, "rows": c["r"] + 1, "cols": c["c"] + 1, "x0": c["x0"], "x1": c["x1"], "y0": c["y0"], "y1": c["y1"]}


def cell_at(x: Column, y: Column, left: float, top: float, size: float) -> tuple[Column, Column]:
    """Row and column of the cell that holds a point."""
    return F.floor((top - y) / size).cast("int"), F.floor((x - left) / size).cast("int")


def resample_nearest(target: DataFrame, source: DataFrame, value: str, left: float, top: float, size: float) -> DataFrame:
    """``target`` (with ``x``, ``y``) with ``value`` of the ``source`` cell that holds each cell's centre."""
    row, col = cell_at(F.col("x"), F.col("y"), left, top, size)
    side = source.select(F.col("grid_row").alias("_r"), F.col("grid_col").alias("_c"), F.col(value).alias(f"source_{value}"))
    return target.withColumns({"_tr": row, "_tc": col}).join(side, (F.col("_tr") == F.col("_r")) & (F.col("_tc") == F.col("_c")), "left").drop("_tr", "_tc", "_r", "_c")


def near_segment(x: Column, y: Column, ax: float, ay: float, bx: float, by: float, within: float) -> Column:
    """Whether a point lies at most ``within`` from a segment."""
    length = (bx - ax) ** 2 + (by - ay) ** 2
    along = F.least(F.greatest(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / (length or 1.0), F.lit(0.0)), F.lit(1.0))
    return (x - ax - along * (bx - ax)) ** 2 + (y - ay - along * (by - ay)) ** 2 <= within**2


def crossed(segments: DataFrame, left: float, top: float, size: float, within: float) -> DataFrame:
    """Segments (``ax``, ``ay``, ``bx``, ``by``) with the cells (``grid_row``, ``grid_col``) whose squares, widened by ``within``, they cross.

    A segment is cut at the edges of each row of cells, so it yields the cells along it only.
    """
    low, high = F.least("ay", "by") - within, F.greatest("ay", "by") + within
    rows = segments.withColumn("grid_row", F.explode(F.sequence(F.floor((top - high) / size), F.floor((top - low) / size))))
    up, down = top - F.col("grid_row") * size + within, top - (F.col("grid_row") + 1) * size - within
    rise, run = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    t0, t1 = (F.when(rise == 0, F.lit(float(k))).otherwise((edge - F.col("ay")) / rise) for k, edge in ((0, down), (1, up)))
    begin, end = F.greatest(F.least(t0, t1), F.lit(0.0)), F.least(F.greatest(t0, t1), F.lit(1.0))
    x0, x1 = F.col("ax") + begin * run, F.col("ax") + end * run
    cut_ = rows.where(begin <= end).withColumns({"_x0": F.least(x0, x1) - within, "_x1": F.greatest(x0, x1) + within})
    cells = cut_.withColumn("grid_col", F.explode(F.sequence(F.floor((F.col("_x0") - left) / size), F.floor((F.col("_x1") - left) / size))))
    return cells.drop("_x0", "_x1").withColumns({"grid_row": F.col("grid_row").cast("int"), "grid_col": F.col("grid_col").cast("int")})


def cells_crossed(segments: DataFrame, grid: dict) -> DataFrame:
    """Distinct cells whose squares a segment touches."""
    return crossed(segments, grid["left"], grid["top"], grid["size"], 0.0).select("grid_row", "grid_col").distinct()


def cells_near(segments: DataFrame, within: float, grid: dict) -> DataFrame:
    """Distinct cells whose centres lie at most ``within`` from a segment."""
    left, top, size = grid["left"], grid["top"], grid["size"]
    rows = crossed(segments, left, top, size, within)
    x, y = left + (F.col("grid_col") + 0.5) * size, top - (F.col("grid_row") + 0.5) * size
    run, rise = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = run**2 + rise**2
    along = F.when(length > 0, F.least(F.greatest(((x - F.col("ax")) * run + (y - F.col("ay")) * rise) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    near = (x - F.col("ax") - along * run) ** 2 + (y - F.col("ay") - along * rise) ** 2 <= within**2
    return rows.where(near).select("grid_row", "grid_col").distinct()


def masked(cells: DataFrame, hits: DataFrame, name: str = "is_masked") -> DataFrame:
    """``cells`` with whether they are among ``hits`` (``grid_row``, ``grid_col``)."""
    side = hits.select(F.col("grid_row").alias("_hr"), F.col("grid_col").alias("_hc")).distinct()
    joined = cells.join(side, (F.col("grid_row") == F.col("_hr")) & (F.col("grid_col") == F.col("_hc")), "left")
    return joined.withColumn(name, F.col("_hr").isNotNull()).drop("_hr", "_hc")


def raster_mask(cells: DataFrame, layer: DataFrame, value: str, grid: dict, name: str = "is_masked") -> DataFrame:
    """``cells`` with whether the cell of ``layer`` (a grid of its own: ``grid``) at their centre is over 0."""
    found = resample_nearest(cells, layer, value, grid["left"], grid["top"], grid["size"])
    return found.withColumn(name, F.coalesce(F.col(f"source_{value}") > 0, F.lit(False))).drop(f"source_{value}")


def fuel_break(cells: DataFrame, mask: Column, treatment: str, code: int = 101, keep_non_fuel: bool = True) -> DataFrame:
    """Cells under ``mask`` get a fuel code (``fuel_code``) or no spread (``zero_ros``); non-fuel cells stay."""
    hit = mask & ~F.col("fuel_id").isin(*NON_FUEL) if keep_non_fuel else mask
    if treatment == "fuel_code":
        return cells.withColumn("fuel_id", F.when(hit, F.lit(code)).otherwise(F.col("fuel_id")))
    zero = F.col("zero_ros") if "zero_ros" in cells.columns else F.lit(False)
    return cells.withColumn("zero_ros", zero | F.coalesce(hit, F.lit(False)))


def fuel_rates(weather: DataFrame, fuels: list[str] | None = None, **options) -> DataFrame:
    """``weather`` (``isi``, ``bui``) times fuels: ``fuel``, ``head_ros``. Small: fuels by instants.

    ``options`` that are columns (a curing a row, say) need each fuel's own expression; numbers go into a table.
    """
    if not any(isinstance(v, Column) for v in options.values()):
        rows = weather.select("*", F.explode(ros.rate_table(list(fuels or ros.FUELS), **options)).alias("_e"))
        return rows.select(*weather.columns, "_e.fuel", ros.rate_of("_e", F.col("isi"), F.col("bui")).alias("head_ros"))
    entries = F.array(*[F.struct(F.lit(f).alias("fuel"), ros.head_ros(f, F.col("isi"), F.col("bui"), **options).alias("head_ros")) for f in fuels or ros.FUELS])
    return weather.select("*", F.explode(entries).alias("_e")).select(*weather.columns, "_e.fuel", "_e.head_ros")


def spread_grid(
    cells: DataFrame, weather: DataFrame, strength: float = 0.5, back_share: float = 0.2, length_to_breadth: float = 2.0, lookup: dict[int, str] | None = None
) -> DataFrame:
    """Rates of spread of every cell at every instant of ``weather`` (``step``, ``isi``, ``bui``, ``wd``, ``temp``, ``rh``).

    A view, never stored: the rates of each fuel at each instant are few and broadcast, and
    slope, height and barriers are formulas on the cell. Filters on cells and steps reach the scan.
    """
    rates = fuel_rates(weather, [*ros.FUELS, "NF"])
    named = cells.withColumn("_fuel", ros.fuel_name(F.col("fuel_id"), lookup))
    joined = named.join(broadcast_if_small(rates), F.col("_fuel") == F.col("fuel"))
    slope = ros.slope_factor(F.col("slope_deg"), F.col("aspect_deg"), F.col("wd"), strength)
    head = F.when(F.col("zero_ros"), 0.0).otherwise(F.col("head_ros") * slope) * ros.elevation_factor(F.col("elev"), F.col("temp"), F.col("rh"))
    out = joined.withColumn("_head", head)
    back = ros.back_ros(F.col("_head"), back_share)
    return out.select("grid_row", "grid_col", "step", F.col("_head").alias("head_ros"), back.alias("back_ros"), ros.flank_ros(F.col("_head"), back, length_to_breadth).alias("flank_ros"), ros.azimuth(F.col("wd")).alias("azimuth"))


def bilinear_sample(points: DataFrame, cells: DataFrame, value: str | list[str], left: float, top: float, size: float, rows: int, cols: int) -> DataFrame:
    """``points`` (``x``, ``y``) with ``value`` (one or more) interpolated among the four cells around each; clamped to the grid.

    Each row of ``points`` gives one row, repeated ones too; where one of the four cells is missing or
    has no value, or a coordinate isn't given, the value is null.
    """
    values = [value] if isinstance(value, str) else value
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(max(n - 1 - 1e-6, 0.0)))
    given = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    # Values depend on the place only: each place is worked out once, and no row needs a number.
    places = points.where(given).select(F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    placed = places.withColumns({"_c": clamp((F.col("_x") - left) / size - 0.5, cols), "_r": clamp((top - F.col("_y")) / size - 0.5, rows)})
    whole_r, whole_c = F.floor("_r").cast("int"), F.floor("_c").cast("int")
    fr, fc = F.col("_r") - F.floor("_r"), F.col("_c") - F.floor("_c")
    corners = F.array(*[
        F.struct((whole_r + i).alias("r"), (whole_c + j).alias("c"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)
    ])
    each = placed.select("_x", "_y", F.explode(corners).alias("_k")).where("_k.w > 0")
    side = cells.select(F.col("grid_row").alias("_gr"), F.col("grid_col").alias("_gc"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    joined = each.join(side, (F.col("_k.r") == F.col("_gr")) & (F.col("_k.c") == F.col("_gc")), "left")
    known = lambda v: F.count_if(F.col(v).isNull()) == 0
    mixed = joined.groupBy("_x", "_y").agg(*[F.when(known(f"_v{i}"), F.sum(F.col("_k.w") * F.col(f"_v{i}"))).alias(f"_m{i}") for i in range(len(values))])
    out = points.join(mixed, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left")
    return out.select(*[c for c in points.columns if c not in values], *[F.col(f"_m{i}").alias(v) for i, v in enumerate(values)])


def class_mode(rows: DataFrame, keys: list[str], value: str, missing: int = 255) -> DataFrame:
    """The commonest class per key, the least of ties, ``missing`` if there is none."""
    return rows.groupBy(*keys).agg(F.coalesce(F.expr(f"mode(case when {value} <> {missing} then {value} end, true)"), F.lit(missing)).alias(value))
