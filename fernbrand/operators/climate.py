"""Gridded and mapped sources cut to a region: tiles, mosaics, windows, composites, extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand.functions.projections import project
from fernbrand.operators.fires import overlaps

Box = tuple[float, float, float, float]
# Rough outlines (west, south, east, north) of where some sources exist.
REGIONS = {"USA": ((-125.0, 24.0, -66.0, 50.0), (-180.0, 51.0, -129.0, 72.0), (-161.0, 18.0, -154.0, 23.0)), "Canada": ((-141.0, 41.0, -52.0, 84.0),)}
# Names of gridded weather, and those they get.
GRIDDED = {"2m_temperature": "t2m", "total_precipitation": "tp", "10m_u_component_of_wind": "u10", "10m_v_component_of_wind": "v10"}


def tile_names(spark: SparkSession, box: Box, degrees: int = 3) -> DataFrame:
    """``lat``, ``lon`` (south-western corners) and ``tile`` of the tiles that cover a box (west, south, east, north)."""
    down = lambda v: int(v // degrees * degrees)
    lats = F.sequence(F.lit(down(box[1])), F.lit(down(box[3])), F.lit(degrees))
    lons = F.sequence(F.lit(down(box[0])), F.lit(down(box[2])), F.lit(degrees))
    tiles = spark.range(1).select(F.explode(lats).alias("lat")).select("lat", F.explode(lons).alias("lon"))
    part = lambda c, positive, negative, n: F.concat(F.when(F.col(c) >= 0, positive).otherwise(negative), F.lpad(F.abs(F.col(c)).cast("string"), n, "0"))
    return tiles.select("lat", "lon", F.concat(part("lat", "N", "S", 2), part("lon", "E", "W", 3)).alias("tile"))


def date_spans(spark: SparkSession, first: str, last: str, days: int = 10) -> DataFrame:
    """``first_day``, ``last_day`` of spans of ``days`` days from ``first`` to ``last``, the last one cut short."""
    line = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {int(days)} days"))).alias("first_day"))
    return line.select("first_day", F.least(F.date_add("first_day", days - 1), F.lit(last).cast("date")).alias("last_day"))


def months_of(spark: SparkSession, first: str, last: str) -> DataFrame:
    """``year``, ``month`` of the months that a span of days touches."""
    start = F.trunc(F.lit(first).cast("date"), "month")
    line = spark.range(1).select(F.explode(F.sequence(start, F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("d"))
    return line.select(F.year("d").alias("year"), F.month("d").alias("month"))


def in_region(region: str, box: Box) -> bool:
    """Whether a box overlaps a region's outline."""
    return any(box[0] < b[2] and box[2] > b[0] and box[1] < b[3] and box[3] > b[1] for b in REGIONS[region])


def projected_boxes(boxes: DataFrame, epsg: int) -> DataFrame:
    """Boxes (``west``, ``south``, ``east``, ``north``, in degrees) in another system: the bounds of their four corners."""
    corners = [project(F.col(x), F.col(y), epsg) for x in ("west", "east") for y in ("south", "north")]
    bound = lambda f, i: f(*[c[i] for c in corners])
    sides = {"west": bound(F.least, 0), "south": bound(F.least, 1), "east": bound(F.greatest, 0), "north": bound(F.greatest, 1)}
    return boxes.select(*[c for c in boxes.columns if c not in sides], *[v.alias(k) for k, v in sides.items()])


def tiles_within(index: DataFrame, box: Box) -> DataFrame:
    """Rows of an index of tiles (``west``, ``south``, ``east``, ``north``) that overlap a box in the same system."""
    return index.where(overlaps(box, F.col("west"), F.col("south"), F.col("east"), F.col("north")))


def clipped(cells: DataFrame, box: Box) -> DataFrame:
    """Cells whose centres lie in a box; the filter reaches the scan."""
    return cells.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


def mosaic(tiles: DataFrame, value: str, rank: str = "tile", box: Box | None = None) -> DataFrame:
    """One value a cell (``grid_row``, ``grid_col``, ``x``, ``y``) of overlapping tiles: that of the first tile by
    ``rank`` that has one there; null if none has."""
    inside = clipped(tiles, box) if box else tiles
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    first = F.min_by(F.when(known, F.col(value)), F.when(known, F.col(rank)))
    return inside.groupBy("grid_row", "grid_col").agg(F.first("x").alias("x"), F.first("y").alias("y"), first.alias(value))


def east_only(lon: Column) -> Column:
    """A longitude from 0 up to 360."""
    return F.pmod(lon.cast("double") + 360.0, F.lit(360.0))


def weather_window(rows: DataFrame, box: Box, first: str, last: str) -> DataFrame:
    """Gridded weather (``time``, ``lat``, ``lon`` from 0 to 360, and variables) within a box and days, under short names.

    Only known variables and the box's rows are read; a box over the zero meridian takes both sides.
    """
    west, east = (v % 360.0 for v in (box[0], box[2]))
    lon = F.col("lon")
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    kept = rows.where(F.col("lat").between(box[1], box[3]) & across & (F.col("time") >= F.lit(first).cast("timestamp")) & (F.col("time") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")))
    return kept.select("time", "lat", F.when(lon > 180, lon - 360).otherwise(lon).alias("lon"), *[F.col(f"`{c}`").alias(n) for c, n in GRIDDED.items() if c in rows.columns])


def yearly_greatest(rows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Per key and year of ``day``: the greatest value; what isn't over 0 doesn't count."""
    return rows.where(F.col(value) > 0).groupBy(*keys, F.year(day).alias("year")).agg(F.max(value).alias(value))


def burned_extract(shapes: DataFrame, box: Box, first: int, last: int, size: str = "size_ha") -> tuple[DataFrame, DataFrame]:
    """Burned areas (``west`` .. ``north``, ``year``, ``size_ha``) that overlap a box in a span of years, and per year
    their number and the sum of their sizes."""
    kept = tiles_within(shapes, box).where(F.col("year").between(first, last))
    return kept, kept.groupBy("year").agg(F.count("*").alias("n_fires"), F.sum(size).alias(size))


def read_hotspots(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """``lon``, ``lat`` and ``properties`` of the detections of a GeoJSON answer within a box."""
    schema = "features array<struct<geometry: struct<coordinates: array<double>>, properties: map<string, string>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    at = each.select(F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), F.col("f.properties").alias("properties"))
    return within(at, box)


def within(points: DataFrame, box: Box) -> DataFrame:
    """Points (``lon``, ``lat``) within a box."""
    return points.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rows of a point forecast's JSON answer: place, ``ts`` and a column a variable."""
    hourly = "time array<string>, temperature_2m array<double>, relative_humidity_2m array<double>, precipitation array<double>, wind_speed_10m array<double>, wind_direction_10m array<double>"
    raw = spark.read.schema(f"latitude double, longitude double, hourly struct<{', '.join(p.replace(' ', ': ', 1) for p in hourly.split(', '))}>").json(path, multiLine=True)
    names = {"temperature_2m": "temp", "relative_humidity_2m": "rh", "precipitation": "precip", "wind_speed_10m": "ws", "wind_direction_10m": "wd"}
    each = raw.select("latitude", "longitude", "hourly", F.posexplode("hourly.time").alias("i", "t"))
    ts = F.coalesce(F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm")), F.try_to_timestamp("t", F.lit("yyyy-MM-dd'T'HH:mm:ss"))).cast("timestamp_ntz")
    return each.select("latitude", "longitude", ts.alias("ts"), *[F.get(F.col(f"hourly.{c}"), F.col("i")).alias(n) for c, n in names.items()])


def isi_grid(cells: DataFrame, ffmc: str, wind: str) -> DataFrame:
    """``cells`` with the initial spread index of their code and wind, 0 at least and where one is missing."""
    from fernbrand.functions.fwi import isi_or_zero

    return cells.withColumn("isi", F.greatest(isi_or_zero(F.col(ffmc), F.col(wind)), F.lit(0.0)))
