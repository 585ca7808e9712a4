"""Reading and writing of the tables that fire models use."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand.operators.fireweather import canonical, with_times

# Names that tell what a weather file holds.
HOURLY = {"HOURLY_TEMPERATURE", "HOURLY_RELATIVE_HUMIDITY", "HOURLY_WIND_SPEED", "HOURLY_WIND_DIRECTION", "TEMP", "RH", "WS", "WD", "HOUR"}
INDICES = {"FFMC", "DMC", "DC", "ISI", "BUI", "FWI", "INITIAL_SPREAD_INDEX", "FIRE_WEATHER_INDEX"}
STATION = {"LATITUDE", "LONGITUDE", "ELEVATION_M", "STATION_NAME", "SLOPE", "ASPECT"}


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table under its usual column names. Without ``schema`` all columns are strings, and no pass infers types."""
    reader = spark.read.option("header", True)
    return canonical((reader.schema(schema) if schema else reader).csv(path))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station codes as strings, coordinates and terrain as numbers; null where they aren't numbers."""
    raw = read_csv(spark, path)
    numbers = [c for c in ("latitude", "longitude", "elevation_m", "slope", "aspect") if c in raw.columns]
    return raw.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def read_weather(spark: SparkSession, weather: str | None, station: str | None = None, form: str | None = None) -> DataFrame:
    """The weather table, else the station table, else an empty one: measures and indices as numbers,
    ``obs_date`` and ``obs_hour`` from whatever columns hold the time (``with_times``), station codes as strings."""
    path = weather or station
    if path is None:
        return spark.createDataFrame([], "station_code string, obs_date date, obs_hour int, temp double, rh double, ws double, wd double, precip double")
    raw = read_csv(spark, path)
    numbers = {c: F.col(c).try_cast("double") for c in ("temp", "rh", "ws", "wd", "precip", "ffmc", "dmc", "dc", "isi", "bui", "fwi") if c in raw.columns}
    codes = {"station_code": F.col("station_code").cast("string")} if "station_code" in raw.columns else {}
    return with_times(raw.withColumns(numbers | codes), form)


def weather_format(columns: list[str]) -> str:
    """What a file seems to hold: ``hourly``, ``hourly_with_indices``, ``indices``, ``stations`` or ``unknown``."""
    names = {c.strip().upper() for c in columns}
    hourly, indices = len(names & HOURLY) >= 3, len(names & INDICES) >= 3
    if hourly and indices:
        return "hourly_with_indices"
    return "hourly" if hourly else "indices" if indices else "stations" if len(names & STATION) >= 2 else "unknown"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_cells(cells: DataFrame, path: str, tile: int = 512) -> None:
    """A grid as a table of cells, a folder a tile of rows, so that a window of it prunes to few folders."""
    cells.withColumn("tile_row", F.floor(F.col("grid_row") / tile)).repartition("tile_row").write.mode("overwrite").partitionBy("tile_row").parquet(path)


def read_cells(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, tile: int = 512) -> DataFrame:
    """A grid written by ``write_cells``; only folders that overlap ``rows`` (first, last) are read."""
    cells = spark.read.parquet(path)
    if rows:
        cells = cells.where((F.col("tile_row") >= rows[0] // tile) & (F.col("tile_row") <= rows[1] // tile) & F.col("grid_row").between(*rows))
    return cells.drop("tile_row")


def read_ascii_grid(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """An ESRI ASCII grid as cells (``grid_row``, ``grid_col``, ``x``, ``y`` of the centre); nodata is null."""
    head = {}
    for line in spark.sparkContext.textFile(path).take(6):
        key, *rest = line.split()
        if len(rest) == 1 and key.lower() in ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value"):
            head[key.lower()] = float(rest[0])
    rows, size, skip = int(head["nrows"]), head["cellsize"], len(head)
    index = spark.sparkContext.textFile(path).zipWithIndex().filter(lambda p: p[1] >= skip and p[0].strip()).map(lambda p: (int(p[1] - skip), [float(v) for v in p[0].split()]))
    table = spark.createDataFrame(index, "grid_row int, _v array<double>").select("grid_row", F.posexplode("_v").alias("grid_col", value))
    missing = head.get("nodata_value")
    return table.select(
        "grid_row", "grid_col", (head["xllcorner"] + (F.col("grid_col") + 0.5) * size).alias("x"), (head["yllcorner"] + (rows - F.col("grid_row") - 0.5) * size).alias("y"),
        F.when(F.col(value) != missing, F.col(value)).alias(value) if missing is not None else F.col(value),
    )


def write_ascii_grid(cells: DataFrame, value: str, path: str, left: float, bottom: float, size: float, nodata: float = -9999.0) -> None:
    """An ESRI ASCII grid, a line a row of cells, in one file. For exports: the file is written by one task."""
    rows = cells.groupBy("grid_row").agg(F.sort_array(F.collect_list(F.struct("grid_col", F.coalesce(F.col(value).cast("double"), F.lit(nodata)).alias("v")))).alias("c"))
    shape = cells.agg(F.max("grid_row"), F.max("grid_col")).first()
    head = [f"ncols {shape[1] + 1}", f"nrows {shape[0] + 1}", f"xllcorner {left}", f"yllcorner {bottom}", f"cellsize {size}", f"NODATA_value {nodata}"]
    body = rows.select(F.col("grid_row").cast("long").alias("n"), F.concat_ws(" ", F.transform("c", lambda s: s["v"].cast("string"))).alias("line"))
    top = cells.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "n long, line string")
    top.unionByName(body).orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """``x``, ``y`` and ``properties`` (map) of the points of a GeoJSON file; of other geometries the mean of the first ring."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line = F.when(kind == "Polygon", F.get(F.from_json(raw, "array<array<array<double>>>"), F.lit(0))).when(kind.isin("LineString", "MultiPoint"), F.from_json(raw, "array<array<double>>"))
    mean = lambda i: F.aggregate(line, F.lit(0.0), lambda a, p: a + F.get(p, F.lit(i))) / F.size(line)  # noqa: E731, B023
    point = F.from_json(raw, "array<double>")
    x, y = (F.when(kind == "Point", F.get(point, F.lit(i))).otherwise(mean(i)) for i in (0, 1))
    return features.select(x.alias("x"), y.alias("y"), F.col("f.properties").alias("properties"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points (``x``, ``y`` and what else they have) of a Parquet, CSV, GeoJSON, KML or shape file, by its ending."""
    name = path.lower().rstrip("/")
    if name.endswith((".geojson", ".json")):
        points = read_geojson_points(spark, path)
        known = {c: F.element_at("properties", c) for c in ("cause", "season")} | {"iteration": F.element_at("properties", "iteration").try_cast("int")}
        return points.select("x", "y", *[v.alias(c) for c, v in known.items()])
    if name.endswith(".kml"):
        return read_kml_points(spark, path)
    if name.endswith(".shp"):
        from fernbrand.sources import shapes

        return shapes.points(shapes.read_shapes(spark, path))
    if name.endswith(".csv"):
        raw = read_csv(spark, path)
        return raw.withColumns({c: F.col(c).try_cast(k) for c, k in (("x", "double"), ("y", "double"), ("iteration", "int")) if c in raw.columns})
    return spark.read.parquet(path)


def read_kml_points(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``x``, ``y`` of the point placemarks of a KML file."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema("name string, Point struct<coordinates: string>").load(path)
    parts = F.split(F.trim("Point.coordinates"), ",")
    return marks.where("Point is not null").select("name", F.get(parts, F.lit(0)).try_cast("double").alias("x"), F.get(parts, F.lit(1)).try_cast("double").alias("y"))


def _feature(geometry: Column, properties: list[str]) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def write_points(points: DataFrame, path: str) -> None:
    """A GeoJSON feature a line; all columns but ``x`` and ``y`` are properties."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    points.select(_feature(geometry, [c for c in points.columns if c not in ("x", "y")]).alias("value")).write.mode("overwrite").text(path)


def write_rings(rings: DataFrame, path: str) -> None:
    """A GeoJSON polygon a line for each ``fire_id`` and ``t_min``, closed, in a folder a fire."""
    ordered = F.sort_array(F.collect_list(F.struct("vertex_id", F.array("x", "y").alias("p"))))
    whole = rings.groupBy("fire_id", "t_min").agg(ordered.alias("v")).withColumn("ring", F.transform("v", lambda s: s["p"]))
    closed = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("coordinates"))
    whole.select("fire_id", _feature(closed, ["fire_id", "t_min"]).alias("value")).write.mode("overwrite").partitionBy("fire_id").text(path)


def write_results(rings: DataFrame, summary: DataFrame, folder: str) -> None:
    """Perimeters of fires with an area under ``perimeters``, and the summary table."""
    burned = summary.where("area_ha > 0").select("fire_id")
    write_rings(rings.join(burned, "fire_id", "left_semi"), os.path.join(folder, "perimeters"))
    write_csv(summary, os.path.join(folder, "simulation_summary"))
