"""Grids and shapes in files, and whole runs from files."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernbrand import cli, config
from fernbrand.operators import cells
from fernbrand.sources import rasters, shapes, tables


def table(spark, values, size=30.0, left=0.0, top=0.0):
    rows = [(i, j, left + (j + 0.5) * size, top - (i + 0.5) * size, None if math.isnan(v) else float(v)) for i, line in enumerate(values) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "grid_row int, grid_col int, x double, y double, v double")


@pytest.mark.parametrize("compression", ["deflate", "lzw", "none"])
def test_geotiff_round_trip(spark, tmp_path, compression):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=(150, 40)), 2).astype(np.float32)
    values[3, 4] = np.nan
    df = table(spark, values, 30.0, 500.0, 9000.0)
    path = str(tmp_path / "g.tif")
    rasters.write_geotiff(df.where("grid_row <> 70"), "v", path, cells.bounds(df), 3005, compression=compression)
    back = {(r["grid_row"], r["grid_col"]): r for r in rasters.read_geotiff(spark, path, "v").collect()}
    assert len(back) == 6000 and back[3, 4]["v"] is None and back[70, 0]["v"] is None
    assert all(back[i, j]["v"] == values[i, j] for i in range(150) for j in range(40) if i != 70 and (i, j) != (3, 4))
    assert (back[0, 0]["x"], back[0, 0]["y"]) == (515.0, 8985.0) and rasters.crs_of(path) == "EPSG:3005"
    whole = {(r["grid_row"], r["grid_col"]): r["code"] for r in rasters.read_geotiff(spark, path, "code", integer=True).collect()}
    assert whole[3, 4] == rasters.MISSING_CODE and isinstance(whole[0, 0], int)


def test_lzw_of_long_and_empty_data():
    rng = np.random.default_rng(2)
    for data in (b"", b"a", b"ab" * 40_000, rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()):
        assert rasters.unpack_lzw(rasters.pack_lzw(data)) == data


def test_tiled_geotiff_with_predictor(spark, tmp_path):
    values = np.arange(35 * 40, dtype="<u2").reshape(35, 40) * 3
    tiles, data = [], bytearray(b"II*\0\0\0\0\0")
    for r in (0, 16, 32):
        for c in (0, 16, 32):
            tile = np.zeros((16, 16), "<u2")
            part = values[r : r + 16, c : c + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            raw = np.diff(tile, axis=1, prepend=np.zeros((16, 1), "<u2")).astype("<u2").tobytes()
            tiles.append((len(data), len(raw)))
            data += raw
    places = len(data)
    data += struct.pack("<9I", *[t[0] for t in tiles]) + struct.pack("<9I", *[t[1] for t in tiles])
    entries = [(256, 3, 1, 40), (257, 3, 1, 35), (258, 3, 1, 16), (259, 3, 1, 1), (317, 3, 1, 2), (322, 3, 1, 16), (323, 3, 1, 16), (324, 4, 9, places), (325, 4, 9, places + 36), (339, 3, 1, 1)]
    at = len(data)
    data += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0\0\0\0"
    data[4:8] = struct.pack("<I", at)
    (tmp_path / "t.tif").write_bytes(data)
    spark.dataSource.register(rasters.GeoTiffSource)
    df = spark.read.format("geotiff").option("cells", "300").load(str(tmp_path / "t.tif"))
    got = {(r["grid_row"], r["grid_col"]): r["value"] for r in df.collect()}
    assert df.rdd.getNumPartitions() == 9 and got == {(i, j): float(values[i, j]) for i in range(35) for j in range(40)}


def test_arrays(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", one=np.arange(3.0), two=np.arange(6).reshape(2, 3), none=np.zeros((0, 2)))
    got = {(r["name"], *r["at"]): r["value"] for r in rasters.read_arrays(spark, str(tmp_path / "a.npz")).collect()}
    assert got["one", 2] == 2 and got["two", 1, 0] == 3 and len(got) == 9
    df = table(spark, np.array([[1.0, np.nan], [3.0, 4.0]]))
    rasters.write_arrays(df, ["v"], str(tmp_path / "b.npz"), 2, 2)
    with np.load(tmp_path / "b.npz") as held:
        assert np.array_equal(held["v"], [[1.0, np.nan], [3.0, 4.0]], equal_nan=True)


def write_shapefile(base, records, names):
    """Rings or points as a shape file with one text field."""
    body, index = b"", b""
    for i, (number, parts) in enumerate(records):
        points = np.concatenate(parts).astype("<f8")
        if number == 1:
            data = struct.pack("<i", 1) + points.tobytes()
        else:
            begins = np.cumsum([0, *[len(p) for p in parts[:-1]]]).astype("<i4")
            data = struct.pack("<i4dii", number, *points.min(0), *points.max(0), len(parts), len(points)) + begins.tobytes() + points.tobytes()
        index += struct.pack(">ii", (100 + len(body)) // 2, len(data) // 2)
        body += struct.pack(">ii", i + 1, len(data) // 2) + data
    for end, data in ((".shp", body), (".shx", index)):
        base.with_suffix(end).write_bytes(struct.pack(">i20xi", 9994, (100 + len(data)) // 2) + struct.pack("<ii", 1000, records[0][0]) + b"\0" * 64 + data)
    head = struct.pack("<B3xIHH20x", 3, len(names), 65, 11) + b"CAUSE".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r"
    base.with_suffix(".dbf").write_bytes(head + b"".join(b" " + n.encode().ljust(10) for n in names))


def test_shape_files(spark, tmp_path):
    square, hole = np.array([[0.0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]), np.array([[1.0, 1], [2, 1], [2, 2], [1, 1]])
    write_shapefile(tmp_path / "r", [(5, [square, hole]), (5, [square + 10])], ["Human", ""])
    rows = shapes.read_shapes(spark, str(tmp_path / "r.shp"))
    assert [(r["shape_id"], r["part"], r["kind"], len(r["vertices"])) for r in rows.orderBy("shape_id", "part").collect()] == [(0, 0, "ring", 5), (0, 1, "ring", 4), (1, 0, "ring", 5)]
    at = sorted((r["x"], r["y"], r["cause"]) for r in shapes.points(rows).collect())
    assert at == [(2.0, 2.0, "Human"), (12.0, 12.0, None)] and shapes.rings(rows).count() == 8 and shapes.segments(rows).count() == 11
    write_shapefile(tmp_path / "p", [(1, [np.array([[1.5, 2.5]])]), (1, [np.array([[3.0, 4.0]])])], ["a", "b"])
    points = tables.read_points(spark, str(tmp_path / "p.shp")).orderBy("x").collect()
    assert [(p["x"], p["y"], p["cause"]) for p in points] == [(1.5, 2.5, "a"), (3.0, 4.0, "b")]


def test_geojson_shapes(spark, tmp_path):
    features = [("Polygon", [[[0, 0], [2, 0], [2, 2], [0, 0]]]), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]), ("LineString", [[0, 0], [3, 4]]), ("MultiPoint", [[1, 1], [2, 2]]), ("Point", [9, 8])]
    whole = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"cause": "x"}} for k, c in features]}
    (tmp_path / "s.geojson").write_text(json.dumps(whole))
    rows = shapes.read_shapes(spark, str(tmp_path / "s.geojson"))
    assert sorted((r["shape_id"], r["part"], r["kind"]) for r in rows.collect()) == [(0, 0, "ring"), (1, 0, "ring"), (1, 1, "ring"), (2, 0, "line"), (3, 0, "point"), (3, 1, "point"), (4, 0, "point")]
    shapes.write_shapes(rows, str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(lines) == 7 and {tuple(x["geometry"]["coordinates"]) for x in lines if x["geometry"]["type"] == "Point"} == {(1, 1), (2, 2), (9, 8)}


def ground(spark, tmp_path, n=30):
    rows = [(i, j, (j + 0.5) * 30.0, -(i + 0.5) * 30.0, 1000.0, 60, 1.0, 5) for i in range(n) for j in range(n)]
    df = spark.createDataFrame(rows, "grid_row int, grid_col int, x double, y double, elev double, fuel_id int, p double, eco_id int")
    df.drop("p", "eco_id").write.parquet(str(tmp_path / "cells.parquet"))
    df.drop("elev").write.parquet(str(tmp_path / "p.parquet"))
    lines = ["DATE,HOUR,TEMP,RH,WS,WD,PRECIP,STATION"] + [f"0{d}/07/2024,{h},{20 + h / 2},{40 - h},{10 + h},{h * 10},0,7" for d in range(1, 6) for h in range(24)]
    (tmp_path / "w.csv").write_text("\n".join(lines))


def summary(spark, tmp_path):
    return {int(r["fire_id"]): r for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "simulation_summary")).collect()}


def test_run_from_files(spark, tmp_path, capsys):
    ground(spark, tmp_path)
    (tmp_path / "i.csv").write_text("fire_id,x,y,cause\n1,450,-450,Human\n2,99999,0,\n")
    spark.createDataFrame([(480.0, -900.0, 480.0, 0.0)], "ax double, ay double, bx double, by double").write.parquet(str(tmp_path / "b.parquet"))
    text = "inputs: {cells: ./cells.parquet, weather: ./w.csv, stations: ./none.csv, ignitions: ./i.csv}\nfuel: {lookup: {60: M-1}}\nsimulation: {max_duration: 60, n_vertices: 24, store_every: 10}\n"
    (tmp_path / "c.yaml").write_text(text)
    assert cli.main(["validate", str(tmp_path / "c.yaml")]) == 0 and "inputs.stations" in capsys.readouterr().err
    assert cli.main(["run", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "out"), "-q"]) == 0 and capsys.readouterr().out == ""
    free = summary(spark, tmp_path)
    assert set(free) == {1, 2} and float(free[2]["area_ha"]) == 0 and float(free[1]["area_ha"]) > 0 and (free[1]["cause"], free[2]["cause"]) == ("Human", "Lightning")
    (tmp_path / "d.yaml").write_text(text + f"breaks:\n- {{path: {tmp_path}/b.parquet, treatment: zero_ros, buffer_m: 20}}\n- {{path: ./gone.parquet, enabled: false}}\n")
    assert cli.main(["run", str(tmp_path / "d.yaml"), "-o", str(tmp_path / "out"), "-q"]) == 0
    assert 0 < float(summary(spark, tmp_path)[1]["area_ha"]) < float(free[1]["area_ha"])
    (tmp_path / "e.yaml").write_text(text.replace("60: M-1", "60: NF"))
    assert cli.main(["run", str(tmp_path / "e.yaml"), "-o", str(tmp_path / "out"), "-q"]) == 0
    assert float(summary(spark, tmp_path)[1]["dur_min"]) == 0


def test_terrain_command(spark, tmp_path):
    df = table(spark, np.arange(20.0)[:, None] * np.ones(12))
    rasters.write_geotiff(df, "v", str(tmp_path / "d.tif"), cells.bounds(df), 3005)
    assert cli.main(["terrain", str(tmp_path / "d.tif"), "-o", str(tmp_path / "t"), "--size", "30"]) == 0
    slopes = tables.read_cells(spark, str(tmp_path / "t")).agg(F.min("slope_deg"), F.max("slope_deg"), F.count("*")).first()
    assert slopes[0] == pytest.approx(math.degrees(math.atan(1 / 30))) and slopes[1] == pytest.approx(slopes[0]) and slopes[2] == 240


def test_run_with_drawn_ignitions(spark, tmp_path):
    ground(spark, tmp_path)
    text = "inputs: {cells: ./cells.parquet, probabilities: ./p.parquet}\nsimulation: {max_duration: 4, n_vertices: 12, store_every: 2}\nignition: {source: grid, n_iterations: 3, cause: Human, fires_per_iteration: {2: 1}, rates: {5: [1, 2]}, rules: [{fuels: [C-1], cause: Human}]}\n"
    (tmp_path / "c.yaml").write_text(text)
    assert cli.main(["run", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "out"), "-n", "5", "-s", "3", "-q"]) == 0
    first = summary(spark, tmp_path)
    assert len(first) == 10 and {r["iteration"] for r in first.values()} == set("01234") and {r["season"] for r in first.values()} == {"Summer"}
    assert cli.main(["run", str(tmp_path / "c.yaml"), "-o", str(tmp_path / "out"), "-n", "5", "-s", "4", "-q"]) == 0
    other = summary(spark, tmp_path)
    assert {(r["x"], r["y"]) for r in other.values()} != {(r["x"], r["y"]) for r in first.values()}


def test_stations_and_points(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Station_Code,Station_Name,LATITUDE,Longitude,ELEVATION_M,slope\n007,North,51.5,-115.25,n/a,\n8,,x,,900,3\n")
    rows = tables.read_stations(spark, str(tmp_path / "s.csv")).orderBy("station_code").collect()
    assert [(r["station_code"], r["latitude"], r["elevation_m"], r["slope"]) for r in rows] == [("007", 51.5, None, None), ("8", None, 900.0, 3.0)]
    points = spark.createDataFrame([(1, 2.5, 3.5, "Human")], "fire_id int, x double, y double, cause string")
    tables.write_points(points, str(tmp_path / "p"))
    feature = json.loads(spark.read.text(str(tmp_path / "p")).first()["value"])
    assert feature["geometry"] == {"type": "Point", "coordinates": [2.5, 3.5]} and feature["properties"] == {"fire_id": 1, "cause": "Human"}
    tables.write_csv(points, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c")).first()["cause"] == "Human"


def test_configuration():
    with pytest.raises(config.ConfigError):
        config.parse({"ignition": {"source": "elsewhere"}})
    with pytest.raises(config.ConfigError):
        config.parse({"breaks": [{"treatment": "zero_ros"}]})
    with pytest.raises(config.ConfigError):
        config.parse({"weather": {"high": 20, "extreme": 10}})
    made, unknown = config.parse({"breaks": {"path": "./x", "odd": 1}, "fuel": {"lookup": {1: "C-2"}}}, "/a")
    assert made.breaks[0].path == "/a/x" and unknown == ["breaks[0].odd"] and made.fuel.lookup == {1: "C-2"}


def test_maps(spark, tmp_path):
    from fernbrand.functions import projections
    from fernbrand.operators import climate

    at = lambda epsg: spark.range(1).select(*[c.alias(n) for n, c in zip("xy", projections.project(F.lit(-123.0), F.lit(49.0), epsg))]).first()
    assert tuple(at(3005)) == pytest.approx((1219731.77, 447290.50), abs=0.01) and tuple(at(3857)) == pytest.approx((-13692297.37, 6274861.39), abs=0.01)
    assert at(32610)["x"] == pytest.approx(500000) and at(3978)["x"] < 0 and projections.utm_zone(-123.0) == 10 and projections.utm_zone(179.9) == 60
    with pytest.raises(ValueError):
        projections.project(F.lit(0.0), F.lit(0.0), 1)
    assert climate.in_region("USA", (-120.0, 45.0, -119.0, 46.0)) and not climate.in_region("Canada", (0.0, 0.0, 1.0, 1.0))
    spots = {"features": [{"geometry": {"coordinates": [-115.5, 51.0]}, "properties": {"agency": "ab"}}, {"geometry": {"coordinates": [10.0, 51.0]}, "properties": {}}, {"geometry": None, "properties": None}]}
    (tmp_path / "h.json").write_text(json.dumps(spots))
    assert [(r["lon"], r["properties"]["agency"]) for r in climate.read_hotspots(spark, str(tmp_path / "h.json"), (-120.0, 50.0, -110.0, 52.0)).collect()] == [(-115.5, "ab")]
    (tmp_path / "f.json").write_text(json.dumps({"latitude": 51.0, "longitude": -115.0, "hourly": {"time": ["2024-07-01T00:00", "2024-07-01T01:00"], "temperature_2m": [10.5, 11.0], "precipitation": [0.0, 0.2], "wind_speed_10m": [5.0, 6.0]}}))
    hours = climate.read_forecast(spark, str(tmp_path / "f.json")).orderBy("ts").collect()
    assert [(r["temp"], r["rh"], r["ts"].hour) for r in hours] == [(10.5, None, 0), (11.0, None, 1)]
    tiles = spark.createDataFrame([(0, 0, 5.0, 5.0, 1, None), (0, 0, 5.0, 5.0, 2, 7.0), (0, 1, 15.0, 5.0, 1, 3.0), (0, 1, 15.0, 5.0, 2, 4.0), (9, 9, 500.0, 5.0, 1, 1.0), (1, 1, 15.0, 9.0, 1, float("nan"))], "grid_row int, grid_col int, x double, y double, tile int, v double")
    assert {(r["grid_row"], r["grid_col"]): r["v"] for r in climate.mosaic(tiles, "v", box=(0, 0, 100, 100)).collect()} == {(0, 0): 7.0, (0, 1): 3.0, (1, 1): None}


def test_points_in_regions(spark):
    from fernbrand.operators import regions

    rng = np.random.default_rng(4)
    outlines = {}
    for r in range(12):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 9))
        far = rng.uniform(2, 12, 9)
        outlines[r] = np.stack([rng.uniform(0, 60) + far * np.cos(turn), rng.uniform(0, 60) + far * np.sin(turn)], 1)
    vertices = spark.createDataFrame([(r, i, *map(float, p)) for r, v in outlines.items() for i, p in enumerate(v)] + [(99, 0, 1.0, 1.0), (99, 1, 2.0, 2.0)], "region_id int, vertex_id int, x double, y double")
    places = [(i, *map(float, rng.uniform(-5, 70, 2))) for i in range(600)]
    points = spark.createDataFrame(places + [places[3], (700, None, 1.0), (701, float("nan"), 1.0), (702, float("inf"), 1.0)], "point_id int, x double, y double").withColumn("xs", F.lit("clash"))

    def held(x, y, v):
        after = np.roll(v, -1, 0)
        spans = (v[:, 1] > y) != (after[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (spans & (x < v[:, 0] + (y - v[:, 1]) / (after[:, 1] - v[:, 1]) * (after[:, 0] - v[:, 0]))).sum() % 2 == 1

    want = {(i, r) for i, x, y in places for r, v in outlines.items() if held(x, y, v)}
    shapes_ = regions.outlines(vertices)
    for cell in (3.0, 20.0):
        rows = [tuple(r) for r in regions.points_in_regions(points, shapes_, cell).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50
    many = regions.broadcast_if_small
    try:
        regions.broadcast_if_small = lambda df, n: df
        assert {tuple(r) for r in regions.points_in_regions(points, shapes_, 5.0).collect()} == want
    finally:
        regions.broadcast_if_small = many
    owner = {r["point_id"]: r["region_id"] for r in regions.owners(regions.points_in_regions(points, shapes_, 5.0)).collect()}
    assert owner == {p: min(r for q, r in want if q == p) for p, _ in want}
    square = spark.createDataFrame([(r, i, x, y) for r, left in ((1, 0.0), (2, 10.0)) for i, (x, y) in enumerate([(left, 0.0), (left + 10, 0.0), (left + 10, 10.0), (left, 10.0)])], "region_id int, vertex_id int, x double, y double")
    shared = spark.createDataFrame([(1, 10.0, 5.0), (2, 5.0, 5.0)], "point_id int, x double, y double")
    assert {tuple(r) for r in regions.points_in_regions(shared, regions.outlines(square), 10.0).collect()} == {(1, 2), (2, 1)}
    assert regions.points_in_regions(points.limit(0), shapes_, 5.0).count() == 0 and regions.points_in_regions(points, shapes_.limit(0), 5.0).count() == 0


def test_formulas_in_sql(spark):
    from fernbrand.functions import fwi, sql

    assert "fwi_isi" in sql.register(spark)
    got = spark.sql("select fwi_isi(85, 10) a, fwi_bui(0, 0) b, fwi_dmc(20D, 40D, 3D, 30D, 7) c, fwi_dc(20D, 3D, 300D, 7) d, fwi_ffmc(20D, 40D, 10D, 1D, 85D) e, ros_head('NF', 10D, 80D) f, ros_head('c-2', 10D, 80D) g").first()
    assert tuple(got)[:5] == pytest.approx((fwi.isi(85, 10, fwi.PLAIN), 0.0, fwi.dmc_step(20, 40, 3, 30, 7, m=fwi.PLAIN), fwi.dc_step(20, 3, 300, 7, fwi.PLAIN), fwi.ffmc_step(20, 40, 10, 1, 85, fwi.PLAIN)))
    assert got["f"] is None and got["g"] > 0
