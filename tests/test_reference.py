"""Formulas, grids, fronts and tables of the fire operators."""

import json
import math
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fernbrand import cli, config
from fernbrand.functions import fronts, fwi, ros
from fernbrand.operators import cells, fires, fireweather, ignitions
from fernbrand.sources import tables
from fernbrand.streaming import moisture


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def head(spark, fuel, isi, bui=80.0, **options):
    return value(spark, ros.head_ros(fuel, F.lit(isi), F.lit(bui), **options))


def test_spread_index(spark):
    at = lambda f, w: value(spark, fwi.isi_or_zero(F.lit(f), F.lit(w)))
    assert 0 < at(85.0, 0.0) < at(85.0, 20.0) < at(95.0, 20.0)
    assert at(None, 20.0) == 0 and at(85.0, "invalid") == 0 and at(float("nan"), 1.0) == 0


def test_spread_rates(spark):
    assert 0 < head(spark, "C-1", 10.0) < 100 and head(spark, "C-2", 0.0) == 0 and head(spark, "C-2", None) == 0
    assert head(spark, "C-2", 5.0) < head(spark, "C-2", 20.0) and head(spark, "O-1a", 10.0, curing=50) < head(spark, "O-1a", 10.0, curing=90)
    assert all(head(spark, f, 10.0) == 0 for f in ("NF", "X-99", "WA", "DEAD")) and head(spark, " c-2 ", 10.0) == head(spark, "C-2", 10.0)
    assert value(spark, ros.fuel_name(F.lit(2))) == "C-2" and value(spark, ros.fuel_name(F.lit(101))) == "NF"
    back = ros.back_ros(F.lit(10.0))
    assert value(spark, back) == 2 and value(spark, ros.flank_ros(F.lit(10.0), back)) == 3 and value(spark, ros.azimuth(F.lit(180.0))) == 0


def test_codes_of_columns_and_numbers_agree(spark):
    rows = [(25.0, 30.0, 15.0, 0.0, 85.0, 6.0, 15.0, 7), (5.0, 95.0, 3.0, 12.0, 60.0, 40.0, 300.0, 4), (-5.0, 100.0, 0.0, 2.0, 20.0, 80.0, 500.0, 1), (20.0, 0.0, 40.0, 0.6, 101.0, 0.0, 0.0, 12)]
    df = spark.createDataFrame(rows, "t double, h double, w double, p double, f double, d double, c double, m int")
    t, h, w, p, f, d, c, m = (F.col(x) for x in "thwpfdcm")
    out = df.select(fwi.ffmc_step(t, h, w, p, f).alias("a"), fwi.dmc_step(t, h, p, d, m).alias("b"), fwi.dc_step(t, p, c, m).alias("c"), fwi.fwi(fwi.isi(f, w), fwi.bui(d, c)).alias("e")).collect()
    for (t, h, w, p, f, d, c, m), r in zip(rows, out):
        plain = (fwi.ffmc_step(t, h, w, p, f, fwi.PLAIN), fwi.dmc_step(t, h, p, d, m, m=fwi.PLAIN), fwi.dc_step(t, p, c, m, fwi.PLAIN), fwi.fwi(fwi.isi(f, w, fwi.PLAIN), fwi.bui(d, c, fwi.PLAIN), fwi.PLAIN))
        assert tuple(r) == pytest.approx(plain, rel=1e-9)


def grid(spark, heights):
    rows = [(i, j, None if math.isnan(v) else float(v)) for i, line in enumerate(heights) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "grid_row int, grid_col int, elev double")


def test_terrain(spark):
    flat = cells.slope_aspect(grid(spark, np.full((6, 6), 100.0))).collect()
    assert all(r["slope_deg"] == 0 and r["aspect_deg"] is None for r in flat)
    north = cells.slope_aspect(grid(spark, -np.arange(6.0)[:, None] * np.ones(6))).collect()
    assert all(min(r["aspect_deg"], 360 - r["aspect_deg"]) < 1e-6 for r in north)
    steep = cells.slope_aspect(grid(spark, np.arange(6.0) * 30 + np.zeros((6, 1)))).collect()
    assert all(abs(r["slope_deg"] - 45) < 1e-9 and abs(r["aspect_deg"] - 90) < 1e-9 for r in steep)
    holed = np.random.default_rng(0).normal(size=(6, 6))
    holed[2, 2] = np.nan
    out = {(r["grid_row"], r["grid_col"]): r for r in cells.slope_aspect(grid(spark, holed)).collect()}
    assert out[2, 2]["slope_deg"] is None and out[2, 3]["slope_deg"] is not None
    assert value(spark, ros.slope_factor(F.lit(30.0), F.lit(None).cast("double"), F.lit(0.0))) == 1 and value(spark, ros.elevation_factor(F.lit(5000.0), F.lit(0.0), F.lit(100.0))) <= 1.3


def test_fronts():
    ring = fronts.circle(3.0, 4.0, 10.0, 100)
    assert fronts.active(ring).all() and fronts.turning_numbers(np.array([[3.0, 4.0], [30.0, 4.0]]), ring).tolist() == [1, 0]
    square = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
    assert fronts.area(square) == 1 and fronts.perimeter(square) == 4
    constant = lambda step, r: (np.full(len(r), 5.0), np.full(len(r), 1.0), np.full(len(r), 2.0), np.zeros(len(r)))
    rings, last, spreads = fronts.grow(ring, constant, 0, 20, every=5)
    assert [t for t, _ in rings] == [5, 10, 15, 20] and all(fronts.area(b) > fronts.area(a) for (_, a), (_, b) in zip(rings, rings[1:]))
    assert spreads and (last == rings[-1][1]).all() and last[:, 1].max() > ring[:, 1].max() + 90
    half, middle, _ = fronts.grow(ring, constant, 0, 7, every=5)
    rest, end, _ = fronts.grow(middle, constant, 7, 20, every=5)
    assert [t for t, _ in half + rest] == [5, 10, 15, 20] and np.array_equal(end, last)
    cold = lambda step, r: (np.zeros(len(r)),) * 4
    assert fronts.grow(ring, cold, 0, 20)[0] == [] and not fronts.grow(ring, cold, 0, 20)[2]
    rng = np.random.default_rng(3)
    points, knot = rng.normal(size=(300, 2)) * 5, fronts.circle(0.0, 0.0, 4.0, 40)[rng.permutation(40)]
    angle = np.arctan2(knot[None, :, 1] - points[:, None, 1], knot[None, :, 0] - points[:, None, 0])
    turn = (np.diff(angle, axis=1, append=angle[:, :1]) + np.pi) % (2 * np.pi) - np.pi
    assert np.array_equal(fronts.turning_numbers(points, knot), np.rint(turn.sum(1) / (2 * np.pi)).astype(int))
    assert fronts.bilinear(np.full((4, 5), 5.0), np.arange(5.0), np.arange(4.0)[::-1], np.array([[2.2, 1.7], [99.0, -99.0]])) == pytest.approx([5, 5])


def ring_rows(rings):
    return [(f, i, *map(float, p)) for f, ring in rings.items() for i, p in enumerate(ring)]


def test_clip(spark):
    rings = {1: np.array([[0.0, 0], [10, 0], [10, 10], [0, 10]]), 2: np.array([[50.0, 50], [60, 50], [60, 60]]), 3: fronts.circle(5.0, 5.0, 5.0, 200)}
    df = spark.createDataFrame(ring_rows(rings), "fire_id long, vertex_id int, x double, y double")
    area = {r["fire_id"]: r["area_ha"] * 1e4 for r in fires.ring_measures(fires.clip_rings(df, (5, -9, 20, 20)), ["fire_id"]).collect()}
    assert area == {1: pytest.approx(50), 3: pytest.approx(fronts.area(rings[3]) / 2)}
    for f, ring in rings.items():
        whole = fronts.area(fronts.clip(ring, (5, -9, 20, 20)))
        assert whole == pytest.approx(area.get(f, 0))
    assert fires.clip_rings(df, (200, 200, 300, 300)).count() == 0


def square_cells(spark, n=30, size=30.0, fuel=2):
    rows = [(i, j, (j + 0.5) * size, -(i + 0.5) * size, 1000.0, fuel, 0.0, None, False) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "grid_row int, grid_col int, x double, y double, elev double, fuel_id int, slope_deg double, aspect_deg double, zero_ros boolean")


def test_growth_in_slabs_and_off_the_grid(spark):
    ground = square_cells(spark)
    box = cells.bounds(ground)
    assert (box["left"], box["top"], box["size"], box["rows"], box["cols"]) == (0, 0, 30, 30, 30)
    weather = spark.range(40).select(F.col("id").cast("int").alias("step"), (8.0 + F.col("id") % 5).alias("isi"), F.lit(80.0).alias("bui"), (F.col("id") * 9.0).alias("wd"), F.lit(25.0).alias("temp"), F.lit(30.0).alias("rh"))
    at = spark.createDataFrame([(1, 450.0, -450.0), (2, 9000.0, 0.0), (3, 100.0, -200.0)], "fire_id long, x double, y double")
    grow = lambda **k: fires.grow_fires(at, ground, weather, 24, box, n=36, every=6, **k)
    whole = {(r["fire_id"], r["t_min"], r["vertex_id"]): (r["x"], r["y"]) for r in grow(slab=100).collect()}
    parts = {(r["fire_id"], r["t_min"], r["vertex_id"]): (r["x"], r["y"]) for r in grow(slab=7).collect()}
    assert {k[:2] for k in whole} == {(f, t) for f in (1, 3) for t in (0.0, 6.0, 12.0, 18.0, 24.0)} and set(whole) == set(parts)
    assert all(whole[k] == pytest.approx(parts[k], abs=1e-6) for k in whole)
    table = {r["fire_id"]: r for r in fires.summaries(at, grow()).collect()}
    assert table[2]["area_ha"] == table[2]["dur_min"] == 0 and table[1]["area_ha"] > 0.1 and table[3]["dur_min"] == 24
    named = fires.grow_fires(at, ground, weather, 6, box, n=36, every=6, lookup={2: "NF"})
    assert {r["t_min"] for r in named.collect()} == {0.0}


def test_fires_of_one_point_grow_once(spark):
    ground = square_cells(spark)
    weather = spark.range(12).select(F.col("id").cast("int").alias("step"), F.lit(9.0).alias("isi"), F.lit(80.0).alias("bui"), (F.col("id") * 9.0).alias("wd"), F.lit(25.0).alias("temp"), F.lit(30.0).alias("rh"))
    at = spark.createDataFrame([(1, 450.0, -450.0), (2, 450.0, -450.0), (3, 100.0, -200.0), (3, 100.0, -200.0), (4, 9000.0, 0.0)], "fire_id long, x double, y double")
    options = {"n": 36, "every": 6}
    begun, rings = fires.grow_places(at, ground, weather, 12, cells.bounds(ground), **options)
    assert sorted(r["fire_id"] for r in begun.collect()) == [1, 2, 3] and rings.count() == 2 * 3
    got = {(r["fire_id"], r["t_min"]): (r["area_ha"], r["perimeter_m"]) for r in fires.of_fires(begun, fires.measured(rings)).collect()}
    each = fires.ring_measures(fires.grow_fires(at, ground, weather, 12, cells.bounds(ground), **options), ["fire_id", "t_min"])
    want = {(r["fire_id"], r["t_min"]): pytest.approx((r["area_ha"], r["perimeter_m"])) for r in each.collect()}
    assert got == want and set(got) == {(f, t) for f in (1, 2, 3) for t in (0.0, 6.0, 12.0)} and all(got[1, t] == got[2, t] for t in (0.0, 6.0, 12.0))


def test_last_rings_do_not_broadcast_vertices(spark, monkeypatch, tmp_path):
    spark.range(5000).withColumn("fire_id", F.col("id")).write.parquet(f"{tmp_path}/fires")
    times = F.explode(F.sequence(F.lit(0), F.when(F.col("fire_id") % 2 == 0, 9).otherwise(0))).alias("t_min")
    # Vertices by explode: to the planner they are as small as the fires.
    rings = spark.read.parquet(f"{tmp_path}/fires").select("fire_id", times).select("fire_id", F.col("t_min").cast("double").alias("t_min"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("vertex_id"))
    want = {(i, 9.0 if i % 2 == 0 else 0.0): 60 for i in range(5000)}
    spark.conf.set("spark.sql.maxBroadcastTableSize", "48MB")
    try:
        for small in (fires.broadcast_if_small, lambda df: df):
            monkeypatch.setattr(fires, "broadcast_if_small", small)
            got = fires.final_rings(rings).groupBy("fire_id", "t_min").agg(F.count("*").alias("n"))
            assert {(r["fire_id"], r["t_min"]): r["n"] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_turning_numbers_meet_only_edges_of_their_height():
    ring = fronts.circle(0.0, 0.0, 10.0, 3000)
    tracemalloc.start()
    assert fronts.active(ring).all() and not fronts.active(ring[::-1]).any()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000


def test_growth_in_degrees(spark):
    wide, high = cells.metres_per_degree(50.0)
    metric, degrees = square_cells(spark), square_cells(spark, size=30.0 / ((wide + high) / 2))
    weather = spark.createDataFrame([(0, 10.0, 80.0, 90.0, 25.0, 30.0)], "step int, isi double, bui double, wd double, temp double, rh double")
    at = lambda k: spark.createDataFrame([(1, 450.0 / k, -450.0 / k)], "fire_id long, x double, y double")
    k = (wide + high) / 2
    a = fires.final_rings(fires.grow_fires(at(1), metric, weather, 10, cells.bounds(metric), n=36)).orderBy("vertex_id").collect()
    b = fires.final_rings(fires.grow_fires(at(k), degrees, weather, 10, cells.bounds(degrees), n=36, latitude=50.0)).orderBy("vertex_id").collect()
    assert all(p["x"] == pytest.approx(q["x"] * k, abs=1e-3) and p["y"] == pytest.approx(q["y"] * k, abs=1e-3) for p, q in zip(a, b))
    area = fires.ring_measures(spark.createDataFrame(b), ["fire_id"], 50.0).first()["area_ha"]
    assert area == pytest.approx(fires.ring_measures(spark.createDataFrame(a), ["fire_id"]).first()["area_ha"] * wide * high / k**2, rel=1e-3)
    assert cells.is_geographic("EPSG:4326", 30) and cells.is_geographic(None, 0.01) and not cells.is_geographic("EPSG:3005", 0.5)


def test_points_and_shapes_on_cells(spark):
    ground = square_cells(spark, 6, 10.0).withColumn("v", F.col("grid_row") * 10.0 + F.col("grid_col")).withColumn("w", F.lit(5.0))
    points = spark.createDataFrame([(1, 20.0, -20.0), (1, 20.0, -20.0), (2, 999.0, 999.0), (3, None, 1.0), (4, 5.0, -5.0)], "k int, x double, y double")
    got = sorted((r["k"], r["v"], r["w"]) for r in cells.bilinear_sample(points, ground, ["v", "w"], 0.0, 0.0, 10.0, 6, 6).where("k <> 3").collect())
    assert [g[0] for g in got] == [1, 1, 2, 4] and [g[1] for g in got] == pytest.approx([16.5, 16.5, 5.0, 0.0], abs=1e-4) and all(g[2] == pytest.approx(5) for g in got)
    assert cells.bilinear_sample(points.where("k = 3"), ground, "v", 0.0, 0.0, 10.0, 6, 6).first()["v"] is None
    holed = ground.withColumn("v", F.when(F.col("grid_row") != 1, F.col("v")))
    assert cells.bilinear_sample(points.where("k = 1"), holed, "v", 0.0, 0.0, 10.0, 6, 6).first()["v"] is None
    triangle = {7: np.array([[12.0, -12.0], [48.0, -12.0], [12.0, -48.0]])}
    rings = spark.createDataFrame(ring_rows(triangle), "fire_id long, vertex_id int, x double, y double")
    box = cells.bounds(ground)
    inside = {(r["grid_row"], r["grid_col"]) for r in fires.cells_inside(rings, box).collect()}
    assert inside == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (3, 1)}
    touched = {(r["grid_row"], r["grid_col"]) for r in fires.cells_touched(rings, box).collect()}
    assert inside < touched and (4, 1) in touched and (4, 3) not in touched and (2, 3) in touched
    line = spark.createDataFrame([(5.0, -5.0, 55.0, -5.0)], "ax double, ay double, bx double, by double")
    assert {(r["grid_row"], r["grid_col"]) for r in cells.cells_near(line, 11.0, box).collect() if r["grid_row"] >= 0 and 0 <= r["grid_col"] < 6} == {(i, j) for i in (0, 1) for j in range(6)}
    hit = cells.masked(ground, cells.cells_crossed(line, box)).where("is_masked")
    assert {(r["grid_row"], r["grid_col"]) for r in hit.collect()} == {(0, j) for j in range(6)}
    marked = fires.rasterise(ground.select("grid_row", "grid_col"), fires.cells_inside(rings, box), spark.createDataFrame([(7, 3.0)], "fire_id long, code double"), "code")
    assert marked.agg(F.sum("code")).first()[0] == 18.0 and marked.count() == 36


def test_exact_quantiles(spark, monkeypatch):
    from fernbrand.operators import quantiles

    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(size=5_000), np.full(3_000, 2.5), rng.normal(size=2_000)])
    df = spark.createDataFrame([(float(v), 1.0) for v in values] + [(None, None), (float("nan"), None)], "a double, b double").withColumn("c", F.lit(None).cast("double"))
    wanted = {"a": [0.0, 0.01, 0.5, 0.75, 0.99, 1.0], "b": [0.5], "c": [0.5]}
    for few in (10**6, 10):
        monkeypatch.setattr(quantiles, "FEW", few)
        got = quantiles.exact_quantiles(df, wanted)
        assert got["a"] == pytest.approx(np.quantile(values, wanted["a"]).tolist(), abs=1e-9) and got["b"] == [1.0] and got["c"] == [None]


def test_steps_as_relations_equal_the_integrator(spark):
    ring = fronts.circle(0.0, 0.0, 10.0, 60)
    rows = [(7, i, *map(float, p)) for i, p in enumerate(ring)]
    df = spark.createDataFrame(rows, "fire_id long, vertex_id int, x double, y double")
    moving = fires.derivatives(df, ["fire_id"]).withColumns({"head_ros": F.lit(6.0), "back_ros": F.lit(1.0), "flank_ros": F.lit(2.0), "azimuth": F.lit(30.0)})
    got = np.array([(r["vx"], r["vy"]) for r in fires.front_velocity(moving, ["fire_id"]).orderBy("vertex_id").collect()])
    want = fronts.velocities(ring, np.full(60, 6.0), np.full(60, 1.0), np.full(60, 2.0), np.full(60, math.radians(30)))
    assert np.allclose(got, want)
    r = fires.ring_measures(df, ["fire_id"]).first()
    assert r["area_ha"] * 1e4 == pytest.approx(fronts.area(ring)) and r["perimeter_m"] == pytest.approx(fronts.perimeter(ring))


def test_categories_and_fallbacks(spark):
    df = spark.createDataFrame([(1.0,), (8.6,), (12.6,), (float("nan"),), (None,)], "isi double")
    classed = df.withColumn("category", fireweather.category(F.col("isi")))
    assert [r["category"] for r in classed.collect()] == ["moderate", "high", "extreme", "moderate", "moderate"]
    assert fireweather.keep_categories(classed, ["high"]).count() == 1 and fireweather.keep_categories(classed, ["none"]).count() == 5
    assert fireweather.keep_categories(classed.limit(0), ["high"]).count() == 0
    days = fireweather.spread_event_days(spark.range(20_000), F.col("id")).agg(F.avg("event_days"), F.min("event_days")).first()
    assert abs(days[0] - (3.76 + math.exp(-3.76))) < 0.05 and days[1] == 1


def test_ignition_draws(spark):
    df = spark.createDataFrame([(i, i, float(i), float(i), 0.0 if i < 5 else float(i)) for i in range(40)], "grid_row int, grid_col int, x double, y double, p double")
    draws = ignitions.fires_per_iteration(400, {1: 0.5, 3: 0.5}, spark)
    out = ignitions.sample_ignitions(df, draws).toPandas()
    assert (out.groupby("iteration").size().isin([1, 3])).all() and out["grid_row"].min() >= 5
    assert not out.duplicated(["iteration", "grid_row"]).any() and out["grid_row"].mean() > 23
    shares = out[out["fire_no"] == 1]["grid_row"].value_counts().sort_index() / 400
    assert abs(shares.loc[30:].sum() - sum(range(30, 40)) / sum(range(5, 40))) < 0.08
    few = ignitions.sample_ignitions(df.where("grid_row < 8"), spark.createDataFrame([(0, 9), (1, 2), (2, 0)], "iteration int, n_fires int")).collect()
    assert sorted(r["iteration"] for r in few) == [0, 0, 0, 1, 1] and {r["grid_row"] for r in few if r["iteration"] == 0} == {5, 6, 7}
    assert ignitions.sample_ignitions(df.where("p = 0"), draws).count() == 0
    wide = spark.range(300).selectExpr("cast(id as int) grid_row", "0 grid_col", "0d x", "0d y", "1d p")
    many = ignitions.sample_ignitions(wide, draws).toPandas()
    assert (many.groupby("iteration").size().isin([1, 3])).all() and len(many["iteration"].unique()) == 400
    norm = ignitions.normalised(df, []).agg(F.sum("p")).first()[0]
    assert norm == pytest.approx(1)


def test_rules_and_names(spark):
    lookup = {1: "C-1", 31: "O-1a", 32: "O-1A", 40: "M-1", 41: "M-1"}
    assert ignitions.fuel_codes([" o-1a ", "M-1"], lookup) == [31, 32, 40, 41] and ignitions.fuel_codes(["o-1a", "M-1"], lookup, strict=True) == [32, 41]
    df = spark.createDataFrame([(2, "Human", "Summer", 1.0), (3, "Human", None, 1.0), (4, "Lightning", "Fall", 1.0), (None, "Human", "Fall", 1.0)], "fuel_id int, cause string, season string, p double")
    rules = spark.createDataFrame([(2, "HUMAN", "summer"), (2, "human", "summer"), (3, "Human", None), (4, "Lightning", "Spring")], "fuel_id int, cause string, season string")
    assert sorted((r["fuel_id"] or 0, r["p"]) for r in ignitions.ruled(df, rules).collect()) == [(0, 1.0), (2, 0.0), (3, 0.0), (4, 1.0)]
    probable = spark.range(100).selectExpr("cast(id as int) grid_row", "0 grid_col", "cast(id as double) x", "0d y", "2 fuel_id", "1d p")
    points = ignitions.monte_carlo(probable, 50, {1: 0.5, 2: 0.5}, "Human", "Summer").collect()
    assert len({r["fire_id"] for r in points}) == len(points) >= 50 and {r["iteration"] for r in points} == set(range(50))
    assert ignitions.monte_carlo(probable, 5, {1: 1.0}, "Human", "Summer", rules=rules).count() == 0


def test_times_of_readings(spark):
    raw = spark.createDataFrame([("2024-05-01 13:00", "1"), ("1/6/2024 5:00", "2"), ("03.06.2024", "x"), ("junk", None), (None, "4")], "HOURLY string, Air_Temp string")
    rows = fireweather.with_times(fireweather.canonical(raw)).collect()
    assert [str(r["obs_date"]) for r in rows] == ["2024-05-01", "2024-06-01", "2024-06-03", "None", "None"] and [r["obs_hour"] for r in rows] == [13, 5, 0, None, None]
    own = fireweather.with_times(spark.createDataFrame([("20240501", "7"), ("20240502", "z")], "date string, hr string")).collect()
    assert [r["obs_hour"] for r in own] == [7, None] and str(own[0]["obs_date"]) == "2024-05-01"
    odd = fireweather.with_times(spark.createDataFrame([("05|01|2024",)], "date string"), "MM|dd|yyyy").first()
    assert str(odd["obs_date"]) == "2024-05-01"


def readings(spark, hours, index=None):
    rows = [("a", d, h, 20.0 + d + h / 10, 40.0 - d, 10.0 + h, 180.0, 0.5 if h == 3 else 0.0) for d in range(1, 6) for h in hours]
    df = spark.createDataFrame(rows, "station_code string, d int, obs_hour int, temp double, rh double, ws double, wd double, precip double")
    df = df.withColumn("obs_date", F.expr("make_date(2024, 7, d)")).drop("d")
    return df if index is None else df.withColumns({"isi": F.lit(index) + F.col("obs_hour"), "bui": F.lit(50.0), "ffmc": F.lit(90.0)})


def test_fire_weather_list_and_its_fallbacks(spark):
    station = spark.createDataFrame([("a", "North")], "station_code string, station_name string")
    at_noon = fireweather.fire_weather_list(readings(spark, (3, 12, 13)), None, ()).orderBy("obs_date").collect()
    assert len(at_noon) == 5 and at_noon[0]["temp"] == pytest.approx(22.2) and at_noon[0]["precip"] == 0.5 and {"isi", "bui", "fwi", "dsr", "category", "event_days"} <= set(at_noon[0].asDict())
    at_one = fireweather.fire_weather_list(readings(spark, (3, 13)), None, ()).orderBy("obs_date").first()
    assert at_one["temp"] == pytest.approx(22.3)
    mean = fireweather.fire_weather_list(readings(spark, (3, 5)), None, ()).orderBy("obs_date").first()
    assert mean["temp"] == pytest.approx(21.4)
    given = fireweather.fire_weather_list(readings(spark, (3, 12), 0.0), station)
    assert {(r["obs_hour"], r["category"], r["station_name"]) for r in given.collect()} == {(12, "high", "North")}
    greatest = fireweather.fire_weather_list(readings(spark, (3, 10), 0.0), station)
    assert {(r["isi"], r["category"]) for r in greatest.collect()} == {(10.0, "high")} and greatest.count() == 5
    calm = fireweather.fire_weather_list(readings(spark, (3,), 0.0), station)
    assert calm.count() == 5 and {r["category"] for r in calm.collect()} == {"moderate"}
    bare = fireweather.fire_weather_list(readings(spark, (12,)).drop("rh"), station)
    assert {r["category"] for r in bare.collect()} == {"unknown"}
    per = fireweather.fire_weather_list(readings(spark, (12,)), station, (), keys=["station_code"]).first()
    assert per["station_name"] == "North" and per["station_code"] == "a"
    assert fireweather.fire_weather_list(readings(spark, (12,)).limit(0), station).count() == 0


def test_recurrence_of_ragged_series(spark):
    rng = np.random.default_rng(2)
    rows = [(k, d, float(rng.normal(15, 8)), None if d == 3 else float(rng.uniform(5, 100)), float(rng.uniform(0, 40)), float(rng.choice([0.0, 0.0, 1.0, 9.0]))) for k, n in (("a", 40), ("b", 1), (None, 25), ("c", 90)) for d in range(n)]
    df = spark.createDataFrame(rows, "k string, d int, temp double, rh double, ws double, precip double").withColumn("obs_date", F.expr("date_add(date'2024-03-01', d)")).drop("d")
    got = {(r["k"], r["obs_date"]): r for r in fireweather.recurrence(df, ["k"]).collect()}
    assert len(got) == len(rows)
    for k in ("a", "b", None, "c"):
        code = dict(fwi.START)
        for key, d, t, h, w, p in (r for r in rows if r[0] == k):
            h, day = 50.0 if h is None else h, pd.Timestamp("2024-03-01") + pd.Timedelta(days=d)
            code = {"ffmc": fwi.ffmc_step(t, h, w, p, code["ffmc"], fwi.PLAIN), "dmc": fwi.dmc_step(t, h, p, code["dmc"], day.month, 51.0, fwi.PLAIN), "dc": fwi.dc_step(t, p, code["dc"], day.month, fwi.PLAIN)}
            r = got[key, day.date()]
            assert (r["ffmc"], r["dmc"], r["dc"]) == pytest.approx(tuple(code.values()), rel=1e-9)
            assert r["fwi"] == pytest.approx(fwi.fwi(fwi.isi(code["ffmc"], w, fwi.PLAIN), fwi.bui(code["dmc"], code["dc"], fwi.PLAIN), fwi.PLAIN), rel=1e-9)
    assert fireweather.recurrence(df.where("k = 'c'"), []).count() == 90 and fireweather.recurrence(df.limit(0), ["k"]).count() == 0


def test_weather_at_steps(spark):
    obs = readings(spark, (0, 12))
    line = fireweather.weather_sequence(obs, 1719792000 + 6 * 3600, 3, 60.0).orderBy("step").collect()
    assert [r["temp"] for r in line] == pytest.approx([21.6, 21.7, 21.8]) and line[0]["isi"] == 5.0 and line[0]["wd"] == pytest.approx(180)
    assert fireweather.middle_start(obs) == 1719792000 + 2 * 86400 + 12 * 3600 and fireweather.middle_start(obs.limit(0)) == 1721044800
    empty = fireweather.weather_sequence(obs.limit(0), 0, 2).collect()
    assert len(empty) == 2 and empty[0]["bui"] == 50.0 and empty[0]["temp"] == 25.0
    typical = fireweather.representative(obs.limit(0)).first()
    assert typical["isi"] == 10.0 and typical["bui"] == 70.0


def test_streams_equal_batch(spark, tmp_path):
    dates = pd.date_range("2024-05-01", periods=12)
    rows = [("a", d.date(), 20.0 + i, 40.0, 10.0, float(i % 4 * 2)) for i, d in enumerate(dates)]
    schema = "station_code string, obs_date date, temp double, rh double, ws double, precip double"
    df = spark.createDataFrame(rows, schema)
    for k in range(3):
        df.where((F.dayofmonth("obs_date") - 1) % 12 >= k * 4).where((F.dayofmonth("obs_date") - 1) < k * 4 + 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = moisture.moisture_codes(stream).writeStream.format("memory").queryName("codes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("codes").orderBy("obs_date").toPandas()
    want = fireweather.recurrence(df, ["station_code"]).orderBy("obs_date").toPandas()
    assert len(got) == 12 and np.allclose(got["fwi"], want["fwi"]) and np.allclose(got["dc"], want["dc"])


def test_days_out_of_order_wait_for_the_watermark(spark, tmp_path):
    dates = pd.date_range("2024-05-01", periods=9)
    rows = [("a", d.date(), 20.0 + i, 40.0, 10.0, float(i % 4 * 2)) for i, d in enumerate(dates)]
    schema = "station_code string, obs_date date, temp double, rh double, ws double, precip double"
    for k, part in enumerate(([0, 2], [1, 3], [5, 4], [6, 8, 7])):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = moisture.moisture_codes(stream, late="2 days").writeStream.format("memory").queryName("waited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("waited").orderBy("obs_date").toPandas()
    want = fireweather.recurrence(spark.createDataFrame(rows, schema), ["station_code"]).orderBy("obs_date").toPandas()
    assert 5 <= len(got) < 9 and np.allclose(got["fwi"], want["fwi"][: len(got)]) and list(got["obs_date"]) == list(want["obs_date"][: len(got)])


def test_rain_stream(spark, tmp_path):
    from datetime import datetime

    rows = [("a", datetime(2024, 5, 1, h), 1.0) for h in range(24)] + [("a", datetime(2024, 5, 2, 5), 2.0), ("a", datetime(2024, 5, 3, 5), 0.5)]
    df = spark.createDataFrame(rows, "station_code string, ts timestamp, precip double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = moisture.rain_by_day(stream).writeStream.format("memory").queryName("rain").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["obs_date"]): r["precip_24h"] for r in spark.table("rain").collect()}
    assert got == {"2024-05-01": 24.0, "2024-05-02": 2.0}


def test_tables(spark, tmp_path):
    c = grid(spark, np.arange(12.0).reshape(3, 4)).withColumn("elev", F.when(F.col("elev") != 5, F.col("elev")))
    tables.write_ascii_grid(c, "elev", str(tmp_path / "g"), 100.0, 200.0, 10.0)
    back = tables.read_ascii_grid(spark, str(tmp_path / "g"), "elev").orderBy("grid_row", "grid_col").collect()
    assert [r["elev"] for r in back] == [None if v == 5 else float(v) for v in range(12)] and (back[0]["x"], back[0]["y"]) == (105.0, 225.0)
    tables.write_cells(c, str(tmp_path / "cells"), tile=2)
    assert tables.read_cells(spark, str(tmp_path / "cells"), (1, 1), tile=2).count() == 4
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"cause": "Human"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2]]]}, "properties": {}}]}))
    assert [(r["x"], r["y"]) for r in tables.read_geojson_points(spark, str(tmp_path / "p.geojson")).collect()] == [(1.5, 2.5), (1.0, 1.0)]
    (tmp_path / "k.kml").write_text("<kml><Document><Placemark><name>A</name><Point><coordinates>-115.7,51.2,0</coordinates></Point></Placemark></Document></kml>")
    assert [tuple(r) for r in tables.read_kml_points(spark, str(tmp_path / "k.kml")).collect()] == [("A", -115.7, 51.2)]
    (tmp_path / "w.csv").write_text(" Temp ,RH,WS,STATION\n20.5,40,M,7\n")
    row = tables.read_weather(spark, str(tmp_path / "w.csv")).first()
    assert (row["temp"], row["ws"], row["station_code"]) == (20.5, None, "7") and tables.weather_format(["TEMP", "RH", "WS"]) == "hourly"
    assert tables.read_weather(spark, None).count() == 0


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "c.yaml"
    assert cli.main(["init", "-o", str(path)]) == 0 and cli.main(["init", "-o", str(path)]) == 1 and cli.main(["info"]) == 0
    assert cli.main(["validate", str(path)]) == 1
    n = 30
    rows = [(i, j, (j + 0.5) * 30.0, -(i + 0.5) * 30.0, 1000.0, 2) for i in range(n) for j in range(n)]
    spark.createDataFrame(rows, "grid_row int, grid_col int, x double, y double, elev double, fuel_id int").write.parquet(str(tmp_path / "cells.parquet"))
    spark.createDataFrame([(1, 450.0, -450.0), (2, 200.0, -300.0)], "fire_id long, x double, y double").write.parquet(str(tmp_path / "ignitions.parquet"))
    path.write_text("inputs: {cells: ./cells.parquet, ignitions: ./ignitions.parquet}\nsimulation: {max_duration: 10, n_vertices: 24, store_every: 5}\nodd: 1\n")
    assert cli.main(["validate", str(path)]) == 0
    assert cli.main(["run", str(path), "-o", str(tmp_path / "out")]) == 0
    summary = spark.read.option("header", True).csv(str(tmp_path / "out" / "simulation_summary")).collect()
    assert len(summary) == 2 and all(float(r["area_ha"]) > 0 and float(r["dur_min"]) == 10 for r in summary)
    with pytest.raises(config.ConfigError):
        config.parse({"spread": {"curing": 101}})
