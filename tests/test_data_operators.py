import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernbrand.functions import forest, ssa
from fernbrand.functions import units as unit_functions
from fernbrand.operators import neighbours, regular, spikes, trailing, units

NAN = float("nan")


# --- near points ------------------------------------------------------------------------------


def brute_pairs(points, distance):
    seen = {(i, x, y) for i, x, y in points if i is not None and x is not None and y is not None and math.isfinite(x) and math.isfinite(y)}
    rows = sorted(seen)
    return {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[0] != b[0] and round((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, 6) <= distance**2}


def pairs(spark, points, distance=100, **options):
    df = spark.createDataFrame(points, "ignition_id long, x double, y double").withColumn("_r", F.lit(1)).withColumn("id_a", F.lit(2))
    return {tuple(r) for r in neighbours.near_pairs(df, "ignition_id", "x", "y", distance, 2, **options).collect()}


def test_near_pairs_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    points = [(i, round(rng.uniform(-40_000, 40_000) if i % 3 else rng.uniform(0, 900), 2), round(rng.uniform(0, 6_000) if i % 4 else 2000.0, 2)) for i in range(2500)]
    points += [(1, points[1][1], points[1][2]), (5000, None, 1.0), (5001, NAN, 1.0), (5002, 1.0, float("inf")), (None, 1.0, 1.0), (6000, 10.0, 10.0), (6001, 70.0, 90.0), (6002, 10.0, 10.0)]
    monkeypatch.setattr(neighbours, "RANGE_POINTS", 100)
    found = neighbours.near_pairs(spark.createDataFrame(points, "a long, x double, y double"), "a", "x", "y", 100, 2)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_pairs(points, 100)
    assert (6000, 6001) in rows and (6000, 6002) in rows


def test_near_pairs_edges(spark):
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, 0.0, 0.0), (1, 0.0, 0.0)]) == set()
    assert pairs(spark, [(1, 0.0, 0.0), (2, 0.0, 0.0)], 0) == {(1, 2)}
    assert pairs(spark, [(1, 0.0, 0.0), (2, 0.0, 0.0)], -1) == set()
    assert pairs(spark, [(1, 0.0, 0.0), (1, 5000.0, 0.0), (2, 1.0, 0.0), (2, 5001.0, 0.0)]) == {(1, 2)}


# --- units ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "field", "expected"), [
    ("38.4 F", "temperature", (38.4, "F")), ("−3,5 deg C", "temperature", (-3.5, "C")), ("284.67", "temperature", (284.67, "")), ("3.1MPH", "wind_speed", (3.1, "mph")),
    ("1,2m/s", "wind_speed", (1.2, "m/s")), ('0.02"', "precipitation", (0.02, "in")), ("5 furlongs", "wind_speed", (5.0, None)), ("0,00cm", "precipitation", (0.0, "cm")),
])
def test_read_value(text, field, expected):
    assert unit_functions.read_value(text, field) == expected


@pytest.mark.parametrize(("text", "expected"), [
    ("rain gauge in inches, thermometer fahrenheit, anemometer knots", ("F", "kn", "in")), ("T[K] W[m/s] P[mm]", ("K", "m/s", "mm")), ("units=degC/mph/mm", ("C", "mph", "mm")),
    ("rain gauge in millimetres, thermometer celsius", ("C", None, "mm")), ("wind in knots, rain gauge counts tenths of a millimetre.", (None, "kn", "0.1mm")),
    ("Fahrenheit, miles per hour, rain as hundredths of an inch.", ("F", "mph", "0.01in")), (None, (None, None, None)), ("Decimal comma on the older units.", (None, None, None)),
])
def test_named_unit(text, expected):
    assert tuple(unit_functions.named_unit(text, f) for f in ("temperature", "wind_speed", "precipitation")) == expected


def test_convert_units(spark):
    rows = [(1, "50 F", "10", "1", "units=K/m/s/in", "a"), (2, "10", "10", "2", None, "a"), (3, None, "", "M", None, None), (4, "10 zz", "n/a", "-", None, "a"), (1, "50 F", "10", "1", "units=K/m/s/in", "a")]
    df = spark.createDataFrame(rows, "id int, temperature string, wind_speed string, precipitation string, note string, feed string").withColumn("unit", F.lit(9))
    remarks = spark.createDataFrame([("a", "wind in knots")], "feed_id string, remarks string")
    out = units.convert_units(df, ["id"], ["temperature", "wind_speed", "precipitation"], "feed", "note", remarks).collect()
    got = sorted((r["id"], r["field_name"], r["unit"], r["unit_from"], r["common_value"] and round(r["common_value"], 6)) for r in out)
    first = [(1, "precipitation", "in", "note", 25.4), (1, "temperature", "F", "value", 10.0), (1, "wind_speed", "m/s", "note", 36.0)]
    assert got == sorted(first * 2 + [(2, "precipitation", "mm", "none", 2.0), (2, "temperature", "C", "none", 10.0), (2, "wind_speed", "kn", "remarks", 18.52), (4, "temperature", None, "value", None)], key=str) or sorted(got, key=str) == sorted(first * 2 + [(2, "precipitation", "mm", "none", 2.0), (2, "temperature", "C", "none", 10.0), (2, "wind_speed", "kn", "remarks", 18.52), (4, "temperature", None, "value", None)], key=str)
    assert units.convert_units(df.limit(0), ["id"], ["temperature"], "feed").collect() == []


def test_mixture_finds_missing_units(spark):
    rng = random.Random(1)
    known = [(i, f"{rng.gauss(40, 12):.1f} km/h", "k") for i in range(800)]
    bare = [(1000 + i, f"{max(rng.gauss(40, 12), 1) / 3.6:.1f}", "metres") for i in range(300)] + [(2000 + i, f"{max(rng.gauss(40, 12), 1):.1f}", "plain") for i in range(300)]
    df = spark.createDataFrame(known + bare, "id int, wind_speed string, feed string")
    out = units.convert_units(df, ["id"], ["wind_speed"], "feed", missing="posterior").where("unit_from = 'none'").collect()
    metres, plain = [r["unit"] for r in out if r["id"] < 2000], [r["unit"] for r in out if r["id"] >= 2000]
    assert metres.count("m/s") > 0.8 * len(metres) and plain.count("km/h") > 0.8 * len(plain)
    assert any(r["unit_uncertain"] for r in units.convert_units(df, ["id"], ["wind_speed"], "feed").where("unit_from = 'none'").collect())


# --- regular series ---------------------------------------------------------------------------


def holed_cycles(n=6, length=608):
    rng = np.random.default_rng(5)
    noise = np.zeros((n, length))
    for i in range(1, length):
        noise[:, i] = 0.9 * noise[:, i - 1] + rng.normal(size=n)
    true = 3 * np.sin(np.arange(length) * 2 * np.pi / 24) + noise
    x = true.copy()
    for row, size in zip(x, (24, 48, 96, 144, 192, 240)):
        row[200 : 200 + size] = np.nan
    x[rng.random(x.shape) < 0.05] = np.nan
    return true, x


def plain_step(x, window=24, rank=4):
    """One step written out: trajectory matrix, truncated singular vectors, diagonal averages."""
    rows = np.lib.stride_tricks.sliding_window_view(x, window)
    u, s, v = np.linalg.svd(rows, full_matrices=False)
    flat = (u[:, :rank] * s[:rank]) @ v[:rank]
    total, n = np.zeros(len(x)), np.zeros(len(x))
    for j in range(window):
        total[j : j + len(rows)] += flat[:, j]
        n[j : j + len(rows)] += 1
    return total / n


def test_imputation_restores_a_cycle():
    t = np.arange(600)
    true = 10 + 5 * np.sin(2 * np.pi * t / 24) + 0.01 * t
    holed = true.copy()
    holed[200:212] = np.nan
    holed[np.random.default_rng(0).choice(600, 60, replace=False)] = np.nan
    full = ssa.impute(np.stack([holed, np.full(600, np.nan), np.full(600, 3.0)]))
    assert np.abs(full[0] - true).max() < 0.6 and np.isnan(full[1]).all() and (full[2] == 3).all()
    assert (full[0][~np.isnan(holed)] == true[~np.isnan(holed)]).all()


def test_imputation_ends_where_a_plain_step_moves_nothing():
    true, x = holed_cycles()
    full, settled = ssa.impute_marked(x)
    assert settled.all() and np.array_equal(full, ssa.impute(x)) and not ssa.impute_marked(x, steps=3)[1].all()
    for row, given, real in zip(full, x, true):
        missing, spread, mean = np.isnan(given), np.nanstd(given), np.nanmean(given)
        moved = plain_step((row - mean) / spread) - (row - mean) / spread
        assert np.abs(moved[missing]).max() < 0.012 and np.sqrt(np.mean((row - real)[missing] ** 2)) < 1.1 * spread


def test_imputation_keeps_to_the_bounds_of_a_series():
    _, x = holed_cycles()
    wide = np.concatenate([np.full((6, 40), np.nan), x, np.full((6, 90), np.nan)], 1)
    low, high = np.full(6, 40), np.full(6, 648)
    full, _ = ssa.impute_marked(wide, low=low, high=high)
    # The phase of the first guesses differs, so the values agree to what a step may still move.
    assert np.isnan(full[:, :40]).all() and np.isnan(full[:, 648:]).all() and not np.isnan(full[:, 40:648]).any()
    moved = plain_step((full[0, 40:648] - np.nanmean(x[0])) / np.nanstd(x[0])) - (full[0, 40:648] - np.nanmean(x[0])) / np.nanstd(x[0])
    assert np.abs(moved[np.isnan(x[0])]).max() < 0.012
    short = ssa.impute_marked(wide, low=low, high=np.full(6, 70))[0]
    assert not np.isnan(short[:, 40:70]).any() and np.isnan(short[:, 70:]).all()


def test_gram_is_that_of_the_trajectory_matrix():
    x = np.random.default_rng(1).normal(size=(2, 60))
    hankel = np.stack([np.lib.stride_tricks.sliding_window_view(r, 7) for r in x])
    assert np.allclose(ssa._gram(x, x[:, :7], x[:, -7:]), hankel.transpose(0, 2, 1) @ hankel)


def test_regular_series(spark):
    hours = [0, 1, 2, 5, 1400, 1402]
    rows = [("s", 1, h * 3600 + 60, float(h), 1.0) for h in hours] + [("s", 1, 60, 0.0, 1.0), ("s", 1, 3 * 3600, None, 1.0), ("s", 1, None, 1.0, 1.0), (None, 2, 50, 1.0, NAN), (None, 3, 7200, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "station_code string, logger_id long, t long, a double, b double").withColumn("period", F.lit("x"))
    out = regular.regular_series(df, ["station_code", "logger_id"], "t", ["a", "b"]).collect()
    grid = {(r["logger_id"], r["period"]): r for r in out}
    assert sorted(p for i, p in grid if i == 1) == list(range(1403)) and [k for k in grid if k[0] != 1] == [(3, 2)]
    assert sorted(p for (i, p), r in grid.items() if i == 1 and not r["is_filled"]) == hours
    assert grid[1, 5]["a"] == 5.0 and grid[1, 3]["a"] is not None and grid[1, 700]["is_filled"]
    assert regular.regular_series(df.limit(0), ["station_code", "logger_id"], "t", ["a"]).collect() == []


# --- trailing totals --------------------------------------------------------------------------


@pytest.mark.parametrize("days", [1, 2, 3, 7, 30, 31, 64])
def test_trailing_sums(spark, days):
    rng = random.Random(days)
    values = {d: rng.randint(0, 9) for d in rng.sample(range(120), 50)}
    df = spark.createDataFrame([("k", d, v) for d, v in values.items()], "k string, day int, v long")
    out = trailing.trailing_sums(trailing.daily_grid(df, ["k"], "day", ["v"]), ["k"], "day", {"s": ("v", days)}).collect()
    assert {r["day"]: r["s"] for r in out} == {d: sum(values.get(e, 0) for e in range(d - days + 1, d + 1)) for d in range(min(values), max(values) + 1)}


def test_trailing_totals(spark):
    rows = [("a", 10, 5, None), ("a", 10, 5, 7), ("a", 20, 1, 8), ("a", 86400 * 3, None, 2), ("a", None, 9, 9), (None, 5, 1, 1)]
    df = spark.createDataFrame(rows, "k string, t long, p long, q long").withColumn("day", F.lit(0))
    out = {(r["k"], r["day"]): r for r in trailing.trailing_totals(df, ["k"], "t", ["p", "q"], [2, 30]).collect()}
    assert sorted(d for k, d in out if k == "a") == [0, 1, 2, 3] and (None, 0) in out
    assert out["a", 0]["p_sum_2"] == 6 and out["a", 0]["q_mean_2"] == 7.5 and out["a", 2]["p_sum_2"] == 0 and out["a", 2]["q_mean_2"] is None
    assert out["a", 3]["q_sum_30"] == 17 and out["a", 3]["p_count_30"] == 2 and out["a", 3]["first_day"] == 0
    assert trailing.trailing_totals(df.limit(0), ["k"], "t", ["p"], [7]).collect() == []


# --- spikes -----------------------------------------------------------------------------------


def brute_flags(series, field, change, positive):
    out = set()
    n, values = len(series), [v for _, v in series]
    if field == "precipitation":
        out |= {t for t, v in series if positive is not None and v > 8 * positive}
    else:
        for size in (1, 2, 3):
            for i in range(1, n - size):
                run, a, b = values[i : i + size], values[i - 1], values[i + size]
                height = max(min(run) - max(a, b), min(a, b) - max(run))
                if change is not None and height > 0 and height >= 8 * change:
                    out |= {t for t, _ in series[i : i + size]}
    i = 0
    while i < n:
        j = i
        while j < n and values[j] == values[i]:
            j += 1
        ordinary = spikes.ORDINARY_RUNS.get(field)
        if j - i >= 10 and values[i] != (None if ordinary is None else int(ordinary * 1000)):
            out |= {t for t, _ in series[i:j]}
        i = j
    return out


def test_flags_against_brute_force(spark):
    rng = random.Random(5)
    rows, i = [], 0
    for s in ("a", "b", None):
        value = 10.0
        for h in range(300):
            value = round(value + rng.choice([-0.5, 0.5, 1.0, -1.0]), 1)
            shown = value + (60 if rng.random() < 0.02 else 0)
            shown = 7.0 if 100 <= h < 112 else shown
            rain = rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, 50.0])
            rows.append((i, s, h * 3600 + rng.randint(0, 3599), shown if rng.random() > 0.05 else None, rain))
            i += 1
    rows += [(i, "a", rows[5][2], rows[5][3], rows[5][4]), (i + 1, "a", None, 99.0, -1.0), (i + 2, "b", None, NAN, 5.0)]
    df = spark.createDataFrame(rows, "id int, station string, t long, temperature double, precipitation double").withColumn("score", F.lit("x"))
    got = {(r["id"], r["field_name"]) for r in spikes.flag_rows(df, "id", "station", "t", ["temperature", "precipitation"], block=40).collect()}
    want = set()
    for f, k in (("temperature", 3), ("precipitation", 4)):
        low, high = spikes.LIMITS[f]
        want |= {(r[0], f) for r in rows if r[k] is not None and not math.isnan(r[k]) and not low <= r[k] <= high}
        for s in ("a", "b", None):
            series = sorted({(r[2], round(r[k] * 1000)) for r in rows if r[1] == s and r[2] is not None and r[k] is not None})
            steps = sorted(abs(b[1] - a[1]) for a, b in zip(series, series[1:]) if b[0] // 3600 - a[0] // 3600 == 1)
            positive = [v for _, v in series if v > 0]
            flagged = brute_flags(series, f, np.median(steps) if steps else None, np.median(positive) if positive else None)
            want |= {(r[0], f) for r in rows if r[1] == s and r[2] in flagged and r[k] is not None}
    assert got == want
    again = {(r["id"], r["field_name"]) for r in spikes.flag_rows(df, "id", "station", "t", ["temperature", "precipitation"], whole=50, block=64).collect()}
    assert again == want
    scored = spikes.score_readings(df, "station", "t", ["temperature"]).collect()
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == len({(r[1], r[2]) for r in rows if r[2] is not None and r[3] is not None})
    assert spikes.flag_rows(df.limit(0), "id", "station", "t", ["temperature"]).collect() == []


def test_forest_isolates_the_odd():
    rng = np.random.default_rng(0)
    normal = rng.normal(size=(1, 256, 3))
    rows = np.concatenate([normal[0, :50], [[9.0, 9.0, 9.0]]])
    one = [g[0] for g in forest.grow(normal, np.array([256]), [3])]
    score = forest.scores(*one, rows.T)
    assert score[-1] > 0.65 and score[-1] > score[:-1].max() and np.median(score[:-1]) < 0.55
    other = np.concatenate([normal, rng.normal(size=(1, 256, 3))])
    beside = [g[0] for g in forest.grow(other, np.array([256, 90]), [3, 8])]
    assert np.array_equal(forest.scores(*beside, rows.T), score)
    lone = [g[0] for g in forest.grow(np.zeros((1, 1, 2)), np.array([1]), [0])]
    assert (forest.scores(*lone, np.zeros((2, 3))) == 0.5).all()


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(11)
    rows = [(s, h * 1800, round(10 + 5 * math.sin(h / 8) + rng.gauss(0, 1), 1) + (40 if rng.random() < 0.01 else 0)) for s, n in (("a", 4000), ("b", 700), ("c", 3), ("d", 1), ("e", 900)) for h in range(n)]
    df = spark.createDataFrame(rows, "station string, t long, temperature double").repartition(5)
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for partitions, block, whole in ((1, 8192, 100_000), (7, 8192, 100_000), (7, 100, 500), (64, 8192, 100_000)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            results.append({(r["source"], r["second"]): (r["score"], r["in_jump"], r["in_run"]) for r in spikes.score_readings(df, "station", "t", ["temperature"], block, whole).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(results[0]) == len(rows) and all(r == results[0] for r in results)
    odd = [v[0] for (s, t), v in results[0].items() if s == "a" and v[1]]
    assert len(odd) > 20 and np.mean(odd) > np.mean([v[0] for (s, _), v in results[0].items() if s == "a"]) + 0.1
