"""The pN_ queries of the general problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand.functions.units import COMMON
from fernbrand.operators import neighbours, regular, spikes, times, trailing, units
from fernbrand.plans import data_oracles


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    station, feed = _read(spark, sf_dir, "station"), _read(spark, sf_dir, "weather_feed")
    weather = times.weather_times(_read(spark, sf_dir, "weather", "obs_id", "station_code", "feed_id", "obs_date", "obs_hour"), feed, station)
    record = times.record_times(_read(spark, sf_dir, "weather_record", "record_id", "station_code", "obs_datetime"), station)
    return (
        weather.select(F.lit("weather").alias("table_name"), F.col("obs_id").alias("row_id"), "utc_second")
        .unionByName(record.select(F.lit("weather_record").alias("table_name"), F.col("record_id").alias("row_id"), "utc_second"))
        .where(F.col("utc_second").isNotNull())
    )


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms in which each feed writes its dates, and their fitted shares."""
    shares = times.form_shares(_read(spark, sf_dir, "weather", "feed_id", "obs_date", "obs_hour"), "obs_date", "obs_hour", "feed_id")
    return shares.select(F.col("source").alias("feed_id"), "form", F.round("share", 6).alias("share"), F.round("n_values", 3).alias("n_values"))


FIELDS = ["temperature", "wind_speed", "precipitation"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    remarks = _read(spark, sf_dir, "weather_feed", "feed_id", "remarks")
    weather = _read(spark, sf_dir, "weather", "obs_id", "feed_id", *FIELDS, "unit_note")
    values = units.convert_units(weather, ["obs_id"], FIELDS, "feed_id", "unit_note", remarks)
    other = ~F.concat_ws(" ", "field_name", "unit").isin(*[f"{f} {u}" for f, u in COMMON.items()])
    return values.where(F.col("common_value").isNotNull() & other).select("obs_id", "field_name", F.round(F.col("common_value") * 1000).cast("long").alias("common_milli"))


def p4_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without a unit anywhere: the unit that the mixture of their feed finds likeliest, its posterior, and whether it is uncertain."""
    remarks = _read(spark, sf_dir, "weather_feed", "feed_id", "remarks")
    weather = _read(spark, sf_dir, "weather", "obs_id", "feed_id", *FIELDS, "unit_note")
    values = units.convert_units(weather, ["obs_id"], FIELDS, "feed_id", "unit_note", remarks, missing="posterior").where("unit_from = 'none'")
    return values.select("obs_id", "field_name", "unit", F.round("common_value", 6).alias("common_value"), F.round("unit_posterior", 6).alias("unit_posterior"), "unit_uncertain")


LOGGER = ["station_code", "logger_id"]


def _readings(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    """Rows of weather with their instant and the fields in thousandths of common units."""
    station, remarks = _read(spark, sf_dir, "station"), _read(spark, sf_dir, "weather_feed", "feed_id", "remarks")
    weather = _read(spark, sf_dir, "weather", *LOGGER, "feed_id", "obs_date", "obs_hour", *fields, "unit_note")
    timed = times.weather_times(weather, remarks, station)
    return units.with_milli(timed, fields, "feed_id", "unit_note", remarks)


HOURLY = ["temperature_milli", "wind_speed_milli"]


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = regular.regular_series(_readings(spark, sf_dir, ["temperature", "wind_speed"]), LOGGER, "utc_second", HOURLY)
    return series.withColumn("utc_hour_start", F.col("period") * 3600)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).where("is_filled").select(*LOGGER, "utc_hour_start")


def p3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series of each logger, with its filled hours."""
    return _hourly(spark, sf_dir).select(*LOGGER, "utc_hour_start", *HOURLY, "is_filled", "is_settled")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = ["precipitation_milli", "temperature_milli"]
    days = trailing.trailing_totals(_readings(spark, sf_dir, ["precipitation", "temperature"]), LOGGER, "utc_second", measures, [7, 30])
    wet = F.col("precipitation_milli_sum_7") >= 40_000
    warm = (F.col("temperature_milli_count_7") > 0) & (F.col("temperature_milli_sum_7") >= 20_000 * F.col("temperature_milli_count_7"))
    dry = (F.col("precipitation_milli_sum_30") < 1_000) & (F.col("day") - F.col("first_day") >= 29) & warm
    kinds = F.array_compact(F.array(F.when(wet, "wet7"), F.when(dry, "dry30")))
    return days.select(*LOGGER, F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("utc_day"), F.explode(kinds).alias("kind"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours.near_pairs(_read(spark, sf_dir, "ignition", "ignition_id", "x", "y"), "ignition_id", "x", "y", 100, decimals=2)
    return pairs.select(F.col("id_a").alias("ignition_id_a"), F.col("id_b").alias("ignition_id_b"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = list(spikes.LIMITS)
    return times.record_times(_read(spark, sf_dir, "weather_record", "record_id", "station_code", "obs_datetime", *fields), _read(spark, sf_dir, "station"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spikes.flag_rows(_records(spark, sf_dir), "record_id", "station_code", "utc_second", list(spikes.LIMITS))
    return flags.select(F.col("id").alias("record_id"), "field_name").distinct()


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with the score of its station's forest, beside the rules' flags."""
    scored = spikes.score_readings(_records(spark, sf_dir), "station_code", "utc_second", list(spikes.LIMITS))
    return scored.select(F.col("source").alias("station_code"), "field_name", F.col("second").alias("utc_second"), F.round("score", 6).alias("score"), "impossible", "in_jump", "in_run")


QUERIES = {
    "p1_found": p1_found, "p1_forms": p1_forms, "p2_found": p2_found, "p3_found": p3_found, "p3_series": p3_series, "p4_found": p4_found, "p4_missing": p4_missing, "p5_found": p5_found, "p6_found": p6_found,
    "p6_scores": p6_scores,
}

ORACLES: dict[str, str] = data_oracles.ORACLES | {
    "p2_found": """
        with p as (select distinct ignition_id id, round(x * 100)::bigint x, round(y * 100)::bigint y from ignition
                   where ignition_id is not null and isfinite(x) and isfinite(y)),
        t as (select *, x // 10000 cx, y // 10000 cy from p)
        select distinct a.id ignition_id_a, b.id ignition_id_b
        from t a cross join (values (-1), (0), (1)) dx(i) cross join (values (-1), (0), (1)) dy(j)
        join t b on b.cx = a.cx + dx.i and b.cy = a.cy + dy.j
        where a.id < b.id and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100000000""",
}
