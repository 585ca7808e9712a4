"""From readings to daily fire weather: selection, recurrence, classes, interpolation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernbrand.functions import fwi
from fernbrand.functions.chance import uniform
from fernbrand.operators.quantiles import exact_quantiles
from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small

# Other names of the columns.
ALIASES = {
    "HOURLY_TEMPERATURE": "temp", "TEMPERATURE": "temp", "TEMP": "temp", "HOURLY_RELATIVE_HUMIDITY": "rh", "RELATIVE_HUMIDITY": "rh", "RH": "rh", "HOURLY_WIND_SPEED": "ws",
    "WIND_SPEED": "ws", "WS": "ws", "HOURLY_WIND_DIRECTION": "wd", "WIND_DIRECTION": "wd", "WD": "wd", "PRECIPITATION": "precip", "PRECIP": "precip", "RAIN": "precip",
    "AIR_TEMP": "temp", "WINDSPEED": "ws", "WINDDIR": "wd", "PPT": "precip", "INITIAL_SPREAD_INDEX": "isi", "BUILDUP_INDEX": "bui", "FIRE_WEATHER_INDEX": "fwi", "STATION": "station_code",
}
# What missing values of a day count as, and the weather of an empty table.
DAY_DEFAULTS = {"temp": 20.0, "rh": 50.0, "ws": 10.0, "precip": 0.0, "wd": 180.0}
USUAL = {"temp": 25.0, "rh": 40.0, "ws": 15.0, "wd": 180.0, "ffmc": 85.0, "dmc": 25.0, "dc": 200.0, "isi": 10.0, "bui": 70.0, "fwi": 20.0}
# Weather of an interpolator without readings, where it differs.
INTERPOLATED = USUAL | {"isi": 5.0, "bui": 50.0, "fwi": 15.0}
# Columns that may hold the time of a reading, the first of them counts, and forms it may have (days before months).
TIME_COLUMNS = ("datetime", "hourly", "date", "date_time", "timestamp")
HOUR_COLUMNS = ("hour", "hr", "hh")
TIME_FORMS = (
    "yyyy-MM-dd H:mm:ss", "yyyy-MM-dd H:mm", "yyyy-MM-dd H", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy/MM/dd H:mm:ss", "yyyy/MM/dd H:mm", "yyyy/MM/dd",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy H", "d/M/yyyy", "d-M-yyyy H:mm", "d-M-yyyy", "d.M.yyyy H:mm", "d.M.yyyy", "yyyyMMddHH", "yyyyMMdd",
)
#: Spread index from which a day is high, and extreme.
HIGH, EXTREME = 8.6, 12.6
MEASURES = ("temp", "rh", "ws", "wd")


def canonical(df: DataFrame) -> DataFrame:
    """Columns under their usual names; others in small letters."""
    return df.toDF(*[ALIASES.get(c.strip().upper(), c.strip().lower()) for c in df.columns])


def with_times(df: DataFrame, form: str | None = None) -> DataFrame:
    """``obs_ts``, ``obs_date`` and ``obs_hour`` of readings under their usual names (``canonical``).

    The first of ``TIME_COLUMNS`` counts, read by ``form`` if given, then by ``TIME_FORMS``; what
    none of them reads is null. The hour is that of an hour column if there is one. Tables that
    have ``obs_date`` already keep it.
    """
    names = {c.lower(): c for c in df.columns}
    at = next((names[c] for c in TIME_COLUMNS if c in names), None)
    if at is not None and "obs_date" not in names:
        text = F.trim(F.col(at).cast("string"))
        ts = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ([form] if form else []) + list(TIME_FORMS)]).cast("timestamp_ntz")
        df = df.withColumn("obs_ts", ts).withColumn("obs_date", F.col("obs_ts").cast("date"))
    own = next((names[c] for c in HOUR_COLUMNS if c in names), None)
    if own is not None:
        return df.withColumn("obs_hour", F.col(own).try_cast("double").cast("int"))
    return df.withColumn("obs_hour", F.hour("obs_ts")) if "obs_ts" in df.columns and "obs_hour" not in names else df


def _has(df: DataFrame, condition: Column) -> bool:
    return df.where(condition).select(F.lit(1)).limit(1).count() > 0


def noon_rows(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Means per key and day of the rows at noon; of those at 13 h if no row is at noon, of all if neither (or without hours)."""
    if "obs_hour" in obs.columns:
        hour = next((h for h in (12, 13) if _has(obs, F.col("obs_hour") == h)), None)
        obs = obs.where(F.col("obs_hour") == hour) if hour else obs
    return obs.where(F.col("obs_date").isNotNull()).groupBy(*keys, "obs_date").agg(*[F.avg(c).alias(c) for c in MEASURES if c in obs.columns])


def daily_weather(obs: DataFrame, keys: list[str], method: str = "noon") -> DataFrame:
    """A day's weather: its rows at noon, or (``max``, and where no row is at noon) the greatest spread
    index and the means of the measures. Tables without hours, or without an index for ``max``, stay as they are."""
    if "obs_hour" not in obs.columns:
        return obs
    if method == "noon" and _has(obs, F.col("obs_hour") == 12):
        return obs.where(F.col("obs_hour") == 12)
    return daily_max(obs, keys) if "isi" in obs.columns else obs


def rain_24h(obs: DataFrame, keys: list[str]) -> DataFrame:
    return obs.groupBy(*keys, "obs_date").agg(F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip_24h"))


def daily_max(obs: DataFrame, keys: list[str], peak: str = "isi") -> DataFrame:
    """Per key and day: the greatest ``peak`` and the means of the measures."""
    return obs.groupBy(*keys, "obs_date").agg(F.max(peak).alias(peak), *[F.avg(c).alias(c) for c in MEASURES if c in obs.columns])


CODES = ("ffmc", "dmc", "dc", "isi", "bui", "fwi", "dsr")
#: Days that are worked on at once.
TOGETHER = 500_000


def _carried(batches, n_keys: int, latitude: float):
    """Sorted days of whole series in, their codes and indices out; all series of a portion step together, day by day."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            last = _starts(table, n_keys)[-1]
            if last:
                yield from _codes(table.slice(0, last), n_keys, latitude)
            held, size = table.slice(last).to_batches(), table.num_rows - last
    if size:
        yield from _codes(pa.Table.from_batches(held).combine_chunks(), n_keys, latitude)


def _starts(table: pa.Table, n_keys: int) -> np.ndarray:
    """Rows at which a series begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(n_keys):
        # A null key differs from others by its validity, and equals another null.
        code = table.column(i).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _codes(table: pa.Table, n_keys: int, latitude: float):
    starts = _starts(table, n_keys)
    n, lengths = table.num_rows, np.diff(starts, append=table.num_rows)
    measure = {}
    for c in ("temp", "rh", "ws", "precip"):
        v = table.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy()
        measure[c] = np.where(np.isnan(v), DAY_DEFAULTS[c], v)
    month = pc.month(table.column("obs_date")).fill_null(1).to_numpy().astype(int)
    out = {c: np.empty(n) for c in CODES}
    # Longest series first, so that those that still run are always the first ones.
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    ffmc, dmc, dc = (np.full(len(starts), fwi.START[c]) for c in ("ffmc", "dmc", "dc"))
    running = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    with np.errstate(all="ignore"):
        for day, k in enumerate(running):
            at = starts[:k] + day
            t, h, w, p = (measure[c][at] for c in ("temp", "rh", "ws", "precip"))
            ffmc[:k] = fwi.ffmc_step(t, h, w, p, ffmc[:k], fwi.ARRAYS)
            dmc[:k] = fwi.dmc_step(t, h, p, dmc[:k], month[at], latitude, fwi.ARRAYS)
            dc[:k] = fwi.dc_step(t, p, dc[:k], month[at], fwi.ARRAYS)
            out["ffmc"][at], out["dmc"][at], out["dc"][at] = ffmc[:k], dmc[:k], dc[:k]
        out["isi"] = fwi.isi(out["ffmc"], measure["ws"], fwi.ARRAYS)
        out["bui"] = fwi.bui(out["dmc"], out["dc"], fwi.ARRAYS)
        out["fwi"] = fwi.fwi(out["isi"], out["bui"], fwi.ARRAYS)
        out["dsr"] = fwi.dsr(out["fwi"])
    names = [*table.column_names[:n_keys], "obs_date", *CODES]
    yield from pa.table([*[table.column(i) for i in range(n_keys)], table.column("obs_date"), *[pa.array(out[c]) for c in CODES]], names=names).to_batches(max_chunksize=10_000)


def recurrence(daily: DataFrame, keys: list[str], latitude: float = 51.0) -> DataFrame:
    """The moisture codes carried from day to day, and the indices of each day.

    ``daily``: keys (none: one series), ``obs_date``, ``temp``, ``rh``, ``ws``, ``precip``, one row a day. The
    order of days is inherent, so the days of a series are in one task; a task's series are read
    in order and step together. Null keys form a series; null measures count as in ``DAY_DEFAULTS``.
    """
    kinds = dict(daily.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "obs_date date", *[f"{c} double" for c in CODES]])
    rows = daily.select(*keys, "obs_date", "temp", "rh", "ws", "precip").where(F.col("obs_date").isNotNull())
    ordered = (rows.repartition(*[F.col(k) for k in keys]) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "obs_date")
    return ordered.mapInArrow(lambda batches: _carried(batches, len(keys), latitude), schema)


def category(isi: Column, high: float = HIGH, extreme: float = EXTREME) -> Column:
    """``extreme``, ``high`` or ``moderate``; missing indices are moderate."""
    known = F.when(~F.isnan(isi), isi)
    return F.when(known >= extreme, "extreme").when(known >= high, "high").otherwise("moderate")


def keep_categories(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted categories; all rows if there are none."""
    return df.where(F.col("category").isin(wanted)) if wanted and _has(df, F.col("category").isin(wanted)) else df


def category_counts(df: DataFrame) -> DataFrame:
    """Days per category."""
    return df.groupBy("category").agg(F.count("*").alias("n_days"))


def event_statistics(df: DataFrame) -> DataFrame:
    """Mean, least and greatest number of spread event days."""
    return df.agg(F.avg("event_days").alias("mean_days"), F.min("event_days").alias("least_days"), F.max("event_days").alias("most_days"))


def with_station(df: DataFrame, station: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(station), "station_code", "left")


def spread_event_days(df: DataFrame, key: Column, mean: float = 3.76, seed: int = 0) -> DataFrame:
    """``event_days``: a Poisson number, 1 at least, by inverting its distribution at a seeded hash of ``key``."""
    u = uniform(seed, key)
    steps, p, total = F.lit(1), 2.718281828459045**-mean, 0.0
    for k in range(60):
        total += p
        if k:
            steps = steps + F.when(F.col("_u") > total, 1).otherwise(0)
        p *= mean / (k + 1)
    return df.withColumn("_u", u).withColumn("event_days", steps).drop("_u")


def sample_rows(df: DataFrame, n: int, key: Column, seed: int = 0) -> DataFrame:
    """``n`` rows (all if fewer) in a seeded random order."""
    return df.orderBy(uniform(seed, key), key).limit(n)


def fire_weather_list(
    weather: DataFrame, station: DataFrame | None = None, wanted: tuple[str, ...] = ("high", "extreme"), compute: bool = True, latitude: float = 51.0, mean_days: float = 3.76, seed: int = 0,
    high: float = HIGH, extreme: float = EXTREME, keys: list[str] | None = None,
) -> DataFrame:
    """From readings to days of fire weather: indices, classes, the wanted classes, event days, station.

    ``weather``: readings under their usual names with ``obs_date`` and, if known, ``obs_hour``. Where
    the table has no indices but the measures, they are computed (``compute``) from the means at noon and the
    day's rain, of all stations together or per ``keys``; else the readings at noon count, or the
    day's greatest index. Without any index all days are of class ``unknown``. If no day is of a wanted class, all are kept.
    """
    keys, names = keys or [], set(weather.columns)
    if compute and not {"ffmc", "isi", "bui"} <= names and {"temp", "rh", "ws"} <= names:
        noon = noon_rows(weather, keys)
        rain = rain_24h(weather, keys) if "precip" in names else noon.select(*keys, "obs_date", F.lit(0.0).alias("precip_24h"))
        # A day's measures and its rain; null keys match.
        pairs = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys] + [F.col("_obs_date") == F.col("obs_date")]
        same = pairs[0]
        for other in pairs[1:]:
            same = same & other
        days = noon.join(rain.withColumnsRenamed({c: f"_{c}" for c in [*keys, "obs_date"]}), same, "left").drop("_obs_date", *[f"_{k}" for k in keys])
        days = cut(days.withColumn("precip", F.coalesce("precip_24h", F.lit(0.0))).drop("precip_24h"))
        codes = recurrence(days, keys, latitude).withColumnsRenamed({c: f"_{c}" for c in [*keys, "obs_date"]})
        daily = days.join(codes, same).drop("_obs_date", *[f"_{k}" for k in keys])
    else:
        daily = daily_weather(weather, keys or [c for c in ("station_code",) if c in names])
    if "isi" in daily.columns:
        daily = keep_categories(daily.withColumn("category", category(F.col("isi").cast("double"), high, extreme)), list(wanted))
    else:
        daily = daily.withColumn("category", F.lit("unknown"))
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("station_code", "obs_date", "obs_hour") if c in daily.columns])
    daily = spread_event_days(daily, key, mean_days, seed)
    return with_station(daily, station) if station is not None and "station_code" in daily.columns else daily


def representative(df: DataFrame) -> DataFrame:
    """One row of typical weather: medians of the high and extreme days, and their upper quartiles of
    indices and wind if all days are such; of all days if none is. What isn't known is as in ``USUAL``."""
    spark = df.sparkSession
    known = [c for c in USUAL if c in df.columns]
    severe = F.col("category").isin("high", "extreme") if "category" in df.columns else F.lit(False)
    counts = df.agg(F.count_if(severe).alias("severe"), F.count("*").alias("all")).first()
    rows = df.where(severe) if counts["severe"] else df
    upper = counts["severe"] in (0, counts["all"])
    wanted = {c: [0.75 if upper and c in ("isi", "bui", "fwi", "ws") else 0.5] for c in known}
    found = exact_quantiles(rows, wanted) if counts["all"] and known else {}
    values = {c: (found.get(c) or [None])[0] for c in USUAL}
    return spark.range(1).select(*[F.lit(float(v if v is not None else USUAL[c])).alias(c) for c, v in values.items()])


def observation_second(df: DataFrame) -> DataFrame:
    """``second``: that of ``obs_date`` and ``obs_hour``, as if in UTC."""
    return df.withColumn("second", F.unix_date("obs_date").cast("long") * 86400 + F.coalesce(F.col("obs_hour"), F.lit(0)).cast("long") * 3600)


def middle_start(obs: DataFrame, hour: int = 12) -> int:
    """Second of ``hour`` on the middle day of the readings (in order of time); 2024-07-15 12:00 without any."""
    days = obs.where(F.col("obs_date").isNotNull()).select(F.unix_date("obs_date").alias("d"))
    counts = days.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    wanted, upto = sum(r["n"] for r in counts) // 2, 0
    for r in counts:
        upto += r["n"]
        if upto > wanted:
            return r["d"] * 86400 + hour * 3600
    return 1721044800


def weather_sequence(obs: DataFrame, start: int, steps: int, minutes: float = 1.0) -> DataFrame:
    """``step`` and the weather at each of ``steps`` instants from ``start`` on, as one series; ``INTERPOLATED`` where nothing is known."""
    spark = obs.sparkSession
    known = [c for c in INTERPOLATED if c in obs.columns]
    line = spark.range(steps).select(F.col("id").cast("int").alias("step"))
    if known:
        read = obs if "second" in obs.columns else observation_second(obs)
        # Instants of a fraction of a second are kept by counting in thousandths.
        read = read.withColumn("_ms", F.col("second") * 1000).withColumn("_all", F.lit(1))
        made = interpolate(read, ["_all"], "_ms", [c for c in known if c != "wd"], [c for c in known if c == "wd"], start * 1000, round(minutes * 60_000), steps)
        line = line.join(broadcast_if_small(made.select(F.col("step").alias("_step"), *known)), F.col("step") == F.col("_step"), "left")
    value = {c: F.coalesce(F.when(~F.isnan(F.col(c)), F.col(c)), F.lit(v)) if c in known else F.lit(v) for c, v in INTERPOLATED.items()}
    return line.select("step", *[v.alias(c) for c, v in value.items()])


def interpolate(obs: DataFrame, keys: list[str], second_col: str, values: list[str], angles: list[str], start: int, step: int, steps: int) -> DataFrame:
    """Values at ``steps`` instants ``start``, ``start + step``, ...: linear between readings, held beyond
    the first and the last; angles along the shorter arc. Of equal instants the last reading counts.

    Each reading yields the instants of the interval it begins, so nothing is compared with all.
    """
    order = Window.partitionBy(*keys).orderBy("_s")
    columns = [*values, *angles]
    last = F.max_by(F.struct(*columns), F.struct(*columns))
    once = obs.where(F.col(second_col).isNotNull()).groupBy(*keys, F.col(second_col).alias("_s")).agg(last.alias("_v"))
    pairs = once.withColumns({"_next": F.lead("_s").over(order), "_after": F.lead("_v").over(order), "_first": F.row_number().over(order) == 1})
    low = F.when(F.col("_first"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.floor((F.col("_s") - start) / step) + 1))
    high = F.when(F.col("_next").isNull(), F.lit(steps - 1)).otherwise(F.least(F.lit(steps - 1), F.floor((F.col("_next") - start) / step)))
    ticks = pairs.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).where(F.col("_low") <= F.col("_high"))
    rows = ticks.withColumn("step", F.explode(F.sequence("_low", "_high"))).withColumn("second", start + F.col("step").cast("long") * step)
    weight = F.when(F.col("_next").isNull() | (F.col("second") <= F.col("_s")), 0.0).otherwise((F.col("second") - F.col("_s")) / (F.col("_next") - F.col("_s")))
    rows = rows.withColumn("_w", weight)
    w = F.col("_w")
    mixed = {v: F.when(w == 0, F.col(f"_v.{v}")).otherwise(F.col(f"_v.{v}") * (1 - w) + F.col(f"_after.{v}") * w) for v in values}
    return rows.select(*keys, "step", "second", *[x.alias(v) for v, x in mixed.items()], *[circular(F.col(f"_v.{a}"), F.coalesce(F.col(f"_after.{a}"), F.col(f"_v.{a}")), w).alias(a) for a in angles])


def circular(a: Column, b: Column, weight: Column) -> Column:
    """Direction between two directions (degrees), by their mean vector; from 0 up to 360."""
    part = lambda f: f(F.radians(a)) * (1 - weight) + f(F.radians(b)) * weight
    turned = F.degrees(F.atan2(part(F.sin), part(F.cos)))
    return F.when(turned < 0, turned + 360.0).otherwise(turned)
