"""Streams: rain of the day by event time, and moisture codes carried per station."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fernbrand.functions import fwi
from fernbrand.operators.fireweather import DAY_DEFAULTS

MEASURES = ("temp", "rh", "ws", "precip")
EPOCH = date(1970, 1, 1)
CODES = "station_code string, obs_date date, ffmc double, dmc double, dc double, isi double, bui double, fwi double, dsr double"


def rain_by_day(obs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Rain per station and day of event time ``ts``; rows later than ``late`` are dropped by the watermark."""
    days = obs.withWatermark("ts", late).groupBy("station_code", F.window("ts", "1 day"))
    return days.agg(F.sum("precip").alias("precip_24h")).select("station_code", F.col("window.start").cast("date").alias("obs_date"), "precip_24h")


def moisture_codes(daily: DataFrame, latitude: float = 51.0, late: str | None = None) -> DataFrame:
    """Codes and indices of each day (``station_code``, ``obs_date``, ``temp``, ``rh``, ``ws``, ``precip``) from a stream of days.

    The state of a station is its three codes and its last day. Without ``late`` days count as they
    come, and a day at or before the last one comes too late and is left out. With ``late``
    (such as ``3 days``) days wait in the state until the watermark passes their end, so
    those that come out of order within it are put in order. Of several rows of a day the last counts.
    Missing values count as in the batch operator.
    """

    def carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ffmc, dmc, dc, last, waiting = state.get if state.exists else (*fwi.START.values(), -1, "{}")
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for days in batches:
            for row in days.itertuples(index=False):
                held[row.obs_date.toordinal()] = [None if pd.isna(getattr(row, c)) else float(getattr(row, c)) for c in MEASURES]
        ready = sorted(held)
        if late is not None:
            # A day is over when the watermark is at its end or beyond.
            over = EPOCH.toordinal() + state.getCurrentWatermarkMs() // 86_400_000
            ready = [d for d in ready if d < over]
        out = []
        for number in ready:
            values = held.pop(number)
            if number <= last:
                continue
            day = date.fromordinal(number)
            t, h, w, p = (DAY_DEFAULTS[c] if v is None else v for c, v in zip(MEASURES, values))
            ffmc, dmc, dc = (
                fwi.ffmc_step(t, h, w, p, ffmc, fwi.PLAIN), fwi.dmc_step(t, h, p, dmc, day.month, latitude, fwi.PLAIN), fwi.dc_step(t, p, dc, day.month, fwi.PLAIN),
            )
            last, spread, built = number, fwi.isi(ffmc, w, fwi.PLAIN), fwi.bui(dmc, dc, fwi.PLAIN)
            index = fwi.fwi(spread, built, fwi.PLAIN)
            out.append((key[0], day, ffmc, dmc, dc, spread, built, index, fwi.dsr(index)))
        state.update((ffmc, dmc, dc, last, json.dumps(held)))
        if late is not None and held:
            # Called again, with no new rows, once the first of the waiting days is over.
            state.setTimeoutTimestamp(max((min(held) + 1 - EPOCH.toordinal()) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CODES.split(", ")])

    rows = daily.select("station_code", "obs_date", *MEASURES)
    if late is not None:
        rows = rows.withColumn("_ts", F.col("obs_date").cast("timestamp")).withWatermark("_ts", late)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("station_code").applyInPandasWithState(carry, CODES, "ffmc double, dmc double, dc double, last long, waiting string", "append", timeout)
