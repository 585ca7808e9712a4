"""Written times in mixed forms, clocks and zones, brought to one UTC instant.

Every value is parsed under each interpretation that could have produced it. Where more than
one is left (the order of day and month in all-numeric dates), a mixture over the forms that a
source uses is fitted by expectation-maximisation, and the posterior chooses. Values whose
posterior stays undecided are marked, not guessed.

The fit runs on counts of (source, set of valid interpretations), which are few however many
rows there are; the parsing is one Arrow-batched expression without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernbrand.functions import instants
from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small

#: An order of day and month with less than this share of a source's numeric dates isn't used there.
MIN_SHARE = 0.01
#: An interpretation counts as decided from this posterior on.
MIN_POSTERIOR = 0.95

#: Names of the columns that are added in between.
_OWN = ("__time_source", "__time_share", "__time")

_NUMERIC = r"^ *\d{1,2}[/.]\d{1,2}[/.](?:\d{4}|\d{2})(?![0-9])"


def order_counts(df: DataFrame, date_col: str, source_col: str) -> DataFrame:
    """Rows per source and set of valid orders (``dmy``, ``mdy``) of its all-numeric dates."""
    tok = F.split(F.trim(F.col(date_col)), "[/.]")
    a, b = (F.get(tok, F.lit(i)).try_cast("int") for i in range(2))
    dates = df.where(F.col(date_col).rlike(_NUMERIC)).select(F.col(source_col).alias("source"), a.alias("a"), b.alias("b"))
    dmy, mdy = (F.col("b") <= 12) & (F.col("a") <= 31), (F.col("a") <= 12) & (F.col("b") <= 31)
    return (
        dates.where((F.col("a") != F.col("b")) & (dmy | mdy))
        .groupBy("source", dmy.alias("dmy"), mdy.alias("mdy")).count()
    )


def fit_mixture(valid: np.ndarray, counts: np.ndarray, steps: int = 500, tolerance: float = 1e-10) -> np.ndarray:
    """Shares of forms by expectation-maximisation. ``valid[i, f]``: form f explains kind i of value."""
    share = np.full(valid.shape[1], 1.0 / valid.shape[1])
    for _ in range(steps):
        joint = valid * share
        posterior = joint / np.maximum(joint.sum(1, keepdims=True), 1e-300)
        new = counts @ posterior / counts.sum()
        if np.abs(new - share).max() < tolerance:
            return new
        share = new
    return share


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    share = fit_mixture(pdf[["dmy", "mdy"]].to_numpy(float), pdf["count"].to_numpy(float))
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "share_dmy": [share[0]]})


def fit_orders(df: DataFrame, date_col: str, source_col: str) -> DataFrame:
    """``source``, ``share_dmy``: per source, the fitted share of day-before-month dates.

    At most three count rows a source enter the fit, so a source with a third of all rows costs
    no more than another. The result is written to the scratch folder.
    """
    kind = dict(df.dtypes)[source_col]
    return cut(order_counts(df, date_col, source_col).groupBy("source").applyInPandas(_fit_source, f"source {kind}, share_dmy double"))


@F.arrow_udf(T.StringType())
def _kind(date: pa.Array, hour: pa.Array) -> pa.Array:
    return pa.array(instants.kinds(instants.joined(date, hour)), pa.string())


def _fit_forms(pdf: pd.DataFrame) -> pd.DataFrame:
    plain = sorted(k for k in pdf["kind"] if k != instants.EITHER)
    forms = sorted({*plain, *((instants.DAY_FIRST, instants.MONTH_FIRST) if instants.EITHER in set(pdf["kind"]) else ())})
    valid = np.array([[f in ((instants.DAY_FIRST, instants.MONTH_FIRST) if k == instants.EITHER else (k,)) for f in forms] for k in pdf["kind"]], float)
    counts = pdf["count"].to_numpy(float)
    share = fit_mixture(valid, counts)
    return pd.DataFrame({"source": [pdf["source"].iloc[0]] * len(forms), "form": forms, "share": share, "n_values": share * counts.sum()})


def form_shares(df: DataFrame, date_col: str, hour_col: str | None, source_col: str) -> DataFrame:
    """``source``, ``form``, ``share``, ``n_values``: the mixture of all forms that a source writes its dates in.

    Every readable value contributes to each form that it can have (all-numeric ones to both
    orders, unless only one is possible), and expectation-maximisation weighs them; the shares of
    the two orders stand in the ratio that ``fit_orders`` finds. The fit runs on counts per source
    and kind of value.
    """
    kind = dict(df.dtypes)[source_col]
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    each = df.select(F.col(source_col).alias("source"), _kind(text(date_col), text(hour_col)).alias("kind"))
    counts = each.where(F.col("kind").isNotNull()).groupBy("source", "kind").count()
    return counts.groupBy("source").applyInPandas(_fit_forms, f"source {kind}, form string, share double, n_values double")


_TIME = T.StructType([T.StructField("second", T.LongType()), T.StructField("status", T.StringType()), T.StructField("posterior", T.DoubleType())])


@F.arrow_udf(_TIME)
def _resolved(date: pa.Array, hour: pa.Array, share: pa.Array, zone: pa.Array, clock: pa.Array) -> pa.Array:
    texts = instants.joined(date, hour)
    shares = share.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    second, status, posterior = instants.instants(texts, shares, zone, clock, MIN_SHARE, MIN_POSTERIOR)
    names = pa.DictionaryArray.from_arrays(pa.array(status, pa.int32()), pa.array(instants.STATUS)).cast(pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(second, pa.int64(), mask=status != instants.RESOLVED), names, pa.array(posterior)], ["second", "status", "posterior"]
    )


def resolve_times(
    df: DataFrame, date_col: str, hour_col: str | None, source_col: str, zone_col: str, clock_col: str | None = None
) -> DataFrame:
    """``df`` with ``utc_second`` (long), ``time_status`` and ``time_posterior``.

    A written zone, offset or epoch number decides. Else ``clock_col`` says what the source's
    clock shows: ``utc``, ``standard`` (the zone's standard time all year) or anything else for
    the wall clock of ``zone_col`` (an IANA name; other names count as missing).

    Status: ``resolved``; ``unreadable`` (null, empty, no known form, no such day or hour, no
    hour); ``too_long`` (longer than any form); ``other_order`` (readable only in an order of day and month
    that under ``MIN_SHARE`` of the source's dates have); ``undecided`` (both orders stay
    possible: posterior under ``MIN_POSTERIOR``); ``nonexistent`` and ``twice`` (wall-clock times
    skipped or repeated); ``no_zone``. ``utc_second`` is null unless resolved.
    ``time_posterior`` is that of the chosen order, 1 where the form has one order.

    Every row comes out once, of an empty table none; repeated rows get equal results; other
    columns pass through, and columns named like the three new ones are replaced.
    """
    df = df.drop("utc_second", "time_status", "time_posterior")
    orders = broadcast_if_small(fit_orders(df, date_col, source_col).select(F.col("source").alias(_OWN[0]), F.col("share_dmy").alias(_OWN[1])))
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    return (
        df.join(orders, F.col(source_col).eqNullSafe(F.col(_OWN[0])), "left")
        .withColumn(_OWN[2], _resolved(text(date_col), text(hour_col), _OWN[1], text(zone_col), text(clock_col)))
        .select(*df.columns, F.col(f"{_OWN[2]}.second").alias("utc_second"), F.col(f"{_OWN[2]}.status").alias("time_status"), F.col(f"{_OWN[2]}.posterior").alias("time_posterior"))
    )


def feed_clock(remarks: Column) -> Column:
    """What a feed's free text says of its clock: ``utc``, ``standard``, else ``wall``."""
    text = F.lower(F.coalesce(remarks, F.lit("")))
    return (
        F.when(text.rlike(r"\b(utc|gmt|zulu|greenwich|universal time)\b"), "utc")
        .when(text.rlike(r"\bstandard time\b"), "standard").otherwise("wall")
    )


def station_zones(station: DataFrame) -> DataFrame:
    """One row a station: ``station_code`` and its zone (the least if its rows differ)."""
    return station.where(F.col("station_code").isNotNull()).groupBy("station_code").agg(F.min("time_zone").alias("__station_zone"))


def weather_times(weather: DataFrame, feed: DataFrame, station: DataFrame) -> DataFrame:
    """``resolve_times`` over the written dates and hours of ``weather``, by feed."""
    clocks = feed.groupBy("feed_id").agg(F.min(feed_clock(F.col("remarks"))).alias("__feed_clock"))
    columns = [c for c in weather.columns if c not in ("utc_second", "time_status", "time_posterior")]
    joined = weather.join(broadcast_if_small(clocks), "feed_id", "left").join(broadcast_if_small(station_zones(station)), "station_code", "left")
    return resolve_times(joined, "obs_date", "obs_hour", "feed_id", "__station_zone", "__feed_clock").select(*columns, "utc_second", "time_status", "time_posterior")


def record_times(record: DataFrame, station: DataFrame) -> DataFrame:
    """``resolve_times`` over ``obs_datetime`` of ``weather_record``, by station."""
    columns = [c for c in record.columns if c not in ("utc_second", "time_status", "time_posterior")]
    joined = record.join(broadcast_if_small(station_zones(station)), "station_code", "left")
    return resolve_times(joined, "obs_datetime", None, "station_code", "__station_zone").select(*columns, "utc_second", "time_status", "time_posterior")
