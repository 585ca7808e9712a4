"""Percentiles per group by radix selection.

Floating values are mapped to integers of the same order. A pass counts the values of each
group by their next digit of bits, and only the digit that holds a target rank is followed, so
after a few passes of small histograms the exact value is known, whatever the distribution. A
histogram of leading bits alone bounds the relative error, and histograms of separate subsets
add up, so results of partitions or days can be combined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small

#: Bits of a digit: a histogram of one pass has at most 65,536 entries a group and target.
DIGIT = 16
#: Leading bits of a mergeable histogram: sign, exponent and 15 bits of the fraction.
SKETCH_BITS = 27


@F.arrow_udf(T.LongType())
def ordered_bits(value: pa.Array) -> pa.Array:
    """Integers in the order of the values; null for null and NaN. The two zeros are one."""
    x = value.cast(pa.float64())
    raw = x.fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0
    bits = raw.view(np.int64)
    return pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)), mask=np.isnan(raw))


@F.arrow_udf(T.DoubleType())
def value_of_bits(bits: pa.Array) -> pa.Array:
    """The value of ``ordered_bits``."""
    key = bits.fill_null(0).to_numpy(zero_copy_only=False)
    raw = key ^ ((key >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return pa.array(raw.view(np.float64), mask=bits.is_null().to_numpy(zero_copy_only=False))


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _located(histogram: DataFrame, targets: DataFrame, groups: list[str]) -> DataFrame:
    """``targets`` moved on to the digit that holds their rank.

    ``histogram``: groups, ``_prefix``, ``_digit``, ``_count``; ``targets``: groups, ``_prefix``, ``q``, ``n``, ``_rank``.
    """
    order = Window.partitionBy(*groups, "_prefix").orderBy("_digit")
    upto = histogram.withColumn("_upto", F.sum("_count").over(order)).withColumnsRenamed({c: f"_h_{c}" for c in [*groups, "_prefix"]})
    joined = targets.join(upto, _same([*groups, "_prefix"], [f"_h_{c}" for c in [*groups, "_prefix"]]))
    held = joined.where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_count")))
    return held.select(*groups, "q", "n", F.col("_digit").alias("_prefix"), (F.col("_rank") - F.col("_upto") + F.col("_count")).alias("_rank"))


def _started(totals: DataFrame, groups: list[str], quantiles: list[float]) -> DataFrame:
    """A target for each group and quantile: the rank is the least that covers the share."""
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles lie between 0 and 1")
    each = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 9))).cast("long")
    return each.select(*groups, "q", "n", F.lit(0).cast("long").alias("_prefix"), rank.alias("_rank"))


def _followed(rows: DataFrame, targets: DataFrame, groups: list[str], done: int) -> DataFrame:
    """Rows whose prefix holds a target's rank."""
    if not done:
        return rows
    wanted = targets.select(*[F.col(g).alias(f"_w_{g}") for g in groups], F.col("_prefix").alias("_w_prefix")).distinct()
    return rows.join(broadcast_if_small(wanted), _same([*groups, "_prefix"], [*[f"_w_{g}" for g in groups], "_w_prefix"]), "left_semi")


def radix_percentiles(df: DataFrame, groups: list[str], value_col: str, quantiles: list[float], bits: int = 64) -> DataFrame:
    """Per group and quantile: ``q``, ``n`` (values counted), ``value`` and ``error_bound``.

    The value of quantile q is the least of the group's values that at least q * n values don't
    exceed. With 64 ``bits`` it is exact; with fewer (a multiple of 16) the middle of the last
    digit's interval is given, and ``error_bound`` is half its width.

    Nulls and NaN aren't values; infinities are. Null group columns form a group; a group without
    values, as an empty table, gives no rows; repeated rows count each time. Groups of any size
    are counted by partial aggregation before anything moves.
    """
    keyed = cut(df.select(*groups, ordered_bits(F.col(value_col).cast("double")).alias("_key")).where(F.col("_key").isNotNull()))
    targets = _started(cut(keyed.groupBy(*groups).agg(F.count("*").alias("n"))), groups, quantiles)
    for done in range(0, bits, DIGIT):
        shift = 64 - done - DIGIT
        rows = keyed.withColumns({"_digit": F.shiftright("_key", shift), "_prefix": F.shiftright("_key", shift + DIGIT) if done else F.lit(0).cast("long")})
        counts = _followed(rows, targets, groups, done).groupBy(*groups, "_prefix", "_digit").agg(F.count("*").alias("_count"))
        targets = cut(_located(counts, targets, groups))
    return _valued(targets, groups, bits)


def _valued(targets: DataFrame, groups: list[str], bits: int) -> DataFrame:
    rest = 64 - bits
    if rest == 0:
        return targets.select(*groups, "q", "n", value_of_bits("_prefix").alias("value"), F.lit(0.0).alias("error_bound"))
    low = F.shiftleft("_prefix", rest)
    ends = targets.select(*groups, "q", "n", value_of_bits(low).alias("_a"), value_of_bits(low + (2**rest - 1)).alias("_b"))
    return ends.select(*groups, "q", "n", ((F.col("_a") + F.col("_b")) / 2).alias("value"), ((F.col("_b") - F.col("_a")) / 2).alias("error_bound"))


def radix_histogram(df: DataFrame, groups: list[str], value_col: str, bits: int = SKETCH_BITS) -> DataFrame:
    """Groups, ``bucket`` (leading bits) and ``count``: the mergeable form.

    Its size a group is bounded by the spread of the values (at most 2 to the power of ``bits``),
    not by their number. Relative error of percentiles from it: 2 to the power of 11 - ``bits``.
    """
    keyed = df.select(*groups, ordered_bits(F.col(value_col).cast("double")).alias("_key")).where(F.col("_key").isNotNull())
    return keyed.groupBy(*groups, F.shiftright("_key", 64 - bits).alias("bucket")).agg(F.count("*").alias("count"))


def merge_histograms(histograms: DataFrame, groups: list[str]) -> DataFrame:
    """Histograms of separate subsets (rows of a union, or a coarser choice of ``groups``) as one."""
    return histograms.groupBy(*groups, "bucket").agg(F.sum("count").alias("count"))


def histogram_percentiles(histogram: DataFrame, groups: list[str], quantiles: list[float], bits: int = SKETCH_BITS) -> DataFrame:
    """As ``radix_percentiles``, from a merged histogram, with its bounded error.

    Buckets are followed digit by digit as values are, so no group's buckets come together.
    """
    kept = cut(histogram.select(*groups, "bucket", "count"))
    targets = _started(kept.groupBy(*groups).agg(F.sum("count").alias("n")), groups, quantiles)
    for done in range(0, bits, DIGIT):
        rest, before = max(bits - done - DIGIT, 0), bits - done
        rows = kept.withColumns({"_digit": F.shiftright("bucket", rest), "_prefix": F.shiftright("bucket", before) if done else F.lit(0).cast("long")})
        targets = cut(_located(_followed(rows, targets, groups, done).groupBy(*groups, "_prefix", "_digit").agg(F.sum("count").alias("_count")), targets, groups))
    return _valued(targets, groups, bits)
