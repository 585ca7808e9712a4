"""Quantities recorded in different units, brought to common ones.

A unit in the value's own text counts first, then the row's note, then the remarks on its
source. For values that none of them covers, a mixture on the log scale is fitted per source
and quantity: its components are one shape, that of the values whose unit is known, moved by
the known conversion factors, and expectation-maximisation finds their weights. The posterior
of a value's unit is reported, and whether it is uncertain.

The fit runs on histograms, whose size depends on sources and bins and not on rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernbrand.functions.units import COMMON, CONVERSIONS, MILLI, READERS
from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small

#: Bins of the histograms per unit of the natural logarithm.
BINS = 20
#: A unit whose posterior is less than this is uncertain.
MIN_POSTERIOR = 0.9
#: Scale on which a quantity is compared: shifted so that its logarithm exists.
SHIFT = {"temperature": 100.0, "wind_speed": 0.0, "precipitation": 0.0}


def _log_bin(common: Column, field: str) -> Column:
    moved = common + SHIFT[field]
    return F.when(moved > 0, F.round(F.log(moved) * BINS).cast("int"))


def _with_remarks(df: DataFrame, source_col: str, remarks: DataFrame | None) -> DataFrame:
    """``df`` with ``_remarks``: the free text on the row's source (the least if there are several)."""
    if remarks is None:
        return df.withColumn("__unit_remarks", F.lit(None).cast("string"))
    key, text = remarks.columns
    texts = remarks.groupBy(F.col(key).alias("__unit_source")).agg(F.min(text).alias("__unit_remarks"))
    return df.join(broadcast_if_small(texts), F.col(source_col).eqNullSafe(F.col("__unit_source")), "left").drop("__unit_source")


def long_values(df: DataFrame, keys: list[str], fields: list[str], source_col: str, note_col: str | None, remarks: DataFrame | None) -> DataFrame:
    """A row for each row and readable field: keys, ``source``, ``field_name``, ``number``, ``unit``,
    ``unit_from``, ``common``.

    ``remarks``: source and free text; its first column is matched with ``source_col``.
    ``unit`` is null where none of value, note and remarks gives one (``unit_from`` is ``none``),
    or the value has one that isn't known (``value``).
    """
    note = F.col(note_col) if note_col else F.lit(None).cast("string")
    read = _with_remarks(df, source_col, remarks).select(
        *keys, F.col(source_col).alias("source"), *[READERS[f](F.col(f).cast("string"), note, F.col("__unit_remarks")).alias(f"__unit_{f}") for f in fields]
    )
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"__unit_{f}").alias("v")) for f in fields])
    rows = read.select(*keys, "source", F.explode(entries).alias("e")).where(F.col("e.v.number").isNotNull())
    return rows.select(*keys, "source", "e.field_name", "e.v.number", "e.v.unit", "e.v.unit_from", "e.v.common")


def _by_field(field: Column, make: dict[str, Column]) -> Column:
    (name, value), *rest = make.items()
    out = F.when(field == name, value)
    for name, value in rest:
        out = out.when(field == name, value)
    return out


def histogram(values: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of values per source, field, unit (null: missing) and bin of the logarithm.

    Known values are binned in their common unit, others as written. Zeros, which look the same
    in any unit of scale, have no bin.
    """
    known, field = F.col("unit").isNotNull(), F.col("field_name")
    seen = values.where(known | (F.col("unit_from") == "none"))
    binned = _by_field(field, {f: _log_bin(F.col("common"), f) for f in fields})
    seen = seen.withColumn("bin", F.when(known, binned).otherwise(_missing_bin()))
    return seen.where(F.col("bin").isNotNull()).groupBy("source", "field_name", known.alias("known"), "bin").count()


def _missing_bin() -> Column:
    """The bin of a value without a unit: whole degrees of temperature, else of the logarithm."""
    return F.when(F.col("field_name") == "temperature", F.round("number").cast("int")).when(F.col("number") > 0, F.round(F.log("number") * BINS).cast("int"))


def written_from_bin(bins: np.ndarray, field: str) -> np.ndarray:
    return bins.astype(float) if field == "temperature" else np.exp(bins / BINS)


def log_density(written: np.ndarray, field: str, mean: float, spread: float) -> np.ndarray:
    """Log density on the common log scale of values as written, for each unit of the field (columns)."""
    columns = []
    for factor, shift in CONVERSIONS[field].values():
        moved = written * factor + shift + SHIFT[field]
        at = np.log(np.maximum(moved, 1e-9))
        jacobian = np.log(np.maximum(written * factor, 1e-9) / np.maximum(moved, 1e-9)) if field == "temperature" else 0.0
        columns.append(np.where(moved > 0, -0.5 * ((at - mean) / spread) ** 2 + (jacobian if np.ndim(jacobian) else 0.0), -1e3))
    return np.stack(columns, 1)


def fit_weights(written: np.ndarray, counts: np.ndarray, field: str, mean: float, spread: float, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the units by expectation-maximisation, and the posteriors of each bin."""
    density = log_density(written, field, mean, spread)
    density = np.exp(density - density.max(1, keepdims=True))
    weight = np.full(density.shape[1], 1 / density.shape[1])
    posterior = density * weight
    for _ in range(steps):
        posterior = density * weight
        posterior /= posterior.sum(1, keepdims=True)
        new = (counts @ posterior + 0.5) / (counts.sum() + 0.5 * len(weight))
        if np.abs(new - weight).max() < 1e-7:
            break
        weight = new
    return weight, posterior


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    field = pdf["field_name"].iloc[0]
    known, units = pdf[pdf["known"]], list(CONVERSIONS[field])
    out = []
    if known["count"].sum() >= 2:
        at, n = known["bin"].to_numpy(float) / BINS, known["count"].to_numpy(float)
        mean = (at * n).sum() / n.sum()
        spread = max(np.sqrt(((at - mean) ** 2 * n).sum() / n.sum()), 1 / BINS)
        for source, part in pdf[~pdf["known"]].groupby("source", dropna=False):
            _, posterior = fit_weights(written_from_bin(part["bin"].to_numpy(), field), part["count"].to_numpy(float), field, mean, spread)
            best = posterior.argmax(1)
            out.append(pd.DataFrame({
                "source": source, "field_name": field, "bin": part["bin"].to_numpy(), "likely_unit": [units[i] for i in best],
                "unit_posterior": posterior.max(1), "common_posterior": posterior[:, units.index(COMMON[field])],
            }))
    columns = ["source", "field_name", "bin", "likely_unit", "unit_posterior", "common_posterior"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def fit_units(values: DataFrame, fields: list[str]) -> DataFrame:
    """Per source, field and bin of a value without a unit: likely unit and posteriors.

    Known values of all sources are first merged to one histogram a field, so a group of the fit
    holds at most (sources + 1) times the bins of one field. Written to the scratch folder.
    """
    kind = dict(values.dtypes)["source"]
    counts = histogram(values, fields)
    merged = counts.withColumn("source", F.when(~F.col("known"), F.col("source"))).groupBy("source", "field_name", "known", "bin").agg(F.sum("count").alias("count"))
    schema = f"source {kind}, field_name string, bin int, likely_unit string, unit_posterior double, common_posterior double"
    return cut(merged.groupBy("field_name").applyInPandas(_fit, schema))


def convert_units(
    df: DataFrame, keys: list[str], fields: list[str], source_col: str, note_col: str | None = None, remarks: DataFrame | None = None,
    missing: str = "common",
) -> DataFrame:
    """A row for each readable value: keys, ``field_name``, ``number`` as written, ``unit``,
    ``unit_from`` (value, note, remarks, none), ``common_value``, ``unit_posterior``, ``unit_uncertain``.

    ``missing``: for values without a unit anywhere, ``common`` takes the common unit, as the
    project's data require, and ``unit_posterior`` is that unit's; ``posterior`` takes the
    likeliest unit. Either way ``unit_uncertain`` marks posteriors under ``MIN_POSTERIOR``. Known
    units have posterior 1. A value whose own unit isn't known has a null ``common_value`` and is
    uncertain. Nulls, empty texts and texts without a leading number give no row; ties of the
    posterior take the unit listed first; repeated rows give repeated results.
    """
    values = long_values(df, keys, fields, source_col, note_col, remarks)
    fitted = broadcast_if_small(fit_units(values, fields).withColumnsRenamed({"source": "_s", "field_name": "_f", "bin": "_b"}))
    none = F.col("unit_from") == "none"
    bins = F.when(none, _missing_bin())
    joined = values.withColumn("_bin", bins).join(
        fitted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("field_name") == F.col("_f")) & (F.col("_bin") == F.col("_b")), "left"
    )
    default = _by_field(F.col("field_name"), {f: F.lit(COMMON[f]) for f in fields})
    chosen = default if missing == "common" else F.coalesce("likely_unit", default)
    posterior = F.col("common_posterior") if missing == "common" else F.col("unit_posterior")
    joined = joined.withColumn("unit", F.when(none, chosen).otherwise(F.col("unit"))).withColumn("unit_posterior", F.when(none, posterior).when(F.col("unit").isNotNull(), 1.0))
    assumed = [
        (F.col("field_name") == f) & (F.col("unit") == u) for f in fields for u in CONVERSIONS[f]
    ], [F.col("number") * factor + shift for f in fields for factor, shift in CONVERSIONS[f].values()]
    guessed = F.lit(None).cast("double")
    for is_unit, value in zip(*assumed):
        guessed = F.when(is_unit, value).otherwise(guessed)
    common = F.when(~none, F.col("common")).otherwise(F.col("number") if missing == "common" else guessed)
    return joined.select(
        *keys, "field_name", "number", "unit", "unit_from", common.alias("common_value"), "unit_posterior",
        (F.coalesce("unit_posterior", F.lit(0.0)) < MIN_POSTERIOR).alias("unit_uncertain"),
    )


def with_milli(df: DataFrame, fields: list[str], source_col: str, note_col: str, remarks: DataFrame) -> DataFrame:
    """``df`` with ``<field>_milli``: thousandths of the common unit, which counts where no unit is
    given; null where the value isn't readable or its unit isn't known."""
    read = {f"{f}_milli": MILLI[f](F.col(f).cast("string"), F.col(note_col), F.col("__unit_remarks")) for f in fields}
    return _with_remarks(df, source_col, remarks).withColumns(read).drop("__unit_remarks")
