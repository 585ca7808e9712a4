"""Pairs of points at most a distance apart.

Latitude is cut into ranges of about equal numbers of points, each overlapping the next by the
distance, and each range into cells of longitude that overlap likewise. Within a cell points
are sorted by longitude, and a sweep keeps the points still in reach active, so only points
whose longitudes are close are ever compared. Distances are then verified. A pair is emitted
only in the cell of its lesser range and lesser cell, so each has one owner.

The sweep reads a sorted stream; a partition never has to be held as a whole, however many
points a cell has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernbrand.session import cut

#: Points that a range of latitude should hold, and the most ranges.
RANGE_POINTS, MOST_RANGES = 50_000, 4_000
#: Width of a cell of longitude in distances.
CELL = 32


def _ranges(points: DataFrame, distance: float) -> list[float]:
    """Lower bounds of the ranges of y (without the first), at least a distance apart.

    Approximate quantiles, merged from partitions; at most ``MOST_RANGES`` numbers reach the driver.
    """
    n = points.count()
    parts = min(MOST_RANGES, max(1, n // RANGE_POINTS))
    bounds: list[float] = []
    if parts > 1:
        for b in points.approxQuantile("_y", [k / parts for k in range(1, parts)], 0.2 / parts):
            if not bounds or b - bounds[-1] >= 2 * distance:
                bounds.append(b)
    return bounds


def _sweep(batches, distance: float, kind: pa.DataType):
    """Pairs of a stream sorted by range, cell and x. Only points in reach of the last are kept."""
    names = ["_r", "_c", "_x", "_y", "_home_r", "_home_c", "_id"]
    kept: dict[str, np.ndarray] | None = None
    reach = distance * distance
    for batch in batches:
        new = {n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names}
        if not len(new["_x"]):
            continue
        old = 0 if kept is None else len(kept["_x"])
        p = new if kept is None else {n: np.concatenate([kept[n], new[n]]) for n in names}
        x, y, r, c, size = p["_x"], p["_y"], p["_r"], p["_c"], len(p["_x"])
        active, step = np.arange(size), 0
        while len(active):
            step += 1
            active = active[active + step < size]
            other = active + step
            near = (r[active] == r[other]) & (c[active] == c[other]) & (x[other] - x[active] <= distance)
            active, other = active[near], other[near]
            done = other >= old
            a, b = active[done], other[done]
            pair = ((x[b] - x[a]) ** 2 + (y[b] - y[a]) ** 2 <= reach) & (np.minimum(p["_home_r"][a], p["_home_r"][b]) == r[a])
            pair &= (np.minimum(p["_home_c"][a], p["_home_c"][b]) == c[a]) & (p["_id"][a] != p["_id"][b])
            a, b = p["_id"][a[pair]], p["_id"][b[pair]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind)], names=["id_a", "id_b"])
        last = np.flatnonzero((r == r[-1]) & (c == c[-1]) & (x >= x[-1] - distance))
        kept = {n: p[n][last] for n in names}


def near_pairs(df: DataFrame, id_col: str, x_col: str, y_col: str, distance: float, decimals: int | None = None) -> DataFrame:
    """``id_a`` < ``id_b`` (long) of all pairs of different ids at most ``distance`` apart.

    Plane coordinates. ``decimals``: digits after the point that the coordinates have; they are
    then compared as whole numbers, so that a pair exactly at the distance is found. Rows with a
    null id, or a null, NaN or infinite coordinate are in no pair. Repeated rows count once; an
    id at several places pairs by any of them, and comes out once a pair. Points at one place
    are all paired. A negative distance gives no rows, as does an empty table.
    """
    unit = 10**decimals if decimals is not None else 1
    scaled = lambda c: F.round(F.col(c) * unit).cast("double") if decimals is not None else F.col(c).cast("double")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    points = (
        df.select(F.col(id_col).cast("long").alias("_id"), scaled(x_col).alias("_x"), scaled(y_col).alias("_y"))
        .where(F.col("_id").isNotNull() & finite("_x") & finite("_y")).distinct()
    )
    reach = float(distance * unit)
    if reach < 0:
        return points.limit(0).select(F.col("_id").alias("id_a"), F.col("_id").alias("id_b"))
    points = cut(points)
    width = max(reach, 1e-9) * CELL
    bounds = _ranges(points, reach)
    home = points.withColumns({"_home_r": _range_of(bounds)("_y") if bounds else F.lit(0), "_home_c": F.floor(F.col("_x") / width)})
    below = F.lit(False) if not bounds else _range_of([b + reach for b in bounds], "left")("_y") < F.col("_home_r")
    left = F.col("_x") <= F.col("_home_c") * width + reach
    spread = home.withColumn("_r", F.explode(F.when(below, F.array(F.col("_home_r"), F.col("_home_r") - 1)).otherwise(F.array("_home_r"))))
    spread = spread.withColumn("_c", F.explode(F.when(left, F.array(F.col("_home_c"), F.col("_home_c") - 1)).otherwise(F.array("_home_c"))))
    swept = (
        spread.repartition("_r", "_c").sortWithinPartitions("_r", "_c", "_x")
        .mapInArrow(lambda batches: _sweep(batches, reach, pa.int64()), "id_a bigint, id_b bigint")
    )
    return swept.distinct() if _several_places(points) else swept


def _several_places(points: DataFrame) -> bool:
    """Whether any id stands at more than one place; only then can a pair come out twice."""
    return bool(points.groupBy("_id").count().where("count > 1").limit(1).count())


def _range_of(bounds: list[float], side: str = "right"):
    """An expression for the number of ``bounds`` at or below a value (``left``: below it)."""
    sorted_bounds = np.array(bounds)

    @F.arrow_udf(T.IntegerType())
    def place(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(sorted_bounds, values.to_numpy(zero_copy_only=False), side), pa.int32())

    return place
