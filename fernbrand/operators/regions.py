"""Points in regions: which region's outline holds each point.

Regions are laid over square cells by their bounding boxes, points by their coordinates, so an
equi-join on cells brings together what may belong to each other; the outline decides. A region
comes with its whole outline as arrays, which is as large as outlines are. Cells in which many
points lie are split by salting, the few regions there being repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fernbrand.sizing import broadcast_if_small

#: Parts a cell's points are split into.
SALTS = 16


@F.arrow_udf(T.BooleanType())
def inside(x: pa.Array, y: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
    """Whether a point is inside an outline: an odd number of edges cross the ray to its right."""
    px, py = (v.to_numpy(zero_copy_only=False) for v in (x, y))
    sizes = xs.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    fx, fy = (v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys))
    owner = np.repeat(np.arange(len(px)), sizes)
    ends = np.cumsum(sizes)
    after = np.arange(len(fx)) + 1
    after[ends[sizes > 0] - 1] = (ends - sizes)[sizes > 0]
    x0, y0, x1, y1, qx, qy = fx, fy, fx[after], fy[after], px[owner], py[owner]
    spans = (y0 > qy) != (y1 > qy)
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = spans & (qx < x0 + (qy - y0) / (y1 - y0) * (x1 - x0))
    return pa.array(np.bincount(owner, crosses, len(px)) % 2 == 1)


def outlines(vertices: DataFrame, region: str = "region_id") -> DataFrame:
    """``region``, ``xs``, ``ys`` of outlines given a row a vertex (``vertex_id``, ``x``, ``y``)."""
    ordered = F.sort_array(F.collect_list(F.struct("vertex_id", "x", "y")))
    return vertices.groupBy(region).agg(ordered.alias("_v")).select(region, F.col("_v.x").alias("xs"), F.col("_v.y").alias("ys"))


def points_in_regions(points: DataFrame, regions: DataFrame, cell: float, point: str = "point_id", region: str = "region_id") -> DataFrame:
    """``point``, ``region`` of every point (``x``, ``y``) in a region (``xs``, ``ys``: its outline in order); distinct.

    A point on an edge belongs to the region on one side of it only, so regions that share an
    edge share no point. Points without coordinates are in none; regions of fewer than three vertices
    hold none. ``cell``: side of the cells, best about that of a region.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    given = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < 1e300) & (F.abs("y") < 1e300)
    placed = points.where(given).select(F.col(point).alias("_p"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    placed = placed.withColumns({"_cx": F.floor(F.col("_x") / cell), "_cy": F.floor(F.col("_y") / cell), "_salt": F.pmod(F.xxhash64("_p"), F.lit(SALTS)).cast("int")})
    wide = regions.where(F.size("xs") >= 3).select(F.col(region).alias("_r"), "xs", "ys", *[f(c).alias(n) for n, f, c in (("_x0", F.array_min, "xs"), ("_x1", F.array_max, "xs"), ("_y0", F.array_min, "ys"), ("_y1", F.array_max, "ys"))])
    laid = wide.withColumn("_rx", F.explode(F.sequence(at("_x0"), at("_x1")))).withColumn("_ry", F.explode(F.sequence(at("_y0"), at("_y1"))))
    small = broadcast_if_small(laid, 20_000)
    if small is laid:
        # Too many for a broadcast: cells are split so that no one task takes a crowded cell.
        small = laid.withColumn("_rs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    match = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry")) & (F.col("_x").between(F.col("_x0"), F.col("_x1"))) & (F.col("_y").between(F.col("_y0"), F.col("_y1")))
    if "_rs" in small.columns:
        match = match & (F.col("_salt") == F.col("_rs"))
    found = placed.join(small, match).where(inside("_x", "_y", "xs", "ys"))
    return found.select(F.col("_p").alias(point), F.col("_r").alias(region)).distinct()


def owners(found: DataFrame, point: str = "point_id", region: str = "region_id") -> DataFrame:
    """One region a point: of several the least."""
    return found.groupBy(point).agg(F.min(region).alias(region))
