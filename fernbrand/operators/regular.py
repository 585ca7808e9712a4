"""Irregular readings brought onto a regular grid, gaps filled and marked.

Readings are bucketed by period, and each entity's series is cut into blocks of bounded length
that overlap a little; a block is the unit of work, so an entity with a third of all rows is
many tasks. Gaps are filled by iterative singular-spectrum imputation within the block and its
margins. Every filled period is marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernbrand.functions.ssa import impute_marked
from fernbrand.session import cut

#: Periods of a block, and the periods of its neighbours that it also sees.
BLOCK, MARGIN = 512, 48
#: Blocks that are imputed together.
TOGETHER = 64


def _filled(batches, names: list[str], values: list[str], block: int, margin: int, window: int, rank: int):
    width = block + 2 * margin
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        column = lambda n: batch.column(at[n])  # noqa: E731, B023
        number = lambda n: column(n).cast(pa.int64()).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        for first in range(0, batch.num_rows, TOGETHER):
            rows = np.arange(first, min(first + TOGETHER, batch.num_rows))
            start = number("_block")[rows] * block - margin
            grid = np.full((len(values), len(rows), width), np.nan)
            cells = column("_cells").slice(first, len(rows))
            flat = cells.flatten()
            owner = np.repeat(np.arange(len(rows)), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            place = flat.field("period").to_numpy(zero_copy_only=False) - start[owner] if len(flat) else np.array([], int)
            for i, v in enumerate(values):
                grid[i, owner, place] = flat.field(v).to_numpy(zero_copy_only=False)
            held = ~np.isnan(grid[0])
            low, high = np.clip(number("_first")[rows] - start, 0, width), np.clip(number("_last")[rows] - start + 1, 0, width)
            both = {"low": np.tile(low, len(values)), "high": np.tile(high, len(values))}
            full, settled = impute_marked(grid.reshape(-1, width), window, rank, **both)
            full, settled = full.reshape(grid.shape), settled.reshape(len(values), -1).all(0)
            period = start[:, None] + np.arange(width)
            inside = (period >= np.maximum(start + margin, number("_first")[rows])[:, None]) & (period <= np.minimum(start + margin + block - 1, number("_last")[rows])[:, None])
            r, c = np.nonzero(inside)
            out = [column(n).take(pa.array(rows[r])) for n in names] + [pa.array(period[r, c])]
            out += [pa.array(full[i][r, c], mask=np.isnan(full[i][r, c])) for i in range(len(values))] + [pa.array(~held[r, c]), pa.array(held[r, c] | settled[r])]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "period", *values, "is_filled", "is_settled"])


def regular_series(
    rows: DataFrame, keys: list[str], second_col: str, values: list[str], step: int = 3600, block: int = BLOCK, margin: int = MARGIN,
    window: int = 24, rank: int = 4,
) -> DataFrame:
    """A row for each key and period from its first to its last reading.

    A reading is a row with an instant and all ``values``; rows of one key with equal instants
    count once (greatest values). Columns: keys, ``period`` (number of ``step`` seconds since
    1970), the values (means of the period's readings, else imputed), ``is_filled`` and ``is_settled`` (false for
    values filled by an imputation that hadn't converged at its limit of steps). A filled
    value is null only if its block and margins hold no reading at all. Null keys form a key; an
    empty table, or one without readings, gives no rows.
    """
    second, period = F.col(second_col), F.floor(F.col(second_col) / step)
    given = second.isNotNull()
    for v in values:
        given = given & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    read = rows.where(given).select(*keys, second.alias("_second"), period.alias("period"), *[F.col(v).cast("double").alias(v) for v in values])
    own = F.floor(F.col("period") / block)
    within = F.pmod("period", F.lit(block))
    beside = F.when(within < margin, F.array(own - 1, own)).when(within >= block - margin, F.array(own, own + 1)).otherwise(F.array(own))
    spread = read.withColumn("_block", F.explode(beside)).repartition(*[F.col(k) for k in keys], F.col("_block"))
    once = spread.groupBy(*keys, "_block", "period", "_second").agg(*[F.max(v).alias(v) for v in values])
    mean = once.groupBy(*keys, "_block", "period").agg(*[F.avg(v).alias(v) for v in values])
    cells = mean.groupBy(*keys, "_block").agg(F.collect_list(F.struct("period", *values)).alias("_cells"), F.min("period").alias("_low"), F.max("period").alias("_high"))
    blocks = cut(cells)
    bounds = blocks.groupBy(*keys).agg(F.min("_low").alias("_first"), F.max("_high").alias("_last"))
    wanted = bounds.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor(F.col("_last") / block))))
    matched = [blocks[k].eqNullSafe(wanted[k]) for k in keys] + [blocks["_block"] == wanted["_block"]]
    condition = matched[0]
    for m in matched[1:]:
        condition = condition & m
    joined = wanted.join(blocks, condition, "left").select(*[wanted[k] for k in keys], wanted["_block"], "_first", "_last", "_cells")
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "period bigint", *[f"`{v}` double" for v in values], "is_filled boolean, is_settled boolean"])
    return joined.mapInArrow(lambda batches: _filled(batches, keys, values, block, margin, window, rank), schema)
