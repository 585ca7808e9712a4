"""Totals over trailing periods by binary doubling.

Per entity and day there is one row, days without activity included. Sums over 1, 2, 4, 8, ...
days are built by adding to each day's block the block of equal length that ends where it
begins; a window of any length is then put together from the blocks of its binary digits. A
window of n days takes about 2 log2(n) additions a day instead of n, and all of them share one
partitioning and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_grid(daily: DataFrame, keys: list[str], day_col: str, measures: list[str]) -> DataFrame:
    """A row for each key and day from its first to its last, measures 0 on added days.

    ``daily`` has one row a key and day (day numbers). Each row makes the empty days up to the
    next one, so no task holds a key's whole span at once.
    """
    order = Window.partitionBy(*keys).orderBy(day_col)
    until = F.coalesce(F.lead(day_col).over(order) - 1, F.col(day_col))
    spread = daily.withColumn("_until", until).withColumn("_day", F.explode(F.sequence(F.col(day_col), F.col("_until"))))
    real = F.col("_day") == F.col(day_col)
    return spread.select(*keys, F.col("_day").alias(day_col), real.alias("has_rows"), *[F.when(real, F.coalesce(F.col(m), F.lit(0))).otherwise(0).alias(m) for m in measures])


def trailing_sums(grid: DataFrame, keys: list[str], day_col: str, windows: dict[str, tuple[str, int]]) -> DataFrame:
    """``grid`` with sums over trailing days: ``windows`` maps a new name to (measure, days).

    The grid has a row for every day of a key (see ``daily_grid``), with no null measures. Days
    before a key's first count as 0. Lengths under 1 are refused.
    """
    if any(n < 1 for _, n in windows.values()):
        raise ValueError("a window has at least one day")
    order = Window.partitionBy(*keys).orderBy(day_col)
    shifted = lambda c, by: F.coalesce(F.lag(c, by).over(order), F.lit(0))
    block = lambda m, size: F.col(m if size == 1 else f"_{m}_{size}")
    out, longest = grid, max((n for _, n in windows.values()), default=1)
    size = 1
    while size * 2 <= longest:
        wanted = sorted({m for m, n in windows.values() if n >= size * 2})
        out = out.withColumns({f"_{m}_{size * 2}": block(m, size) + shifted(block(m, size), size) for m in wanted})
        size *= 2
    sums: dict[str, Column] = {}
    for name, (measure, days) in windows.items():
        total, behind = None, 0
        for bit in (1 << k for k in range(days.bit_length()) if days >> k & 1):
            piece = block(measure, bit) if behind == 0 else shifted(block(measure, bit), behind)
            total, behind = piece if total is None else total + piece, behind + bit
        sums[name] = total
    return out.withColumns(sums).select(*grid.columns, *sums)


def trailing_totals(rows: DataFrame, keys: list[str], second_col: str, measures: list[str], periods: list[int]) -> DataFrame:
    """Totals, counts and means over trailing periods, per key and UTC day.

    ``rows`` are single readings with ``second_col`` (UTC seconds). Rows of one key with the same
    instant count once (of each measure the greatest value given); rows without an instant not at
    all; null measures add nothing. Columns: keys, ``day`` (days since 1970), ``has_rows``,
    ``first_day`` of the key, and per measure and period ``<m>_sum_<n>``, ``<m>_count_<n>``,
    ``<m>_mean_<n>`` (null if nothing was given). Null keys form a key; an empty table gives none.

    Rows are first reduced per key and instant, which spreads a key with many rows over all
    tasks, then per key and day; only the days reach the windows.
    """
    once = rows.where(F.col(second_col).isNotNull()).groupBy(*keys, second_col).agg(*[F.max(m).alias(m) for m in measures])
    day = F.floor(F.col(second_col) / 86400).cast("int")
    given = [x for m in measures for x in (F.sum(m).alias(m), F.count(m).cast("long").alias(f"{m}_n"))]
    daily = once.groupBy(*keys, day.alias("day")).agg(*given)
    columns = [x for m in measures for x in (m, f"{m}_n")]
    grid = daily_grid(daily, keys, "day", columns)
    grid = grid.withColumn("first_day", F.min("day").over(Window.partitionBy(*keys).orderBy("day")))
    windows = {f"{m}_{what}_{n}": (m if what == "sum" else f"{m}_n", n) for m in measures for n in periods for what in ("sum", "count")}
    out = trailing_sums(grid, keys, "day", windows)
    means = {f"{m}_mean_{n}": F.when(F.col(f"{m}_count_{n}") > 0, F.col(f"{m}_sum_{n}") / F.col(f"{m}_count_{n}")) for m in measures for n in periods}
    return out.withColumns(means).drop(*columns)
