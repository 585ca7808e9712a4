"""Where fires start: probabilities, rules and draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fernbrand.functions.chance import uniform
from fernbrand.session import cut
from fernbrand.sizing import broadcast_if_small

#: Rows of a grid whose totals the driver holds; rows beyond are counted in bands of this many.
MOST_ROWS = 1_000_000
#: Draws an iteration makes at first for each fire, and how often more are made where they fall on the same cells.
DRAWS, ROUNDS = 8, 20


def adjusted(cells: DataFrame, rates: DataFrame, probability: str = "p") -> DataFrame:
    """Probabilities times escaped over all fires of the cell's ecoregion (``eco_id``, ``e_rate``, ``f_rate``).

    Missing rates count as 1, as does ``f_rate`` 0; cells without an ecoregion and negative results get 0.
    """
    side = rates.select(F.col("eco_id").alias("_eco"), "e_rate", "f_rate")
    joined = cells.join(broadcast_if_small(side), F.col("eco_id") == F.col("_eco"), "left")
    over = F.when(F.coalesce("f_rate", F.lit(1.0)) == 0, 1.0).otherwise(F.coalesce("f_rate", F.lit(1.0)))
    p = F.col(probability) * F.coalesce("e_rate", F.lit(1.0)) / over
    return joined.withColumn(probability, F.when(F.col("eco_id").isNull() | p.isNull() | (p < 0), 0.0).otherwise(p)).drop("_eco", "e_rate", "f_rate")


def fuel_codes(names: list[str], lookup: dict[int, str], strict: bool = False) -> list[int]:
    """Codes of fuel names: all codes of each, whatever its case; ``strict``: the last code of each
    whose name is written in capitals."""
    if strict:
        last = {name: code for code, name in lookup.items()}
        return [last[n.strip().upper()] for n in names if n.strip().upper() in last]
    wanted = {n.strip().upper() for n in names}
    return sorted(code for code, name in lookup.items() if name.strip().upper() in wanted)


def ruled(cells: DataFrame, rules: DataFrame, probability: str = "p") -> DataFrame:
    """Probability 0 in cells whose fuel a rule (``fuel_id``, ``cause``, ``season``; null or any: all) forbids."""
    season = F.coalesce(F.lower("season"), F.lit("any"))
    by_fuel = rules.groupBy(F.col("fuel_id").alias("_fuel"), F.lower("cause").alias("_cause")).agg(F.collect_set(season).alias("_seasons"))
    joined = cells.join(broadcast_if_small(by_fuel), (F.col("fuel_id") == F.col("_fuel")) & (F.lower("cause") == F.col("_cause")), "left")
    hit = F.array_contains("_seasons", "any") | F.coalesce(F.array_contains("_seasons", F.lower("season")), F.lit(False))
    return joined.withColumn(probability, F.when(F.col("_seasons").isNotNull() & hit, 0.0).otherwise(F.col(probability))).drop("_fuel", "_cause", "_seasons")


def normalised(cells: DataFrame, groups: list[str], probability: str = "p") -> DataFrame:
    """Probabilities that sum to 1 in each group; missing and negative ones are 0, and all are 0 if none is over 0."""
    p = F.when(F.isnan(probability) | F.col(probability).isNull() | (F.col(probability) < 0), 0.0).otherwise(F.col(probability))
    clean = cells.withColumn(probability, p)
    totals = clean.groupBy(*groups).agg(F.sum(probability).alias("_total")) if groups else clean.agg(F.sum(probability).alias("_total"))
    joined = clean.join(broadcast_if_small(totals), groups) if groups else clean.crossJoin(F.broadcast(totals))
    return joined.withColumn(probability, F.when(F.col("_total") > 0, F.col(probability) / F.col("_total")).otherwise(0.0)).select(*cells.columns)


def fires_per_iteration(iterations: int, shares: dict[int, float], spark, seed: int = 0) -> DataFrame:
    """``iteration``, ``n_fires`` drawn from the given shares."""
    total, upto, n = sum(shares.values()), 0.0, F.lit(max(shares))
    cuts = []
    for count, share in sorted(shares.items()):
        upto += share / total
        cuts.append((count, upto))
    for count, edge in reversed(cuts):
        n = F.when(F.col("_u") < edge, F.lit(count)).otherwise(n)
    drawn = spark.range(iterations).select(F.col("id").cast("int").alias("iteration"), uniform(seed, F.lit("n"), F.col("id")).alias("_u"))
    return drawn.select("iteration", n.alias("n_fires"))


def sample_ignitions(cells: DataFrame, draws: DataFrame, probability: str = "p", seed: int = 0) -> DataFrame:
    """Per iteration ``n_fires`` different cells (all that have a weight, if fewer), drawn with their weights.

    Draws are points on the line of all weights, in the order of rows and columns; a draw that
    falls on a cell that its iteration has already doesn't count, which is drawing without
    replacement. Only totals of grid rows and the draws pass the driver; a draw meets the cells of
    its row only, so the work is the cells' plus the draws', not their product. Iterations whose
    draws hit too few cells draw again.
    """
    spark = cells.sparkSession
    kept = cut(cells.where((F.col(probability) > 0) & ~F.isnan(probability)).select("grid_row", "grid_col", "x", "y", F.col(probability).alias("_p")))
    out = "iteration int, fire_no int, grid_row int, grid_col int, x double, y double"
    count = kept.agg(F.count("*").alias("n"), F.countDistinct("grid_row").alias("rows")).first()
    if not count["n"]:
        return spark.createDataFrame([], out)
    band = -(-count["rows"] // MOST_ROWS)
    keyed = kept.withColumn("_band", F.floor(F.col("grid_row") / band))
    totals = keyed.groupBy("_band").agg(F.sum("_p").alias("s")).orderBy("_band").collect()
    ends = np.cumsum([r["s"] for r in totals])
    upto = F.sum("_p").over(Window.partitionBy("_band").orderBy("grid_row", "grid_col"))
    placed = cut(keyed.withColumns({"_upto": upto}))
    wanted, found, begin = cut(draws.where("n_fires > 0")), None, 0
    for r in range(ROUNDS):
        each = DRAWS << r
        numbers = wanted.select("iteration", "n_fires", F.explode(F.sequence(F.lit(begin), F.col("n_fires") * each + begin - 1)).alias("_j"))
        points = numbers.withColumn("_at", uniform(seed, F.lit("at"), F.col("iteration"), F.col("_j")) * float(ends[-1]))
        edges = F.array(*[F.lit(float(e)) for e in ends]) if len(ends) <= 64 else None
        if edges is not None:
            index = F.least(F.size(F.filter(edges, lambda e: e <= F.col("_at"))), F.lit(len(ends) - 1))
            band_of = F.element_at(F.array(*[F.lit(t["_band"]) for t in totals]), index + 1)
            residual = F.col("_at") - F.element_at(F.array(*[F.lit(float(b)) for b in [0.0, *ends[:-1]]]), index + 1)
            located = points.withColumns({"_b": band_of, "_rest": residual})
        else:
            # Many rows: a range of the line falls on few of them, so both sides are cut into equal parts of the line.
            part = float(ends[-1]) / len(ends)
            lines = spark.createDataFrame([(int(t["_band"]), float(b), float(e)) for t, b, e in zip(totals, [0.0, *ends[:-1]], ends)], "_b long, _from double, _to double")
            lines = lines.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_from") / part), F.floor(F.col("_to") / part))))
            located = points.withColumn("_part", F.floor(F.col("_at") / part)).join(lines, "_part").where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))).withColumn("_rest", F.col("_at") - F.col("_from"))
        hits = placed.join(broadcast_if_small(located.select("iteration", "n_fires", "_j", "_b", "_rest")), F.col("_band") == F.col("_b"))
        hits = hits.where((F.col("_rest") >= F.col("_upto") - F.col("_p")) & (F.col("_rest") < F.col("_upto"))).select("iteration", "n_fires", "_j", "grid_row", "grid_col", "x", "y")
        found = hits if found is None else found.unionByName(hits)
        first = found.groupBy("iteration", "n_fires", "grid_row", "grid_col").agg(F.min("_j").alias("_j"), F.first("x").alias("x"), F.first("y").alias("y"))
        found = cut(first)
        begin += int((draws.agg(F.max("n_fires")).first()[0] or 0)) * each
        have = found.groupBy("iteration").agg(F.count("*").alias("_have"))
        wanted = cut(wanted.join(have, "iteration", "left").where(F.coalesce("_have", F.lit(0)) < F.least("n_fires", F.lit(count["n"]))).drop("_have"))
        if not wanted.limit(1).count():
            break
    order = Window.partitionBy("iteration").orderBy("_j")
    return found.withColumn("fire_no", F.row_number().over(order)).where(F.col("fire_no") <= F.col("n_fires")).select("iteration", "fire_no", "grid_row", "grid_col", "x", "y")


def monte_carlo(
    cells: DataFrame, iterations: int, shares: dict[int, float], cause: str, season: str, rules: DataFrame | None = None, rates: DataFrame | None = None, seed: int = 0, probability: str = "p"
) -> DataFrame:
    """Ignitions of all iterations: ``fire_id``, ``iteration``, ``x``, ``y``, ``cause``, ``season``.

    ``cells``: grid of probabilities with ``fuel_id`` and, for ``rates``, ``eco_id``. Rates, then rules, then
    scaling, then draws; a grid without a positive probability gives no ignitions.
    """
    ready = cells.withColumns({"cause": F.lit(cause), "season": F.lit(season)})
    ready = adjusted(ready, rates, probability) if rates is not None else ready
    ready = normalised(ruled(ready, rules, probability) if rules is not None else ready, [], probability)
    points = sample_ignitions(ready, fires_per_iteration(iterations, shares, cells.sparkSession, seed), probability, seed)
    most = max(shares)
    return points.select(
        (F.col("iteration").cast("long") * most + F.col("fire_no") - 1).alias("fire_id"), "iteration", "x", "y", F.lit(cause).alias("cause"), F.lit(season).alias("season")
    )
