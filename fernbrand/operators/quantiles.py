"""Exact quantiles of whole columns in two passes, without a table of all values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the ranks around a wanted one that the second pass looks at, and the accuracy of the first.
NEAR, ACCURACY = 0.002, 10_000
#: Values up to which one pass takes the quantile as it is.
FEW = 200_000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """For each column the quantiles (linear between ranks) of its values; nulls and NaN aren't values.

    The first pass counts and gives bounds by approximate percentiles whose error is far below
    ``NEAR``; the second counts what lies below the bounds and looks at the values between them
    only. A column without values has nulls.
    """
    given = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    edges = {c: [min(max(q + d, 0.0), 1.0) for q in qs for d in (-NEAR, NEAR)] for c, qs in wanted.items()}
    first = df.agg(*[x for c, v in given.items() for x in (F.count(v).alias(f"n_{c}"), F.percentile_approx(v, edges[c], ACCURACY).alias(f"e_{c}"))]).first()
    parts = []
    for c, v in given.items():
        n = first[f"n_{c}"]
        for i, q in enumerate(wanted[c]):
            if n <= FEW:
                parts.append(F.percentile(v, F.lit(float(q))).alias(f"p_{c}_{i}"))
            else:
                low, high = first[f"e_{c}"][2 * i : 2 * i + 2]
                parts += [F.count_if(v < low).alias(f"b_{c}_{i}"), F.count_if((v >= low) & (v <= high)).alias(f"m_{c}_{i}")]
    second = df.agg(*parts).first() if parts else {}
    out, last = {c: [None] * len(qs) for c, qs in wanted.items()}, []
    for c, v in given.items():
        n = first[f"n_{c}"]
        for i, q in enumerate(wanted[c]):
            if n <= FEW:
                out[c][i] = second[f"p_{c}_{i}"]
            else:
                low, high = first[f"e_{c}"][2 * i : 2 * i + 2]
                rank, held = q * (n - 1) - second[f"b_{c}_{i}"], second[f"m_{c}_{i}"]
                last.append((c, i, F.percentile(F.when((v >= low) & (v <= high), v), F.lit(min(max(rank / max(held - 1, 1), 0.0), 1.0))).alias(f"p_{c}_{i}")))
    if last:
        third = df.agg(*[x for *_, x in last]).first()
        for c, i, _ in last:
            out[c][i] = third[f"p_{c}_{i}"]
    return out
