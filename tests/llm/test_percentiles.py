import math
import random

import pytest

from fernbrand.llm import percentiles

NAN = float("nan")


def exact(values, q):
    return sorted(values)[max(1, math.ceil(round(q * len(values), 9))) - 1]


def test_percentiles(spark):
    rng = random.Random(2)
    data = {"a": [rng.lognormvariate(0, 4) * rng.choice([1, 1, -1]) for _ in range(700)] + [0.0, -0.0, float("inf"), -float("inf")], "b": [1.5] * 200 + [2.5], None: [3.0]}
    rows = [(g, v, k % 4) for g, vs in data.items() for k, v in enumerate(vs)] + [("a", None, 0), ("a", NAN, 0), ("none", None, 0)]
    df = spark.createDataFrame(rows, "g string, v double, q int")
    quantiles = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {(r["g"], r["q"]): r["value"] for r in percentiles.radix_percentiles(df.drop("q"), ["g"], "v", quantiles).collect()}
    assert got == {(g, q): exact(vs, q) for g, vs in data.items() for q in quantiles}
    parts = percentiles.radix_histogram(df.where("g = 'a' and abs(v) < 1e300").withColumnRenamed("q", "part"), ["g", "part"], "v")
    merged = percentiles.histogram_percentiles(percentiles.merge_histograms(parts, ["g"]), ["g"], [0.1, 0.5, 0.9]).collect()
    finite = [v for v in data["a"] if math.isfinite(v)]
    for r in merged:
        assert abs(r["value"] - exact(finite, r["q"])) <= r["error_bound"] + 1e-12 and r["error_bound"] <= abs(r["value"]) * 2**-15 + 1e-300
    assert percentiles.radix_percentiles(df.limit(0).drop("q"), ["g"], "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        percentiles.radix_percentiles(df.drop("q"), ["g"], "v", [2.0])
