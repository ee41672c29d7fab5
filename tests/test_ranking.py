"""The bucketed prefix-sum / exact-quantile plan against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainx.plans.ranking import exact_quantiles, prefix_sums


@pytest.mark.parametrize("buckets", [1, 23, None])
def test_exact_quantiles_match_numpy(spark, buckets):
    rng = np.random.default_rng(7)
    data = []
    for g in range(3):
        vals = np.round(rng.normal(50, 20, 400 + 100 * g), 1)          # many ties
        data += [(g, float(v)) for v in vals] + [(g, None)] * 5
    df = spark.createDataFrame(data, "g int, x double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in
           exact_quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.75, 1.0], buckets=buckets).collect()}
    for g in range(3):
        vals = np.array([v for gg, v in data if gg == g and v is not None])
        for p in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert got[(g, p)] == pytest.approx(float(np.quantile(vals, p)), rel=0, abs=1e-12)


def test_prefix_sums_bucketed_equals_running_sum(spark):
    rng = np.random.default_rng(3)
    xs = rng.choice(10_000, size=2_000, replace=False)
    w = rng.integers(1, 5, size=2_000)
    df = spark.createDataFrame([(int(x), int(v)) for x, v in zip(xs, w)], "x long, w long")
    out = {r["x"]: r["w_before"] for r in prefix_sums(df, [], "x", ["w"], buckets=21).collect()}
    order = np.argsort(xs)
    running = 0
    for i in order:
        assert out[int(xs[i])] == running
        running += int(w[i])


def test_prefix_sums_global_single_value(spark):
    df = spark.createDataFrame([(1.0, 3)], "x double, w long")
    assert prefix_sums(df, [], "x", ["w"]).first()["w_before"] == 0
    q = exact_quantiles(df.select(F.col("x")), [], "x", [0.5]).first()["quantile"]
    assert q == 1.0
