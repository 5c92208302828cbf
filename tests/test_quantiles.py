"""Quantiles: exact ones against a plain sort, sketches within their rank error, also when rolled up."""

import bisect
import random

from pyspark.sql import functions as F

from vaultlake.operators.quantiles import exact_quantiles, quantile_sketches, rolled_up

SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def interpolated(values, share):
    at = share * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_exact_and_sketched(spark):
    r = random.Random(2)
    rows = [(f"c{min(i % 9, 3)}", i % 30, int(r.expovariate(0.001))) for i in range(40_000)] + [("c0", 1, None), ("one", 1, 7)]
    df = spark.createDataFrame(rows, "contract string, day int, lag long").repartition(5)
    by = {}
    for c, _, v in rows:
        if v is not None:
            by.setdefault(c, []).append(v)
    exact = {x["contract"]: x for x in exact_quantiles(df, ["contract"], "lag", SHARES).collect()}
    sketches = quantile_sketches(df, ["contract", "day"], "lag")
    rough = {x["contract"]: x for x in rolled_up(sketches, ["contract"], SHARES).collect()}
    assert set(exact) == set(rough) == set(by) and sketches.count() > 50
    for c, values in by.items():
        values.sort()
        assert exact[c]["rows"] == rough[c]["rows"] == len(values)
        for name, share in SHARES.items():
            assert abs(exact[c][name] - interpolated(values, share)) < 1e-5
            got = rough[c][name]
            low, high = bisect.bisect_left(values, got) / len(values), bisect.bisect_right(values, got) / len(values)
            assert low - 0.02 <= share <= high + 0.02, (c, name)


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, v long")
    assert exact_quantiles(none, ["k"], "v", SHARES).count() == 0
    assert rolled_up(quantile_sketches(none.withColumn("v", F.col("v")), ["k"], "v"), ["k"], SHARES).count() == 0
