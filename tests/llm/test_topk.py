import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaultlake.llm.topk import Slices, digits, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every=5):
    long = lambda n: max(-(2**63), min(2**63 - 1, n))
    whole = [(i, [long(math.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(whole):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for n, (j, v) in enumerate(whole) if n != at)[:k]
            out += [(i, n + 1, j, long(-s)) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as score", "'x' as block", "2 as v")
    return sorted(tuple(x) for x in top_k(df, F.col("vec_id") % 5 == 0, k, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block_rows": 70, "block_queries": 9}])
def test_equals_brute_force(spark, options):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 0.2, 12)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(80)]  # many equal vectors, ties at the boundary
    rows += [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (None, [1.0] * 12),
             (405, [0.5, -0.5]), (410, [-1.0] * 12), (415, [0.0] * 12), (420, [1e30, -1e30] + [0.0] * 10)]
    assert run(spark, rows, 20, **options) == brute(rows, 20)


def test_large_scores_and_repeated_ids(spark):
    rows = [(20, [400_000.0, 0.0]), (21, [300_000.0, 1.0]), (22, [350_000.0, 1.0]), (25, [-400_000.0, 2.0**29]), (30, [3.0, -(2.0**41)]), (31, [0.0, 4e5])]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert (20, 1, 22, 573440000000000) in run(spark, rows, 3)
    rows = [(5, [1.0]), (5, [1.0]), (5, [2.0]), (10, [3.0]), (10, [3.0]), (6, []), (6, [0.5])]
    assert run(spark, rows, 4) == brute(rows, 4)
    assert run(spark, rows, 2, block_rows=2, block_queries=1) == brute(rows, 2)


def test_few_rows(spark):
    assert run(spark, [], 5) == [] and run(spark, [(5, [1.0])], 5) == []
    rows = [(5, [1.0]), (6, [2.0]), (7, [2.0])]
    assert run(spark, rows, 5) == [(5, 1, 6, 64 * 128), (5, 2, 7, 64 * 128)]


def test_slices_hold_the_scores():
    r = np.random.default_rng(2)
    for _ in range(20):
        values, q = r.integers(-40, 40, (130, 9)), r.integers(-70, 70, 9)
        index = Slices(values)
        slices, constant = index.scores(q)
        assert [v - constant for v in index.value(slices, np.arange(130))] == (values @ q).tolist()
    assert all(sum(s << w for w, s in digits(q)) == q for q in range(-300, 300))
