"""Operators against their plain-window definitions, on data with one hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from vaultlake.operators.latest import latest_per_key, latest_with_ties
from vaultlake.operators.ordered import lag_by_key, rolling_mean_rows
from vaultlake.plans.vaults import forward_fill


def _skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 40)}"
        rows.append((k, i * 10 + rnd.randint(0, 9), rnd.randint(0, 5)))
    return spark.createDataFrame(rows, "k string, t long, v long")


def test_lag_matches_window(spark):
    df = _skewed(spark)
    got = lag_by_key(df, ["k"], ["t"], ["v"]).select("k", "t", "prev_v")
    exp = df.select("k", "t", F.lag("v").over(Window.partitionBy("k").orderBy("t")).alias("prev_v"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_lead_matches_window(spark):
    df = _skewed(spark)
    got = lag_by_key(df, ["k"], ["t"], ["v"], prefix="next_", lead=True).select("k", "t", "next_v")
    exp = df.select("k", "t", F.lead("v").over(Window.partitionBy("k").orderBy("t")).alias("next_v"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_rolling_mean_matches_window(spark):
    df = _skewed(spark)
    got = rolling_mean_rows(df, ["k"], ["t"], "v", 100, "m").select("k", "t", F.round("m", 9).alias("m"))
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-99, 0)
    exp = df.select("k", "t", F.round(F.avg("v").over(w), 9).alias("m"))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_latest_per_key_and_ties(spark):
    df = spark.createDataFrame(
        [("a", 1, 10, "x"), ("a", 3, 5, "y"), ("a", 3, 7, "z"), ("b", 2, 1, "w")], "k string, t int, s int, v string"
    )
    got = {r.k: (r.t, r.s, r.v) for r in latest_per_key(df, ["k"], ["t", "s"], ["v"]).collect()}
    assert got == {"a": (3, 7, "z"), "b": (2, 1, "w")}
    ties = latest_with_ties(df, ["k"], "t").collect()
    assert sorted(r.v for r in ties) == ["w", "y", "z"]


def test_forward_fill_gap_and_leading_nulls(spark):
    rows = [("v", d, val, None if val is None else val * 2) for d, val in
            [(1, None), (2, 5), (3, None), (4, None), (5, None), (6, 9)]]
    df = spark.createDataFrame(rows, "vault string, day int, a int, u int")
    got = {r.day: (r.a, r.u) for r in forward_fill(df, "vault", "day", "a", ["u"]).collect()}
    assert got[1] == (None, None)
    assert [got[d] for d in (3, 4, 5)] == [(5, 10)] * 3
    assert got[6] == (9, 18)


def test_forward_fill_keeps_null_companion(spark):
    df = spark.createDataFrame([("v", 1, 5, None), ("v", 2, None, 3)], "vault string, day int, a int, u int")
    got = {r.day: (r.a, r.u) for r in forward_fill(df, "vault", "day", "a", ["u"]).collect()}
    assert got[2] == (5, None)


def test_lag_with_null_keys_ties_and_a_burst_equals_the_plain_window(spark):
    from pyspark.sql import Window

    rows = [(None if i % 2 else i % 5, 10**6 if i % 3 else i, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, t long, v long")
    got = lag_by_key(df, ["k"], ["t", "v"], ["v"], partitions=4)
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("k").orderBy("t", "v")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
