"""As-of join against a loop, with a hot key, equal times, missing keys and times, and repeated rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vaultlake.operators.asof import asof_join
from vaultlake.plans import audit
from vaultlake.sources.ledger import Ledger

T0 = datetime(2024, 1, 1)


def rows(seed, n, times):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.02 else r.choice(["hot"] * 6 + ["a", "b"])
    return [(i, key(), None if r.random() < 0.02 else T0 + timedelta(minutes=r.randrange(times)), r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("times", [2000, 20, 1])
def test_against_a_loop(spark, times):
    left, right = rows(1, 400, times), rows(2, 300, times)
    left.append(left[0])
    schema = "i int, k string, t timestamp_ntz, o int"
    l, r = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = asof_join(l, r.select("k", F.col("t").alias("rt"), "o", F.col("i").alias("v")), ["k"], "t", "rt", ["v"], ["o"])
    assert got.columns == ["i", "k", "t", "o", "v"]
    want = []
    for i, k, t, o in left:
        fit = [(rt, ro, ri) for ri, rk, rt, ro in right if None not in (k, t, rt) and rk == k and rt <= t]
        want.append((i, max(fit)[2] if fit else None))
    assert sorted(((x["i"], x["v"]) for x in got.collect()), key=str) == sorted(want, key=str)


def test_empty_sides(spark):
    schema = "k string, t timestamp_ntz, v int"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([("a", T0, 1)], schema)
    right = lambda d: d.select("k", F.col("t").alias("rt"), F.col("v").alias("w"))
    assert [tuple(r) for r in asof_join(some, right(none), ["k"], "t", "rt", ["w"]).collect()] == [("a", T0, 1, None)]
    assert asof_join(none, right(some), ["k"], "t", "rt", ["w"]).collect() == []


def test_status_at_a_time(spark):
    """The state at a time is that of the log that ends there."""
    led = Ledger.shared(spark, SF_SMALL)
    at = "2024-01-15 12:00:00"
    ev = led.contract_events.where(F.col("closed_at") <= F.lit(at).cast("timestamp_ntz"))
    cut = Ledger.from_tables(spark, led.contract_data, ev, None, led.prices, led.cfg)
    got, want = audit.strategy_status(led, at), audit.strategy_status(cut)
    assert sorted(got.collect()) == sorted(want.collect())
    assert 0 < got.count() and sorted(got.collect()) != sorted(audit.strategy_status(led).collect())


def test_pause_and_unpause_of_one_transaction_is_paused(spark):
    led = Ledger.shared(spark, SF_SMALL)
    ev = led.contract_events.where(F.col("topics_decoded").like("%paused%")).orderBy("closed_at").limit(1)
    other = F.when(F.col("topics_decoded").like("%unpaused%"), F.replace("topics_decoded", F.lit("unpaused"), F.lit("paused")))
    both = ev.unionByName(ev.withColumn("topics_decoded", other.otherwise(F.replace("topics_decoded", F.lit("paused"), F.lit("unpaused")))))
    cut = Ledger.from_tables(spark, led.contract_data, both, None, led.prices, led.cfg)
    assert both.count() == 2 and [r["status"] for r in audit.strategy_status(cut).collect()] == ["paused"]
