"""Alerts from keyed state: any order of arrival, restarts and late files give the batch result."""

import os
import random
import time
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tools.compare import duck, rows_of
from vaultlake.sources.ledger import Ledger
from vaultlake.streaming.alerts import VaultState, add_reading, is_drop
from vaultlake.streaming.jobs import stream_alerts, stream_hourly_tvl


def decided(readings, lateness=None):
    """Alerts by newest version after all readings."""
    state, made = VaultState(), {}
    for r in readings:
        for at, tx, prev, now, version, active in add_reading(state, r, -50.0):
            assert version > made.get((at, tx, now), (0,))[0]
            made[at, tx, now] = (version, prev, active)
        if lateness is not None:
            state.let_go_before(max(x[0] for x in state.readings) - lateness)
        state = VaultState.unpack(state.pack())
    return {k: v[1] for k, v in made.items() if v[2]}, state


def in_batch(readings):
    rows = sorted(set(readings))
    return {b: a[2] for a, b in zip(rows, rows[1:]) if is_drop(a[2], b[2], -50.0)}


def test_any_order_gives_the_batch_result():
    r = random.Random(3)
    for _ in range(300):
        readings = [(r.randint(0, 30), f"t{r.randint(0, 2)}", Decimal(r.choice(["0", "1", "2.5", "10", "40.0000001"]))) for _ in range(r.randint(0, 25))]
        r.shuffle(readings)
        assert decided(readings)[0] == in_batch(readings)


def test_state_is_bounded_by_lateness():
    readings = [(t, "t", Decimal(100 if t % 7 else 10)) for t in range(1000)]
    late = [x for k in range(0, 1000, 5) for x in reversed(readings[k : k + 5])]  # late by 4 at most
    found, state = decided(late, lateness=10)
    assert found == in_batch(readings) and len(state.readings) <= 12
    assert list(add_reading(state, (3, "t", Decimal(1)), -50.0)) == []  # what it follows is gone
    assert list(add_reading(VaultState(readings=[(5, "t", Decimal(1))]), (3, "t", Decimal(8)), -50.0)) == [(5, "t", Decimal(8), Decimal(1), 1, True)]


def files(spark, folder, parts):
    """One file per part of the events, in this order of arrival."""
    os.makedirs(folder, exist_ok=True)
    for part in parts:
        out = f"{folder}-{len(os.listdir(folder))}"
        part.coalesce(1).write.parquet(out)
        source = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        os.link(os.path.join(out, source), os.path.join(folder, f"events-{len(os.listdir(folder))}.parquet"))
        time.sleep(1.1)


def alerts(spark, folder, home):
    return stream_alerts(Ledger(spark, SF_SMALL), source=(folder, "events-*.parquet"), home=home, lateness_hours=24 * 60)


def batch(spark):
    cols, rows = duck(SF_SMALL, E.oracle_sql()["stream_alerts"])
    return rows_of(cols, rows)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet").persist()


def test_late_file_restart_and_late_first_event(spark, events, tmp_path):
    """The first days come last and after a restart: first events and the readings before others change."""
    day = F.dayofmonth("ts")
    folder, home = str(tmp_path / "in"), str(tmp_path / "home")
    files(spark, folder, [events.where((day > 8) & (day <= 20)), events.where(day > 20)])
    early = alerts(spark, folder, home)
    early = rows_of(early.columns, [tuple(r) for r in early.collect()])
    files(spark, folder, [events.where((day <= 8) & (F.col("event_id") % 2 == 0)), events.where((day <= 8) & (F.col("event_id") % 2 == 1))])
    got = alerts(spark, folder, home)
    rows = [tuple(r) for r in got.collect()]
    assert rows_of(got.columns, rows) == batch(spark) != early
    kinds = Counter(r[2] for r in rows)
    assert kinds["new_vault"] and kinds["tvl_drop"] and kinds["large_withdrawal"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_files_that_overlap_in_time(spark, events, tmp_path):
    folder = str(tmp_path / "in")
    files(spark, folder, [events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)])
    got = alerts(spark, folder, str(tmp_path / "home"))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == batch(spark)
    hourly = stream_hourly_tvl(Ledger(spark, SF_SMALL), source=(folder, "events-*.parquet"))
    cols, rows = duck(SF_SMALL, E.oracle_sql()["stream_hourly_tvl"])
    assert rows_of(hourly.columns, [tuple(r) for r in hourly.collect()]) == rows_of(cols, rows)
