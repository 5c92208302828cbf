"""Invariants between keys on the driver tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vaultlake.plans import activity as A
from vaultlake.plans import blocks as B
from vaultlake.plans import vaults as V
from vaultlake.sources.ledger import Ledger


def test_net_flow_is_deposits_minus_withdrawals(spark):
    L = Ledger.shared(spark, SF_SMALL)
    per_vault = A.net_flow_vault(L).groupBy("day").agg(
        F.sum("deposits").alias("d"), F.sum("withdrawals").alias("w"), F.sum("net_flow").alias("n")
    )
    total = {r.day: r.net_flow for r in A.net_flow(L).collect()}
    for r in per_vault.collect():
        assert r.n == r.d - r.w
        assert total[r.day] == r.n


def test_grid_is_days_times_live_vaults(spark):
    L = Ledger.shared(spark, SF_SMALL)
    days = B.calendar(L).count()
    keys = V.nonzero_keys(L).count()
    assert V.dense_grid(L).count() == days * keys
    assert V.tvl_days_filled(L).count() <= days * keys


def test_latest_total_equals_sum_of_latest(spark):
    L = Ledger.shared(spark, SF_SMALL)
    total = V.latest_usd_tvl(L).collect()[0].total_usd_tvl
    assert total == sum(r.usd_tvl for r in V.latest_vaults(L).collect())


def test_as_of_sets_the_window_start(spark):
    import datetime as dt

    L = Ledger.shared(spark, SF_SMALL)
    rows = A.fees_daily(L, days=30, as_of="1998-01-31").collect()
    assert rows and min(r.day for r in rows) >= dt.datetime(1998, 1, 1)
    default = A.fees_daily(L).collect()
    assert len(default) <= 31


def test_only_successful_option(spark):
    from vaultlake.config import VaultConfig

    strict = Ledger(spark, SF_SMALL, VaultConfig(only_successful=True))
    loose = Ledger.shared(spark, SF_SMALL)
    n_strict = V.vault_events(strict).count()
    n_loose = V.vault_events(loose).count()
    assert 0 < n_strict < n_loose
