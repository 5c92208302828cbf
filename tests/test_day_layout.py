"""Tables partitioned by day: time windows list and read their days only, results are those of the hash layout."""

import re

import pytest

from conftest import SF_SMALL
from vaultlake.config import VaultConfig
from vaultlake.plans import activity as A
from vaultlake.plans import blocks as B
from vaultlake.plans import vaults as V
from vaultlake.sources.ledger import Ledger

WINDOWED = {
    "recent_events": lambda L: A.recent_events(L, days=5),
    "events_per_contract": lambda L: A.events_per_contract(L, days=5),
    "fees_daily": lambda L: A.fees_daily(L, days=90),
    "top_accounts": lambda L: A.top_accounts(L, days=90),
    "failure_share": lambda L: A.failure_share(L, days=90),
    "hourly_counts_filled": lambda L: A.hourly_counts_filled(L, days=5),
    "moving_avg_rank": lambda L: A.moving_avg_rank(L, days=5),
    "scan_events": lambda L: B.scan_events(L, days=5),
    "scan_transactions": lambda L: B.scan_transactions(L, days=90),
}


@pytest.fixture(scope="module")
def daily(spark):
    """Only few of the 2,400 days of transactions are written, for time."""
    L = Ledger(spark, SF_SMALL, VaultConfig(layout="day"))
    build = L._derive_transactions
    L._derive_transactions = lambda: build().where("closed_at_date >= date'2001-01-01'")
    return L


def partition_filters(df):
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"PartitionFilters: \[(.*)\]", text)


@pytest.mark.parametrize("key", sorted(WINDOWED))
def test_window_prunes_days(spark, daily, key):
    df = WINDOWED[key](daily)
    assert any("closed_at_date" in f and ">=" in f for f in partition_filters(df))
    got = sorted(map(str, df.collect()))
    assert got and got == sorted(map(str, WINDOWED[key](Ledger.shared(spark, SF_SMALL)).collect()))


def files_read(df):
    """Files that the scan of `df` opens."""
    df = df.select("*")  # metrics are set by the first run of a plan only
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if plan.getClass().getSimpleName() == "ResultQueryStageExec":
        plan = plan.plan()
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i).metrics() for i in range(leaves.size())]
    return sum(m.apply("numFiles").value() for m in scans if m.contains("numFiles"))


def test_only_files_of_the_window_are_read(daily):
    """By an explicit day, and by the newest day of the table."""
    every = daily.contract_events.select("contract_id")
    last = daily.contract_events.agg({"closed_at_date": "max"}).collect()[0][0]
    for as_of in (str(last), None):
        two = A.within(daily.contract_events, 1, as_of).select("contract_id")
        days = {r[0] for r in two.selectExpr("_metadata.file_path").distinct().collect()}
        assert {re.search("closed_at_date=([0-9-]+)", d)[1] for d in days} <= {str(last), str(last.fromordinal(last.toordinal() - 1))}
        assert 0 < files_read(two) < files_read(every) / 5


def test_newest_day_needs_no_column(daily):
    """The end of the window comes from partition values: no column is read for it."""
    df = daily.contract_events.select(A.today(daily.contract_events).alias("d")).limit(1)
    text = df._jdf.queryExecution().toString()
    assert re.search(r"ReadSchema: struct<>", text)
    times = [r[0] for r in daily.contract_events.select("closed_at").collect()]
    assert daily.spark.range(1).select(A.newest(daily.contract_events)).collect()[0][0] == max(times)


def test_other_queries_agree(spark, daily):
    for plan in (V.vault_events, V.tvl_hours, A.ingest_lag):
        assert sorted(map(str, plan(daily).collect())) == sorted(map(str, plan(Ledger.shared(spark, SF_SMALL)).collect()))


def test_tables_without_a_day_column(spark, daily):
    bare = daily.transactions.drop("closed_at_date")
    assert sorted(A.within(bare, 90).collect()) == sorted(A.within(daily.transactions, 90).drop("closed_at_date").collect())


def test_as_of_and_empty(daily):
    assert A.events_per_contract(daily, days=2, as_of="1990-01-01").count() == A.events_per_contract(daily, days=40000).count()
    assert A.events_per_contract(daily, days=2, as_of="2990-01-01").count() == 0


def test_unknown_layout(spark):
    with pytest.raises(ValueError):
        Ledger(spark, SF_SMALL, VaultConfig(layout="month")).contract_events
