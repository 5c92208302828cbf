"""Incremental refresh: only what changed is computed anew, and the tables equal a full build."""

from collections import Counter
from datetime import date

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vaultlake.plans import refresh as R
from vaultlake.plans import vaults as V
from vaultlake.sources.ledger import Ledger

LAST = date(2024, 1, 30)


def same(spark, led, root):
    full = Ledger.from_tables(spark, led.contract_data, led.contract_events, None, led.prices, led.cfg)
    full._dims.update(vault_info=V.vault_info_dim(Ledger.shared(spark, SF_SMALL)))
    for level, build in {"vault_events": V.vault_events_df, "tvl_hours": V.tvl_hours_df, "tvl_days_filled": V.tvl_days_filled_df}.items():
        whole, kept = build(full).cache(), R.read_level(spark, root, level)
        full.store_level(level, whole)
        assert kept.dtypes == whole.dtypes
        assert Counter(kept.collect()) == Counter(whole.collect()), level


def of(report, level):
    return {r["day"] for r in report.where(F.col("level") == level).collect()}


def test_refresh_follows_the_inputs(spark, tmp_path):
    base = Ledger.shared(spark, SF_SMALL)
    root = str(tmp_path / "levels")
    ev, prices = base.contract_events, base.prices
    flows = F.col("topics_decoded").like("%deposit%") | F.col("topics_decoded").like("%withdraw%")
    # transactions of one day only, so that days are independent
    one_day = ev.groupBy("transaction_hash").agg(F.countDistinct(F.to_date("closed_at")).alias("n")).where("n = 1").select("transaction_hash")
    ev = ev.join(one_day, "transaction_hash", "left_semi")
    ev = ev.cache()
    led = lambda e, p=prices: Ledger.from_tables(spark, base.contract_data, e, None, p, base.cfg)

    first = led(ev.where(F.to_date("closed_at") < F.lit(LAST)))
    R.refresh_dag(first, root)
    same(spark, first, root)
    assert R.refresh_dag(first, root).count() == 0

    # a day is appended
    report = R.refresh_dag(led(ev), root)
    assert of(report, "vault_events") == of(report, "tvl_hours") == of(report, "tvl_days_filled") == {LAST}
    same(spark, led(ev), root)

    # a late event on an early day raises its value: its day is computed anew, the series while it is carried on
    early = date(2024, 1, 10)
    late = ev.where(flows & (F.to_date("closed_at") == F.lit(early))).orderBy("closed_at").limit(1)
    late = late.withColumns({"transaction_hash": F.lit("late"), "closed_at": F.lit("2024-01-10 23:59:00").cast("timestamp_ntz")})
    more = led(ev.unionByName(late))
    report = R.refresh_dag(more, root)
    assert of(report, "vault_events") == {early} and of(report, "tvl_hours") == {early}
    assert all(early <= d for d in of(report, "tvl_days_filled"))
    same(spark, more, root)

    # a price changes: events stay as they are
    dear = prices.withColumn("price", F.when(F.col("closed_at_day") == F.lit("2024-01-12").cast("timestamp_ntz"), F.col("price") * 2).otherwise(F.col("price")).cast("decimal(13,7)"))
    report = R.refresh_dag(led(ev, dear), root)
    assert date(2024, 1, 12) in of(report, "tvl_hours") and of(report, "vault_events") == {early}
    same(spark, led(ev, dear), root)

    # the events of a day vanish
    gone = led(ev.where(F.to_date("closed_at") != F.lit(early)), dear)
    R.refresh_dag(gone, root)
    same(spark, gone, root)


def test_a_transaction_over_midnight(spark, tmp_path):
    """Its amount is one sum, so a new event on one day changes the row on the other."""
    base = Ledger.shared(spark, SF_SMALL)
    root = str(tmp_path / "levels")
    dep = base.contract_events.where(F.col("topics_decoded").like("%deposit%") & F.to_date("closed_at").isin(date(2024, 1, 5), date(2024, 1, 6)))
    more = dep.where(F.to_date("closed_at") == F.lit("2024-01-05")).orderBy("closed_at").limit(3)
    more = more.withColumn("closed_at", F.col("closed_at") + F.expr("INTERVAL 1 DAY"))
    led = lambda e: Ledger.from_tables(spark, base.contract_data, e, None, base.prices, base.cfg)
    R.refresh_dag(led(dep), root)
    report = R.refresh_dag(led(dep.unionByName(more)), root)
    assert of(report, "vault_events") == {date(2024, 1, 5), date(2024, 1, 6)}
    same(spark, led(dep.unionByName(more)), root)


def test_a_refresh_that_died_changes_nothing(spark, tmp_path, monkeypatch):
    base = Ledger.shared(spark, SF_SMALL)
    root = str(tmp_path / "levels")
    ev = base.contract_events.where(F.to_date("closed_at") < F.lit(date(2024, 1, 4)))
    led = lambda e: Ledger.from_tables(spark, base.contract_data, e, None, base.prices, base.cfg)
    short = led(ev.where(F.to_date("closed_at") < F.lit(date(2024, 1, 3))))
    R.refresh_dag(short, root)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(V, "tvl_days_filled_df", dies)
        try:
            R.refresh_dag(led(ev), root)
        except RuntimeError:
            pass
    assert R.read_level(spark, root, "vault_events").select(F.max("closed_at")).first()[0].date() < date(2024, 1, 3)
    R.refresh_dag(led(ev), root)
    same(spark, led(ev), root)


def test_no_events(spark, tmp_path):
    base = Ledger.shared(spark, SF_SMALL)
    led = Ledger.from_tables(spark, base.contract_data, base.contract_events.where("false"), None, base.prices, base.cfg)
    R.refresh_dag(led, str(tmp_path / "levels"))
    assert all(R.read_level(spark, str(tmp_path / "levels"), level).count() == 0 for level in R.LEVELS)
