"""TVL chain rules on a hand-made ledger: pegged price, unpriced assets, zero vaults, gaps."""

from decimal import Decimal

from pyspark.sql import functions as F

from vaultlake.config import FACTORY_CONTRACT, KEY_INSTANCE, KEY_VEC
from vaultlake.plans import vaults as V
from vaultlake.sources.ledger import CONTRACT_DATA_COLUMNS, Ledger

TOP = '[{"symbol":"YieldVault"},{"symbol":"deposit"}]'
VAULTS = {"CV0001": ("CAUSD", "USDC"), "CV0002": ("CAEUR", "EURC"), "CV0003": ("CAAQ", "AQUA")}


def _instance(name, asset):
    return ('{"contract_instance":{"storage":[{"val":{"map":[{},{"val":{"string":"YieldVault-%s"}},{"val":{"string":"S"}}]}},'
            '{"val":{"map":[{"val":{"address":"%s"}}]}}]}}') % (name, asset)


def _state(spark):
    rows = []
    for i, (v, (asset, code)) in enumerate(VAULTS.items()):
        rows.append(dict(contract_id=FACTORY_CONTRACT, contract_key_type=KEY_VEC, val_decoded='{"address":"%s"}' % v, ledger_sequence=i))
        rows.append(dict(contract_id=v, contract_key_type=KEY_INSTANCE, val_decoded=_instance(v, asset), ledger_sequence=10 + i))
        rows.append(dict(contract_id=asset, contract_key_type=KEY_INSTANCE, val_decoded="{}", asset_code=code, ledger_sequence=20 + i))
    schema = ", ".join(f"{n} {t}" for n, t in CONTRACT_DATA_COLUMNS)
    df = spark.createDataFrame([tuple(r.get(n) for n, _ in CONTRACT_DATA_COLUMNS) for r in rows], schema)
    return df.withColumn("closed_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("deleted", F.lit(False))


def _deposit(tvl_units):
    return ('{"map":[{"key":{"symbol":"amounts"},"val":{"vec":[{"i128":"1"}]}},{"key":{"symbol":"depositor"},"val":{"address":"GA"}},'
            '{"key":{"symbol":"total_managed_funds_before"},"val":{"vec":[{"map":[{"key":{"symbol":"total_amount"},'
            '"val":{"i128":{"hi":0,"lo":%d}}}]}]}}]}') % tvl_units


def _ledger(spark, events=None):
    events = events or [
        # USDC vault: day 2 and day 6 (gap of 3 days between), no price rows at all
        ("T1", "CV0001", "2024-01-02 10:00:00", 100000000), ("T2", "CV0001", "2024-01-06 09:00:00", 300000000),
        # EURC vault: priced on day 3 only; its day-5 reading has no price and is dropped
        ("T3", "CV0002", "2024-01-03 08:00:00", 50000000), ("T4", "CV0002", "2024-01-05 08:00:00", 70000000),
        # AQUA vault: always zero value locked
        ("T5", "CV0003", "2024-01-01 01:00:00", 0), ("T6", "CV0003", "2024-01-04 01:00:00", 0),
    ]
    ev = spark.createDataFrame(
        [(tx, 1, True, v, TOP, _deposit(u), ts) for tx, v, ts, u in events],
        "transaction_hash string, transaction_id bigint, successful boolean, contract_id string, topics_decoded string, "
        "data_decoded string, closed_at string",
    ).withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz"))
    prices = spark.createDataFrame(
        [("CAEUR", Decimal("1.1000000"), "2024-01-03 00:00:00"), ("CAAQ", Decimal("0.5000000"), "2024-01-01 00:00:00"),
         ("CAAQ", Decimal("0.5000000"), "2024-01-04 00:00:00")],
        "contract_id string, price decimal(13,7), closed_at_day string",
    ).withColumn("closed_at_day", F.col("closed_at_day").cast("timestamp_ntz"))
    return Ledger.from_tables(spark, contract_data=_state(spark), contract_events=ev, prices=prices)


def test_price_rules(spark):
    rows = {(r.vault, r.hour.day): r for r in V.tvl_hours_df(_ledger(spark)).collect()}
    assert rows[("CV0001", 2)].asset_price == Decimal("1.0000000")
    assert rows[("CV0001", 2)].usd_tvl == Decimal("10.0000000")
    assert rows[("CV0002", 3)].usd_tvl == Decimal("5.5000000")
    assert ("CV0002", 5) not in rows


def test_filled_days(spark):
    rows = V.tvl_days_filled_df(_ledger(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.vault, {})[r.day.day] = r.asset_tvl
    assert "CV0003" not in by
    assert sorted(by["CV0001"]) == [2, 3, 4, 5, 6]
    assert [by["CV0001"][d] for d in (3, 4, 5)] == [Decimal("10.0000000")] * 3
    assert sorted(by["CV0002"]) == [3, 4, 5, 6]


def test_growth_over_thirty_days(spark):
    from vaultlake.plans.tvl import tvl_growth_30d

    led = _ledger(spark, [("T1", "CV0001", "2024-01-02 10:00:00", 100000000), ("T2", "CV0001", "2024-02-11 09:00:00", 150000000)])
    rows = tvl_growth_30d(led).collect()
    assert [(r.vault, r.tvl_before, r.tvl_today, float(r.growth_pct)) for r in rows] == [("CV0001", Decimal(10), Decimal(15), 50.0)]
