"""Query rules on hand-made ledger rows (FIXTURES part B)."""

from pyspark.sql import functions as F

from vaultlake.config import FACTORY_CONTRACT, KEY_INSTANCE, KEY_VEC, NATIVE_ASSET_CONTRACT
from vaultlake.plans import vaults as V
from vaultlake.sources.ledger import CONTRACT_DATA_COLUMNS, Ledger

EV_COLS = ("transaction_hash string, transaction_id bigint, successful boolean, contract_id string, "
           "topics_decoded string, data_decoded string, closed_at timestamp_ntz")


def FixtureLedger(spark, events, state):
    return Ledger.from_tables(spark, contract_data=state, contract_events=events)


def _i(units):
    return '{"i128":{"hi":0,"lo":%d}}' % units


def _deposit(user, amounts, tvl_units):
    funds = "" if tvl_units is None else '{"map":[{"key":{"symbol":"total_amount"},"val":%s}]}' % _i(tvl_units)
    return ('{"map":[{"key":{"symbol":"amounts"},"val":{"vec":[%s]}},{"key":{"symbol":"depositor"},"val":{"address":"%s"}},'
            '{"key":{"symbol":"total_managed_funds_before"},"val":{"vec":[%s]}}]}') % (",".join(_i(a) for a in amounts), user, funds)


def _state(spark, vault="CV0001", name="YieldVault-Alpha", asset=NATIVE_ASSET_CONTRACT, code=""):
    inst = ('{"contract_instance":{"storage":[{"val":{"map":[{},{"val":{"string":"%s"}},{"val":{"string":"ALP"}}]}},'
            '{"val":{"map":[{"val":{"address":"%s"}}]}}]}}') % (name, asset)
    rows = [
        dict(contract_id=FACTORY_CONTRACT, contract_key_type=KEY_VEC, val_decoded='{"address":"%s"}' % vault, ledger_sequence=1),
        dict(contract_id=vault, contract_key_type=KEY_INSTANCE, val_decoded=inst, ledger_sequence=2),
        dict(contract_id=asset, contract_key_type=KEY_INSTANCE, val_decoded="{}", asset_code=code, ledger_sequence=3),
    ]
    full = [tuple(r.get(n) for n, _ in CONTRACT_DATA_COLUMNS) for r in rows]
    schema = ", ".join(f"{n} {t}" for n, t in CONTRACT_DATA_COLUMNS)
    df = spark.createDataFrame(full, schema)
    return df.withColumn("closed_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).withColumn("deleted", F.lit(False))


def _events(spark, rows):
    return spark.createDataFrame(rows, EV_COLS.replace("timestamp_ntz", "string")).withColumn(
        "closed_at", F.col("closed_at").cast("timestamp_ntz")
    )


TOP = '[{"symbol":"YieldVault"},{"symbol":"%s"}]'


def test_vault_info_native_code_and_display_name(spark):
    L = FixtureLedger(spark, None, _state(spark))
    r = V.vault_info_df(L).collect()[0]
    assert r.vault_name == "Alpha - CV0..001"
    assert r.asset_code == "XLM"


def test_unknown_code(spark):
    L = FixtureLedger(spark, None, _state(spark, asset="CAX", code=""))
    assert V.vault_info_df(L).collect()[0].asset_code == "UNKNOWN"


def test_same_tx_sum_and_rules(spark):
    ev = _events(spark, [
        ("T1", 1, True, "CV0001", TOP % "deposit", _deposit("GA", [100], 5000), "2024-01-01 10:00:00"),
        ("T1", 1, True, "CV0001", TOP % "deposit", _deposit("GB", [200, 50], 6000), "2024-01-01 10:05:00"),
        ("T2", 2, True, "CV0001", '[{"symbol":"YieldVault"},{"symbol":"withdraw"},{"symbol":"deposit"}]', _deposit("GC", [7], 10), "2024-01-01 11:00:00"),
        ("T3", 3, True, "CV0001", TOP % "deposit", _deposit("GD", [9], None), "2024-01-01 12:00:00"),
        ("T4", 4, True, "CV0001", TOP % "deposit", "not json", "2024-01-01 13:00:00"),
    ])
    L = FixtureLedger(spark, ev, _state(spark))
    rows = {(r.tx_hash, r.total_amount): r for r in V.vault_events_df(L).collect()}
    a = rows[("T1", __import__("decimal").Decimal("0.0005000"))]
    b = rows[("T1", __import__("decimal").Decimal("0.0006000"))]
    assert a.amount == b.amount == __import__("decimal").Decimal("0.0000350")
    assert a.to == b.to == "GB"
    assert rows[("T2", __import__("decimal").Decimal("0.0000010"))].event == "withdraw"
    assert not any(k[0] in ("T3", "T4") for k in rows)


def _harvest(pps_units, amount=1000):
    return ('{"map":[{"key":{"symbol":"amount"},"val":{"i128":{"hi":0,"lo":%d}}},{"key":{"symbol":"from"},"val":{"address":"GX"}},'
            '{"key":{"symbol":"price_per_share"},"val":{"i128":{"hi":0,"lo":%d}}}]}') % (amount, pps_units)


HARVEST_TOPIC = '[{"symbol":"BlendStrategy"},{"symbol":"harvest"}]'


def test_apy_golden_one_day(spark):
    from decimal import Decimal

    from vaultlake.config import STRATEGIES
    from vaultlake.plans import strategies as S

    usdc = [a for n, a, t in STRATEGIES if n == "usdc_blend_autocompound_yieldblox_strategy"][0]
    eurc = [a for n, a, t in STRATEGIES if n == "eurc_blend_autocompound_yieldblox_strategy"][0]
    ev = _events(spark, [
        ("H1", 1, True, usdc, HARVEST_TOPIC, _harvest(10000000), "2024-01-09 12:00:00"),
        ("H2", 2, True, usdc, HARVEST_TOPIC, _harvest(10000547), "2024-01-10 12:00:00"),
        ("H3", 3, True, eurc, HARVEST_TOPIC, _harvest(10000100), "2024-01-10 06:00:00"),
    ])
    L = FixtureLedger(spark, ev, _state(spark))
    rows = {r.contract_id: r for r in S.strategy_apy(L).collect()}
    assert rows[usdc].apy_24h == Decimal("2.02")
    assert rows[usdc].events_24h == 2
    assert rows[eurc].apy_24h is None and rows[eurc].events_24h == 1
    xlm = [a for n, a, t in STRATEGIES if n == "xlm_blend_autocompound_yieldblox_strategy"][0]
    assert rows[xlm].events_24h == 0 and rows[xlm].apy_24h is None


def test_deleted_newer_report_loses(spark):
    from vaultlake.plans import strategies as S

    state = _state(spark)
    rep = spark.createDataFrame(
        [("CV0001", '{"vec":[{"symbol":"Report"},{"address":"CS1"}]}',
          '{"map":[{"key":{"symbol":"locked_fee"},"val":{"i128":"%d"}}]}' % units, seq, deleted, ts)
         for units, seq, deleted, ts in [(100, 10, False, "2024-01-01 00:00:00"), (999, 20, True, "2024-01-02 00:00:00")]],
        "contract_id string, key_decoded string, val_decoded string, ledger_sequence long, deleted boolean, closed_at string",
    ).withColumn("closed_at", F.col("closed_at").cast("timestamp_ntz")).withColumn("contract_key_type", F.lit(KEY_VEC))
    full = state.unionByName(rep, allowMissingColumns=True)
    L = FixtureLedger(spark, None, full)
    rows = S.locked_fees(L).collect()
    assert len(rows) == 1 and rows[0].ledger_sequence == 10
    assert str(rows[0].locked_fee) == "0.0000100"
