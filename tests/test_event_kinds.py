"""Every documented event kind decodes into its typed columns; swaps, unwinds and investments into the log."""

from decimal import Decimal

from conftest import SF_SMALL
from tools.compare import duck
from vaultlake.oracle.sql import with_ctes
from vaultlake.plans.audit import DECODER, creations, decode, rebalance
from vaultlake.sources.ledger import Ledger

A = '{"address":"%s"}'.__mod__
N = '{"i128":"%d"}'.__mod__


def payload(**fields):
    return '{"map":[' + ",".join('{"key":{"symbol":"%s"},"val":%s}' % kv for kv in fields.items()) + "]}"


def vec(*items):
    return '{"vec":[' + ",".join(items) + "]}"


EVENTS = {
    ("factory", "create"): (payload(assets=vec(), roles='{"map":[]}', vault_fee='{"u32":100}'), {"detail": "100"}),
    ("factory", "new_admin"): (payload(new_admin=A("GADM")), {"detail": "GADM"}),
    ("factory", "new_receiver"): (payload(new_some_receiver=A("GREC")), {"detail": "GREC"}),
    ("factory", "new_fee_rate"): (payload(new_some_fee='{"u32":500}'), {"detail": "500"}),
    ("factory", "new_wasm_hash"): (payload(new_vault_wasm_hash='{"bytes":"00ff"}'), {"detail": "00ff"}),
    ("vault", "deposit"): (
        payload(amounts=vec(N(12345671), N(1)), depositor=A("GU"), df_tokens_minted=N(5)),
        {"account": "GU", "amount": Decimal("1.2345671"), "amounts": "1.2345671,0.0000001", "shares": Decimal("0.0000005")},
    ),
    ("vault", "withdraw"): (
        payload(amounts_withdrawn=vec(N(10**7)), df_tokens_burned=N(10**7), withdrawer=A("GW")),
        {"account": "GW", "amount": Decimal(1), "amounts": "1.0000000", "shares": Decimal(1)},
    ),
    ("vault", "emergency_withdraw"): (
        payload(amount_withdrawn=N(2 * 10**7), caller=A("GC"), strategy_address=A("CS")), {"account": "GC", "strategy": "CS", "amount": Decimal(2)},
    ),
    ("vault", "paused"): (payload(caller=A("GC"), strategy_address=A("CS")), {"account": "GC", "strategy": "CS"}),
    ("vault", "unpaused"): (payload(caller=A("GC"), strategy_address=A("CS")), {"account": "GC", "strategy": "CS"}),
    ("vault", "fee_receiver_changed"): (payload(caller=A("GC"), new_fee_receiver=A("GF")), {"account": "GC", "detail": "GF"}),
    ("vault", "manager_changed"): (payload(new_manager=A("GM")), {"detail": "GM"}),
    ("vault", "emergency_manager_changed"): (payload(new_emergency_manager=A("GE")), {"detail": "GE"}),
    ("vault", "rebalance_manager_changed"): (payload(new_rebalance_manager=A("GR")), {"detail": "GR"}),
    ("vault", "dfees"): (payload(distributed_fees=vec(vec(A("CA"), N(3)))), {}),
    ("vault", "unwind"): (payload(call_params=vec(vec(A("CS"), N(30), A("CV"))), report=payload(gains_or_losses=N(-1), locked_fee=N(2), prev_balance=N(3))), {}),
    ("vault", "invest"): (
        payload(
            asset_investments=vec(payload(asset=A("CA"), strategy_investments=vec(payload(amount=N(7), strategy=A("C1")), payload(amount=N(8), strategy=A("C2"))))),
            report=payload(gains_or_losses=N(4), locked_fee=N(5), prev_balance=N(6)),
        ), {},
    ),
    ("vault", "swap_exact_in"): (payload(swap_args=vec(A("CA"), A("CB"), N(9), N(1), '{"u64":5}')), {}),
    ("vault", "swap_exact_out"): (payload(swap_args=vec(A("CA"), A("CB"), N(11))), {}),
    ("strategy", "deposit"): (payload(amount=N(10**7), **{"from": A("GS")}), {"account": "GS", "amount": Decimal(1)}),
    ("strategy", "withdraw"): (payload(amount=N(10**7), **{"from": A("GS")}), {"account": "GS", "amount": Decimal(1)}),
    ("strategy", "harvest"): (payload(amount=N(10**7), price_per_share=N(3), **{"from": A("GS")}), {"account": "GS", "amount": Decimal(1)}),
}


def events(spark):
    rows = [("T", s, "C", '[{"symbol":"x"},{"symbol":"%s"}]' % k, data) for (s, k), (data, _) in EVENTS.items()]
    return spark.createDataFrame(rows, "transaction_hash string, source string, contract_id string, topics_decoded string, data_decoded string").selectExpr(
        "*", "timestamp_ntz '2024-01-01 00:00:00' as closed_at", "source as order_key"
    )


def test_all_kinds(spark):
    assert set(EVENTS) == set(DECODER) and len(DECODER) == 22
    for source in ("factory", "vault", "strategy"):
        got = {x["kind"]: x for x in decode(events(spark).where(f"source = '{source}'")).collect()}
        for (s, kind), (_, want) in EVENTS.items():
            if s == source:
                row = got[kind].asDict()
                assert {c: row[c] for c in ("account", "strategy", "amount", "amounts", "shares", "detail") if row[c] is not None} == want, kind


def test_rebalance_log(spark):
    u = lambda n: Decimal(n).scaleb(-7)
    got = {(x["kind"], x["strategy"], x["amount"], x["gains_or_losses"], x["prev_balance"]) for x in rebalance(events(spark)).collect()}
    assert got == {
        ("unwind", "CS", u(30), u(-1), u(3)), ("invest", "C1", u(7), u(4), u(6)), ("invest", "C2", u(8), u(4), u(6)),
        ("swap_exact_in", None, u(9), None, None), ("swap_exact_out", None, u(11), None, None),
    }


def test_swap_arguments(spark):
    u = lambda n: Decimal(n).scaleb(-7)
    args = vec(A("CA"), A("CB"), N(9), N(1), '{"u64":5}', vec(A("CA"), A("CX"), A("CB")))
    rows = [("T", "C", '[{"symbol":"x"},{"symbol":"%s"}]' % k, data) for k, data in (
        ("swap_exact_in", payload(swap_args=args)), ("swap_exact_out", payload(swap_args=args)),
        ("swap_exact_in", payload(swap_args=vec())), ("swap_exact_out", payload()), ("swap_exact_out", None))]
    ev = spark.createDataFrame(rows, "transaction_hash string, contract_id string, topics_decoded string, data_decoded string").withColumn(
        "closed_at", decode_time())
    got = [tuple(x) for x in rebalance(ev).select("kind", "amount", "asset_in", "asset_out", "amount_in", "amount_out", "path", "deadline").collect()]
    none = (None,) * 7
    assert sorted(got, key=str) == sorted([
        ("swap_exact_in", u(9), "CA", "CB", u(9), u(1), "CA,CX,CB", 5), ("swap_exact_out", u(9), "CA", "CB", u(1), u(9), "CA,CX,CB", 5),
        ("swap_exact_in", *none), ("swap_exact_out", *none), ("swap_exact_out", *none)], key=str)


def decode_time():
    from pyspark.sql import functions as F

    return F.expr("timestamp_ntz '2024-01-01 00:00:00'")


def test_creations(spark):
    role = '{"key":{"u32":%d},"val":{"address":"%s"}}'.__mod__
    member = lambda a, paused: payload(address=A(a), name='{"string":"n"}', paused='{"bool":%s}' % paused)
    rows = {
        "full": payload(
            assets=vec(payload(address=A("CA"), strategies=vec(member("S1", "true"), member("S2", "false"))), payload(address=A("CB"), strategies=vec())),
            roles='{"map":[%s]}' % ",".join(map(role, [(2, "GM"), (0, "GE"), (9, "GX"), (10, "GY")])), vault_fee='{"u32":100}'),
        "bare": payload(assets=vec(), roles='{"map":[]}', vault_fee='{"u32":0}'),
        "void": payload(),
    }
    ev = spark.createDataFrame([(k, "F", '[{"symbol":"x"},{"symbol":"create"}]', v) for k, v in rows.items()] + [("other", "F", '[{"symbol":"x"},{"symbol":"new_admin"}]', rows["full"])],
                               "transaction_hash string, contract_id string, topics_decoded string, data_decoded string").withColumn("closed_at", decode_time())
    got = {tuple(x)[:1] + tuple(x)[2:] for x in creations(ev).collect()}
    whole = ("full", 100, "GE", None, "GM", None, "0:GE,2:GM,9:GX,10:GY")
    assert got == {
        (*whole, "CA", "S1,S2", 1), (*whole, "CB", "", 0), ("bare", 0, None, None, None, None, "", None, None, None),
        ("void", None, None, None, None, None, None, None, None, None),
    }


def test_ledger_holds_every_kind_but_one(spark):
    """All payloads of the derived log are those of the oracle, and every documented kind but the emergency
    withdrawal is among them."""
    L = Ledger.shared(spark, SF_SMALL)
    got = {tuple(x) for x in L.contract_events.select("contract_id", "topics_decoded", "data_decoded").collect()}
    _, want = duck(SF_SMALL, with_ctes(["ev_json"], "SELECT contract_id, topics_decoded, data_decoded FROM ev_json"))
    assert got == set(want)
    names = {"YieldVault": "vault", "YieldFactory": "factory", "BlendStrategy": "strategy"}
    import json

    topics = [[x.get("symbol") for x in json.loads(t)] for _, t, _ in got]
    assert ["transfer", None, None] in topics
    kinds = {(names[a], b) for a, b, *_ in topics if b}
    assert set(DECODER) - kinds == {("vault", "emergency_withdraw")}


def test_events_of_contracts_with_an_asset(spark):
    """Any state of a contract counts; several contracts may carry the code; broadcast or not gives the same."""
    from vaultlake.config import VaultConfig
    from vaultlake.plans.activity import asset_contract_events

    state = spark.createDataFrame([("A", "USDC"), ("A", "OLD"), ("B", "USDC"), ("B", "USDC"), ("C", "EURC"), ("D", None), (None, "USDC"), ("E", "USDC")], "contract_id string, asset_code string")
    ev = spark.createDataFrame(
        [("A", "t1", True), ("A", "t1", True), ("A", "t2", True), ("B", "t3", True), ("B", "t4", False), ("C", "t5", True), ("D", "t6", True), (None, "t7", True)],
        "contract_id string, transaction_hash string, successful boolean").withColumn("closed_at", decode_time())
    for limit in (100, 0):
        out = asset_contract_events(Ledger.from_tables(spark, state, ev, config=VaultConfig(max_broadcast_rows=limit)))
        assert [tuple(x)[:3] for x in out.collect()] == [("A", 3, 2), ("B", 1, 1)]
