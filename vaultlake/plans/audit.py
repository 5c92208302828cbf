"""Typed decoding of vault and strategy events and the audits built on it (T1-T10).

All decoding is per row (higher-order functions over the parsed payload); the only shuffles are
the per-key aggregates (partial, skew-tolerant) and the range-split lag of operators.ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlake.config import (
    FACTORY_CONTRACT,
    STRATEGY_TOPIC,
    SYM_AMOUNT,
    SYM_AMOUNTS,
    SYM_AMOUNTS_WITHDRAWN,
    SYM_BURNED,
    SYM_FUNDS_BEFORE,
    SYM_GAINS,
    SYM_LOCKED_FEE,
    SYM_MINTED,
    SYM_PREV_BALANCE,
    SYM_SUPPLY_BEFORE,
    SYM_TOTAL_AMOUNT,
)
from vaultlake.functions.decimals import UNITS, divided, floor_share, from_units, let, plus, subtract, times, to_units
from vaultlake.functions.i128 import i128
from vaultlake.functions.payload import (
    field_values,
    parse_entries,
    parse_payload,
    parse_typed,
    parse_vec,
    typed_addresses,
    typed_i128s,
    typed_vecs,
)
from vaultlake.operators.asof import asof_join
from vaultlake.operators.joins import bounded, keep_rows
from vaultlake.operators.latest import latest_per_key
from vaultlake.operators.ordered import lag_by_key
from vaultlake.plans.strategies import apy, fee_tuples, harvest_events_df, locked_fees, report_pivot
from vaultlake.plans.vaults import registry_vaults, vault_topic_events
from vaultlake.sources.ledger import Ledger

DEC = "decimal(38,7)"

# Decoder table: (contract, kind) -> payload symbols read into typed columns.  The contract is told by
# the first topic (factory events by the contract itself), the kind is the second topic symbol.
#   account: address of the acting user; strategy: strategy address; amount: token amount, or
#   amount_vec: one amount per asset; shares: vault shares minted or burned; detail: what was set (an
#   address, a number or a hash), NEW meaning the symbol that begins with `new_`.
NEW = "new_"
_ROLE = {"detail": [NEW]}
_FLOW = {"account": ["from"], "amount": [SYM_AMOUNT]}
_PAUSE = {"account": ["caller"], "strategy": ["strategy_address"]}
DECODER = {
    ("factory", "create"): {"detail": ["vault_fee"]},
    ("factory", "new_admin"): _ROLE,
    ("factory", "new_receiver"): _ROLE,
    ("factory", "new_fee_rate"): _ROLE,
    ("factory", "new_wasm_hash"): _ROLE,
    ("vault", "deposit"): {"account": ["depositor"], "amount_vec": [SYM_AMOUNTS], "shares": [SYM_MINTED]},
    ("vault", "withdraw"): {"account": ["withdrawer"], "amount_vec": [SYM_AMOUNTS_WITHDRAWN], "shares": [SYM_BURNED]},
    ("vault", "emergency_withdraw"): _PAUSE | {"amount": ["amount_withdrawn"]},
    ("vault", "paused"): _PAUSE,
    ("vault", "unpaused"): _PAUSE,
    ("vault", "fee_receiver_changed"): _ROLE | {"account": ["caller"]},
    ("vault", "manager_changed"): _ROLE,
    ("vault", "emergency_manager_changed"): _ROLE,
    ("vault", "rebalance_manager_changed"): _ROLE,
    ("vault", "dfees"): {},
    ("vault", "unwind"): {},
    ("vault", "invest"): {},
    ("vault", "swap_exact_in"): {},
    ("vault", "swap_exact_out"): {},
    ("strategy", "deposit"): _FLOW,
    ("strategy", "withdraw"): _FLOW,
    ("strategy", "harvest"): _FLOW,
}


def topic_kind() -> Column:
    """Second topic symbol; the first is the contract name."""
    return F.get_json_object("topics_decoded", "$[1].symbol")


def _first(entries: Column, syms: list[str]) -> Column:
    return F.try_element_at(field_values(entries, syms), F.lit(1))


def _typed(entries: Column, field: str, value) -> Column:
    """`value(entries, symbols)` for the kinds that have the field, by (source, kind)."""
    by_symbols: dict[tuple, list] = {}
    for kind, spec in DECODER.items():
        if field in spec:
            by_symbols.setdefault(tuple(spec[field]), []).append("/".join(kind))
    kind = F.concat_ws("/", "source", "kind")
    return F.coalesce(*(F.when(kind.isin(kinds), value(entries, list(syms))) for syms, kinds in by_symbols.items()))


def _detail(entries: Column, symbols: list[str]) -> Column:
    wanted = lambda e: e["key"]["symbol"].startswith(NEW) if symbols == [NEW] else e["key"]["symbol"].isin(symbols)
    val = F.try_element_at(F.filter(entries, wanted), F.lit(1))["val"]
    return F.coalesce(val["address"], val["u32"], val["bytes"], val["string"])


def decode(ev: DataFrame) -> DataFrame:
    """Typed rows of ledger events with a column `source` (factory, vault or strategy): kind, account,
    strategy, amount (of the first asset), amounts (of all assets, comma-joined, in their order),
    shares, detail."""
    ev = ev.select(
        "transaction_hash", "contract_id", "closed_at", "source", topic_kind().alias("kind"), parse_typed(F.col("data_decoded")).alias("e")
    )
    entries = F.col("e")
    one = lambda arr: F.try_element_at(arr, F.lit(1))
    addr = lambda e, s: one(typed_addresses(e, s))
    amount_scalar = _typed(entries, "amount", lambda e, s: one(typed_i128s(e, s)))
    amount_vec = _typed(entries, "amount_vec", lambda e, s: i128(one(typed_vecs(e, s))))
    every = _typed(entries, "amount_vec", lambda e, s: F.array_join(F.transform(typed_vecs(e, s), lambda v: i128(v).cast("string")), ","))
    return ev.select(
        F.col("transaction_hash").alias("tx_hash"), "contract_id", "closed_at", "kind",
        _typed(entries, "account", addr).alias("account"),
        _typed(entries, "strategy", addr).alias("strategy"),
        F.coalesce(amount_vec, amount_scalar).alias("amount"),
        every.alias("amounts"),
        _typed(entries, "shares", lambda e, s: one(typed_i128s(e, s))).alias("shares"),
        _typed(entries, "detail", _detail).alias("detail"),
    )


def known_events(L: Ledger) -> DataFrame:
    """Events of the factory, of registered vaults and of strategies, with their `source`: one scan."""
    t = F.col("topics_decoded")
    vault, strategy = t.like(f"%{L.cfg.vault_topic}%"), t.like(f"%{STRATEGY_TOPIC}%")
    source = F.when(vault, "vault").when(strategy, "strategy").when(F.col("contract_id") == FACTORY_CONTRACT, "factory")
    ev = L.contract_events.withColumn("source", source).where(F.col("source").isNotNull())
    if L.cfg.only_successful:
        ev = ev.where(F.col("successful"))
    vaults = registry_vaults(L)
    registered = bounded(keep_rows(vaults.select(F.col("vault").alias("__vault")).distinct(), vaults), L.cfg.max_broadcast_rows)
    ev = ev.join(registered, ev["contract_id"] == F.col("__vault"), "left")
    return ev.where((F.col("source") != "vault") | F.col("__vault").isNotNull()).drop("__vault")


def decode_events(L: Ledger) -> DataFrame:
    """The decoded event log of all 22 kinds."""
    return decode(known_events(L))


# -- T2 ----------------------------------------------------------------------------------------
def harvest_step_apy(L: Ledger) -> DataFrame:
    """Annualised yield between consecutive harvests of each strategy."""
    h = harvest_events_df(L).select("strategy_address", "closed_at", "hash", "price_per_share")
    p = lag_by_key(h, ["strategy_address"], ["closed_at", "hash"], ["price_per_share", "closed_at"])
    return p.select(
        "strategy_address", "closed_at", "hash", "price_per_share",
        F.col("prev_price_per_share").alias("prev_price_per_share"),
        apy(F.col("prev_price_per_share"), F.col("price_per_share"), F.col("prev_closed_at"), F.col("closed_at")).alias("step_apy"),
    )


# -- T3 ----------------------------------------------------------------------------------------
def fee_audit(L: Ledger) -> DataFrame:
    """Distributed fees per asset address with the grand total (rollup row, address NULL)."""
    return fee_tuples(L).rollup("recipient_address").agg(
        F.sum("fee_amount").alias("total_fees"), F.count(F.lit(1)).alias("tuples")
    )


# -- E1 ----------------------------------------------------------------------------------------
# role numbers of a vault -> column
ROLES = ("emergency_manager", "fee_receiver", "manager", "rebalance_manager")
ROLES_SCHEMA = "struct<map:array<struct<key:struct<u32:int>,val:struct<address:string>>>>"
SET_SCHEMA = "struct<vec:array<struct<map:array<struct<key:struct<symbol:string>,val:struct<address:string,vec:array<string>>>>>>>"
STRATEGY_SCHEMA = "struct<map:array<struct<key:struct<symbol:string>,val:struct<address:string,bool:boolean>>>>"


def creations(ev: DataFrame) -> DataFrame:
    """Vault creations with their fee, the address of each role (NULL if not given), all roles as
    `number:address` in the order of the numbers, and a row per asset (one row with NULL where there is none):
    its strategies, comma-joined in their order, and how many of them begin paused."""
    e = F.col("e")
    staged = ev.where(topic_kind() == "create").select(
        F.col("transaction_hash").alias("tx_hash"), "closed_at", parse_payload(F.col("data_decoded")).alias("e")
    ).select(
        "tx_hash", "closed_at",
        F.get_json_object(_first(e, ["vault_fee"]), "$.u32").cast("bigint").alias("vault_fee"),
        F.array_sort(F.transform(
            F.from_json(_first(e, ["roles"]), ROLES_SCHEMA)["map"],
            lambda x: F.struct(x["key"]["u32"].alias("role"), x["val"]["address"].alias("address")),
        )).alias("r"),
        F.from_json(_first(e, ["assets"]), SET_SCHEMA)["vec"].alias("sets"),
    )
    one_of = lambda entries, symbol: F.try_element_at(F.filter(entries, lambda x: x["key"]["symbol"] == symbol), F.lit(1))["val"]
    role = lambda n: F.try_element_at(F.filter("r", lambda x: x["role"] == n), F.lit(1))["address"]
    rows = staged.select(
        "tx_hash", "closed_at", "vault_fee", *(role(n).alias(name) for n, name in enumerate(ROLES)),
        F.array_join(F.transform("r", lambda x: F.concat(x["role"].cast("string"), F.lit(":"), x["address"])), ",").alias("roles"),
        F.explode_outer("sets").alias("s"),
    )
    rows = rows.withColumn("members", F.transform(
        one_of(F.col("s")["map"], "strategies")["vec"], lambda x: F.from_json(x, STRATEGY_SCHEMA)["map"]
    ))
    return rows.select(
        "tx_hash", "closed_at", "vault_fee", *ROLES, "roles",
        one_of(F.col("s")["map"], "address")["address"].alias("asset"),
        F.array_join(F.transform("members", lambda m: one_of(m, "address")["address"]), ",").alias("strategies"),
        F.size(F.filter("members", lambda m: one_of(m, "paused")["bool"])).cast("bigint").alias("paused_strategies"),
    )


def vault_creations(L: Ledger) -> DataFrame:
    return creations(L.contract_events.where((F.col("contract_id") == FACTORY_CONTRACT) & F.col("topics_decoded").like("%create%")))


# -- T4 ----------------------------------------------------------------------------------------
def rebalance(ev: DataFrame) -> DataFrame:
    """Unwind, invest and swap events as one log: a row per strategy moved, with the event's report; a
    row per swap with its assets, both amounts, path (comma-joined) and deadline, read by type and
    position.  The first amount is the exact one and is `amount`, too: in `swap_exact_in` the one given, so that
    `amount_out` is the least accepted; in `swap_exact_out` the one wanted, so that `amount_in` is the most given."""
    entries = parse_payload(F.col("data_decoded"))
    base = ev.select(F.col("contract_id").alias("vault"), "closed_at", F.col("transaction_hash").alias("tx_hash"), topic_kind().alias("kind"), entries.alias("e"))
    report = parse_entries(F.get_json_object(_first(F.col("e"), ["report"]), "$.map"))
    base = base.select("*", *(i128(_first(report, [s])).alias(s) for s in (SYM_GAINS, SYM_LOCKED_FEE, SYM_PREV_BALANCE)))
    elements = lambda x, symbol: F.flatten(F.transform(field_values(x, symbol), lambda v: F.coalesce(parse_vec(v), F.array().cast("array<string>"))))
    keep = ["vault", "closed_at", "tx_hash", "kind", SYM_GAINS, SYM_LOCKED_FEE, SYM_PREV_BALANCE]
    unwind = base.where(F.col("kind") == "unwind").select(*keep, F.explode(elements(F.col("e"), "call_params")).alias("t")).select(
        *keep, F.get_json_object("t", "$.vec[0].address").alias("strategy"), i128(F.get_json_object("t", "$.vec[1]")).alias("amount")
    )
    assets = base.where(F.col("kind") == "invest").select(*keep, F.explode(elements(F.col("e"), "asset_investments")).alias("m"))
    assets = assets.select(*keep, parse_entries(F.get_json_object("m", "$.map")).alias("m"))
    moves = assets.select(*keep, F.explode(elements(F.col("m"), "strategy_investments")).alias("m"))
    moves = moves.select(*keep, parse_entries(F.get_json_object("m", "$.map")).alias("m"))
    invest = moves.select(
        *keep, F.get_json_object(_first(F.col("m"), ["strategy"]), "$.address").alias("strategy"), i128(_first(F.col("m"), ["amount"])).alias("amount")
    )
    present = lambda f: F.filter(F.transform("args", f), lambda x: x.isNotNull())
    nth = lambda arr, n: F.try_element_at(arr, F.lit(n))
    address = lambda v: F.get_json_object(v, "$.address")
    swaps = base.where(F.col("kind").isin("swap_exact_in", "swap_exact_out")).select(*keep, elements(F.col("e"), "swap_args").alias("args"))
    swaps = swaps.select(
        *keep, present(i128).alias("n"), present(address).alias("a"), nth(present(parse_vec), 1).alias("p"),
        nth(present(lambda v: F.get_json_object(v, "$.u64")), 1).cast("bigint").alias("deadline"),
    )
    given = F.col("kind") == "swap_exact_in"
    first, second = nth(F.col("n"), 1), nth(F.col("n"), 2)
    swaps = swaps.select(
        *keep, first.alias("amount"), nth(F.col("a"), 1).alias("asset_in"), nth(F.col("a"), 2).alias("asset_out"),
        F.when(given, first).otherwise(second).alias("amount_in"), F.when(given, second).otherwise(first).alias("amount_out"),
        F.array_join(F.transform("p", address), ",").alias("path"), "deadline",
    )
    return unwind.unionByName(invest).unionByName(swaps, allowMissingColumns=True)


def rebalance_log(L: Ledger) -> DataFrame:
    return rebalance(vault_topic_events(L, "unwind", "invest", "swap_exact"))


# -- T5, T6 ------------------------------------------------------------------------------------
def _flow_numbers(L: Ledger) -> DataFrame:
    ev = vault_topic_events(L, "withdraw", "deposit")
    staged = ev.select("transaction_hash", "contract_id", "closed_at", "topics_decoded", parse_typed(F.col("data_decoded")).alias("e"))
    e = F.col("e")
    one = lambda arr: F.try_element_at(arr, F.lit(1))
    funds0 = parse_typed(one(one(F.transform(
        F.filter(e, lambda x: x.getField("key").getField("symbol") == SYM_FUNDS_BEFORE), lambda x: x.getField("val").getField("vec")
    ))))
    kind = F.when(F.col("topics_decoded").like("%withdraw%"), F.lit("withdraw")).otherwise(F.lit("deposit"))
    return staged.select(
        F.col("transaction_hash").alias("tx_hash"),
        F.col("contract_id").alias("vault"),
        "closed_at",
        kind.alias("event"),
        i128(one(typed_vecs(e, [SYM_AMOUNTS, SYM_AMOUNTS_WITHDRAWN]))).alias("amount"),
        F.array_min(F.transform(typed_vecs(e, [SYM_AMOUNTS, SYM_AMOUNTS_WITHDRAWN]), i128)).alias("least_amount"),
        one(typed_i128s(e, [SYM_MINTED, SYM_BURNED])).alias("shares"),
        one(typed_i128s(e, SYM_SUPPLY_BEFORE)).alias("supply"),
        one(typed_i128s(funds0, SYM_TOTAL_AMOUNT)).alias("funds"),
    )


def share_price(L: Ledger) -> DataFrame:
    """Price of one vault share before each deposit/withdrawal: managed funds / share supply."""
    f = _flow_numbers(L).where(F.col("supply") > 0)
    return f.select(
        "tx_hash", "vault", "closed_at", "event",
        F.round(F.col("funds").cast("double") / F.col("supply").cast("double"), 9).alias("share_price"),
    )


MINIMUM_LIQUIDITY = 1000  # units of the first deposit that stay locked


def share_reconcile(L: Ledger) -> DataFrame:
    """Events that do not follow the share rules.  A deposit mints floor(amount x supply / funds)
    shares, or the least amount less MINIMUM_LIQUIDITY units while there is no supply; a withdrawal
    pays floor(funds x shares / supply), nothing without a supply.  Events whose numbers are missing or
    whose expectation has no value (shares of no funds) are shown too."""
    f = _flow_numbers(L).where(F.col("funds").isNotNull())
    empty, deposit = F.col("supply") == 0, F.col("event") == "deposit"
    first = subtract(F.col("least_amount"), from_units(F.lit(MINIMUM_LIQUIDITY).cast(UNITS)))
    minted = F.when(empty, first).otherwise(floor_share(F.col("amount"), F.col("supply"), F.col("funds")))
    paid = F.when(empty, F.lit(0).cast(DEC)).otherwise(floor_share(F.col("funds"), F.col("shares"), F.col("supply")))
    f = f.select(
        "tx_hash", "vault", "closed_at", "event", "amount", "shares",
        F.when(deposit, minted).alias("expected_shares"), F.when(~deposit, paid).alias("expected_amount"),
    )
    kept = F.when(deposit, F.col("shares") == F.col("expected_shares")).otherwise(F.col("amount") == F.col("expected_amount"))
    return f.where(~F.coalesce(kept, F.lit(False)))


# -- T7 ----------------------------------------------------------------------------------------
def fee_split(L: Ledger, vault_fee_bps: int = 1000, protocol_fee_bps: int = 500) -> DataFrame:
    """Split of each latest locked fee between vault and protocol in proportion to their rates
    (protocol part rounded down to the unit, the vault gets the rest); exact whole numbers."""
    total = vault_fee_bps + protocol_fee_bps
    bps = F.lit(protocol_fee_bps).cast(UNITS)

    def part(u):
        whole, rest = divided(u, total)
        return plus(times(whole, bps), divided(times(rest, bps), total)[0])

    protocol = from_units(let(to_units(F.col("locked_fee")), part))
    return locked_fees(L).select(
        "vault", "strategy_address", "locked_fee",
        subtract(F.col("locked_fee"), protocol).alias("vault_share"), protocol.alias("protocol_share"),
    )


# -- T8 ----------------------------------------------------------------------------------------
def report_deltas(L: Ledger) -> DataFrame:
    """Change of each strategy report's balance against the previous report of the same
    (vault, strategy).  Cuts, rows and edges of the ordered operator read the reports, which are decoded once
    and kept on the executors' disks."""
    r = L.kept("report_pivot", lambda: report_pivot(L))
    order = ["closed_at", "ledger_sequence", "locked_fee", "gains_or_losses", "prev_balance"]
    p = lag_by_key(r, ["vault", "strategy_address"], order, ["prev_balance"], prefix="last_")
    return p.select(
        "vault", "strategy_address", "closed_at", "ledger_sequence", "prev_balance",
        F.col("last_prev_balance").alias("previous_report_balance"),
        subtract(F.col("prev_balance"), F.col("last_prev_balance")).alias("delta"),
    )


# -- T9 ----------------------------------------------------------------------------------------
def allocations(L: Ledger) -> DataFrame:
    """Per managed-funds entry: total, idle and invested amounts, and one row per strategy allocation
    (one without a strategy for an entry that has none)."""
    ev = vault_topic_events(L, "withdraw", "deposit")
    entries = parse_payload(F.col("data_decoded"))
    elems = F.flatten(F.transform(field_values(entries, SYM_FUNDS_BEFORE), lambda v: F.coalesce(parse_vec(v), F.array().cast("array<string>"))))
    x = ev.select(F.col("transaction_hash").alias("tx_hash"), F.col("contract_id").alias("vault"), "closed_at", F.explode(elems).alias("elem"))
    m = parse_entries(F.get_json_object("elem", "$.map"))
    x = x.select(
        "tx_hash", "vault", "closed_at",
        F.get_json_object(_first(m, ["asset"]), "$.address").alias("asset"),
        i128(_first(m, ["idle_amount"])).alias("idle_amount"),
        i128(_first(m, ["invested_amount"])).alias("invested_amount"),
        i128(_first(m, [SYM_TOTAL_AMOUNT])).alias("total_amount"),
        F.explode_outer(F.coalesce(parse_vec(_first(m, ["strategy_allocations"])), F.array().cast("array<string>"))).alias("alloc"),
    )
    a = parse_entries(F.get_json_object("alloc", "$.map"))
    return x.select(
        "tx_hash", "vault", "closed_at", "asset", "idle_amount", "invested_amount", "total_amount",
        F.get_json_object(_first(a, ["strategy_address"]), "$.address").alias("strategy_address"),
        i128(_first(a, ["amount"])).alias("allocated"),
        F.get_json_object(_first(a, ["paused"]), "$.bool").cast("boolean").alias("paused"),
    )


# -- T10 ---------------------------------------------------------------------------------------
def _pauses(L: Ledger) -> DataFrame:
    """Paused/unpaused events.  They are ordered by time, ledger and transaction; the events of one
    transaction have no order of their own, and a strategy that it pauses and unpauses counts as paused."""
    ev = vault_topic_events(L, "paused")
    entries = parse_payload(F.col("data_decoded"))
    return ev.select(
        F.col("contract_id").alias("vault"),
        F.get_json_object(_first(entries, ["strategy_address"]), "$.address").alias("strategy_address"),
        "closed_at",
        "ledger_sequence",
        F.col("transaction_id").alias("tx_id"),
        topic_kind().alias("kind"),
    ).where(F.col("kind").isin("paused", "unpaused")).withColumn("is_paused", F.col("kind") == "paused")


PAUSE_ORDER = ("ledger_sequence", "tx_id", "is_paused")


def strategy_status(L: Ledger, at: str | None = None) -> DataFrame:
    """Pause state per (vault, strategy) at the time `at` (by default the end of the log): the newest
    paused/unpaused event until then decides."""
    x = _pauses(L)
    if at:
        x = x.where(F.col("closed_at") <= F.lit(at).cast("timestamp_ntz"))
    latest = latest_per_key(x, ["vault", "strategy_address"], ["closed_at", *PAUSE_ORDER], ["kind"])
    return latest.select(
        "vault", "strategy_address", F.col("closed_at").alias("changed_at"),
        F.when(F.col("is_paused"), F.lit("paused")).otherwise(F.lit("active")).alias("status"),
    )


def allocation_status(L: Ledger) -> DataFrame:
    """Every strategy allocation with the strategy's pause state at that moment (active where no event came
    before), beside the flag that the allocation itself carries."""
    a = allocations(L).where(F.col("strategy_address").isNotNull())
    p = _pauses(L).withColumn("changed_at", F.col("closed_at"))
    j = asof_join(a, p, ["vault", "strategy_address"], "closed_at", "closed_at", ["is_paused", "changed_at"], PAUSE_ORDER[:2], cuts_of=L.contract_events)
    return j.select(
        "tx_hash", "vault", "closed_at", "strategy_address", "allocated", F.col("paused").alias("flag"), "changed_at",
        F.when(F.col("is_paused"), F.lit("paused")).otherwise(F.lit("active")).alias("status"),
    )
