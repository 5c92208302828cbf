"""Strategy track: registry overview, harvest events, fee distributions, locked fees, APY.

Scale notes: the strategy registry is a fixed 10-row table, so broadcasting it is bounded by
construction.  Per-transaction maxima use a window on tx_hash (high cardinality, one shuffle).
Latest report per (vault, strategy) is a partial max-struct aggregate.  The APY endpoints are
conditional aggregates in one groupBy per strategy (partial aggregation absorbs hot strategies);
the value at each endpoint travels inside the min/max struct, so no self-join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.config import (
    APY_ASSETS,
    APY_HORIZONS,
    APY_STRATEGY_PATTERN,
    DAYS_PER_YEAR,
    KEY_VEC,
    MS_PER_DAY,
    STRATEGY_TOPIC,
    SYM_AMOUNT,
    SYM_DISTRIBUTED_FEES,
    SYM_GAINS,
    SYM_LOCKED_FEE,
    SYM_PPS,
    SYM_PREV_BALANCE,
    TOPIC_FEES,
    TOPIC_HARVEST,
)
from vaultlake.functions.i128 import i128
from vaultlake.functions.payload import parse_typed, typed_i128s, typed_vecs
from vaultlake.functions.time import hour_bucket, micros_between
from vaultlake.operators.joins import bounded, semi_join
from vaultlake.operators.latest import latest_per_key
from vaultlake.plans.vaults import report_rows, vault_info_dim, vault_topic_events
from vaultlake.sources.ledger import Ledger

DEC = "decimal(38,7)"


# -- Q9 ----------------------------------------------------------------------------------------
def strategy_table(L: Ledger) -> DataFrame:
    """The published strategy registry (fixed rows)."""
    return L.spark.createDataFrame(
        list(L.cfg.strategies), "strategy_name string, strategy_address string, asset_token string"
    )


def strategy_registry(L: Ledger) -> DataFrame:
    return strategy_table(L).orderBy("asset_token", "strategy_name")


def harvest_topic_events(L: Ledger) -> DataFrame:
    t = F.col("topics_decoded")
    cond = t.like(f"%{STRATEGY_TOPIC}%") & t.like(f"%{TOPIC_HARVEST}%")
    if L.cfg.only_successful:
        cond = cond & F.col("successful")
    return L.contract_events.where(cond)


def strategy_overview(L: Ledger) -> DataFrame:
    """Registry rows with their harvest activity in the event log (count, first, last)."""
    ev = harvest_topic_events(L)
    reg = strategy_table(L)
    ev = ev.join(F.broadcast(reg.select(F.col("strategy_address").alias("contract_id"))), "contract_id", "left_semi")
    stats = ev.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("harvests"),
        F.min("closed_at").alias("first_harvest"),
        F.max("closed_at").alias("last_harvest"),
    )
    j = reg.join(F.broadcast(stats), reg["strategy_address"] == stats["contract_id"], "left")
    return j.select(
        "strategy_name", "strategy_address", "asset_token",
        F.coalesce(F.col("harvests"), F.lit(0).cast("bigint")).alias("harvests"),
        "first_harvest", "last_harvest",
    ).orderBy("asset_token", "strategy_name")


def strategy_subset(L: Ledger) -> DataFrame:
    """The named strategy subset used by the harvest and APY reports (name pattern and asset list),
    with each member's harvest activity in the event log."""
    ov = strategy_overview(L)
    return ov.where(F.col("strategy_name").like(APY_STRATEGY_PATTERN) & F.col("asset_token").isin(list(APY_ASSETS)))


# -- Q10 ---------------------------------------------------------------------------------------
def apy_strategies(L: Ledger) -> DataFrame:
    reg = strategy_table(L)
    return reg.where(F.col("strategy_name").like(APY_STRATEGY_PATTERN) & F.col("asset_token").isin(list(APY_ASSETS))).select(
        F.col("strategy_address").alias("contract_id"), F.col("asset_token").alias("asset"), "strategy_name"
    )


def harvest_base(L: Ledger) -> DataFrame:
    sc = apy_strategies(L)
    ev = harvest_topic_events(L).join(F.broadcast(sc.select("contract_id")), "contract_id", "left_semi")
    staged = ev.select("contract_id", "closed_at", "transaction_hash", parse_typed(F.col("data_decoded")).alias("e"))
    e = F.col("e")
    return staged.select(
        "contract_id",
        "closed_at",
        hour_bucket(F.col("closed_at")).alias("closed_at_hour"),
        F.col("transaction_hash").alias("tx_hash"),
        F.array_max(typed_i128s(e, SYM_AMOUNT)).alias("ev_amount"),
        F.array_max(typed_i128s(e, SYM_PPS)).alias("ev_pps"),
    )


def harvest_fields(L: Ledger) -> DataFrame:
    """Per transaction: largest decoded amount and price per share among its harvests."""
    return harvest_base(L).groupBy("tx_hash").agg(
        F.max("ev_amount").alias("amount"), F.max("ev_pps").alias("price_per_share")
    )


def harvest_events_df(L: Ledger) -> DataFrame:
    """Harvests of the APY strategies; amount and price per share are maxima over the whole
    transaction (several harvests of one transaction share them)."""
    b = harvest_base(L)
    w = Window.partitionBy("tx_hash")
    b = b.select("*", F.max("ev_amount").over(w).alias("amount"), F.max("ev_pps").over(w).alias("price_per_share"))
    sc = F.broadcast(apy_strategies(L))
    j = b.join(sc, "contract_id", "left")
    return j.select(
        F.col("closed_at_hour").alias("hour"),
        F.col("contract_id").alias("strategy_address"),
        "asset",
        "amount",
        "price_per_share",
        F.col("tx_hash").alias("hash"),
        "closed_at",
    )


def harvest_events(L: Ledger) -> DataFrame:
    return harvest_events_df(L)


# -- Q11 ---------------------------------------------------------------------------------------
def fee_tuples(L: Ledger) -> DataFrame:
    """(address, amount) tuples of fee-distribution events, one row per tuple."""
    base = vault_topic_events(L, TOPIC_FEES)
    tuples = base.select(
        F.col("contract_id").alias("vault"),
        "closed_at",
        hour_bucket(F.col("closed_at")).alias("closed_at_hour"),
        F.col("transaction_hash").alias("tx_hash"),
        F.col("transaction_id").alias("tx_id"),
        F.explode(typed_vecs(parse_typed(F.col("data_decoded")), SYM_DISTRIBUTED_FEES)).alias("fee_tuple"),
    )
    return tuples.select(
        "vault", "closed_at", "closed_at_hour", "tx_hash", "tx_id",
        F.get_json_object("fee_tuple", "$.vec[0].address").alias("recipient_address"),
        i128(F.get_json_object("fee_tuple", "$.vec[1]")).alias("fee_amount"),
    )


def fees_distributed(L: Ledger) -> DataFrame:
    """One row per distributed-fee tuple.  The tuple address is reported as `recipient_address`
    (on chain it is the asset the fee is paid in)."""
    t = fee_tuples(L)
    vi = bounded(vault_info_dim(L), L.cfg.max_broadcast_rows)
    j = t.join(vi.select("vault", "vault_name", "asset", "asset_code"), "vault", "left")
    return j.select(
        "closed_at", "closed_at_hour", "vault", "vault_name", "asset", "asset_code",
        "recipient_address", "fee_amount", "tx_hash", "tx_id",
    )


# -- Q12 ---------------------------------------------------------------------------------------
def report_snapshots(L: Ledger) -> DataFrame:
    """Live report snapshots of registered vaults with the strategy from the key."""
    rows = report_rows(L).where(F.col("contract_key_type") == KEY_VEC)  # a report's key is a vector; prunes the other key types
    rows = semi_join(rows, vault_info_dim(L), "contract_id", "vault", L.cfg.max_broadcast_rows)
    return rows.select(
        F.col("contract_id").alias("vault"),
        "closed_at",
        "ledger_sequence",
        F.get_json_object("key_decoded", "$.vec[1].address").alias("strategy_address"),
        "val_decoded",
    )


def report_key(L: Ledger) -> DataFrame:
    return report_snapshots(L).drop("val_decoded")


def _max_field(entries: Column, sym: str) -> Column:
    return F.array_max(typed_i128s(entries, sym))


def _decoded_reports(snaps: DataFrame) -> DataFrame:
    """Report snapshots with the three fields (largest if a symbol repeats); snapshots with an
    empty or unreadable value map are dropped.  One parse per snapshot."""
    staged = snaps.select("*", parse_typed(F.col("val_decoded")).alias("e")).where(F.size("e") > 0)
    e = F.col("e")
    return staged.select(
        "vault", "closed_at", "ledger_sequence", "strategy_address", "val_decoded",
        _max_field(e, SYM_LOCKED_FEE).alias("locked_fee"),
        _max_field(e, SYM_GAINS).alias("gains_or_losses"),
        _max_field(e, SYM_PREV_BALANCE).alias("prev_balance"),
    )


def report_pivot(L: Ledger) -> DataFrame:
    """Per distinct snapshot: locked_fee, gains_or_losses, prev_balance (largest if repeated);
    snapshots with an empty or unreadable value map are dropped.  Few snapshots repeat, so they are dealt out
    by ledger before the distinct (no aggregate of near-unique rows on the map side, as many parts as the data
    need), and only distinct ones are decoded."""
    snaps = report_snapshots(L).repartition(L.parts, "ledger_sequence", "closed_at", "vault").distinct()
    return _decoded_reports(snaps).drop("val_decoded")


def _newest_snapshots(L: Ledger) -> DataFrame:
    """Readable report snapshots at the newest time of their (vault, strategy): a hash aggregate on
    the time, joined back, so that only what is left is decoded and compared further."""
    rows = report_snapshots(L)
    readable = rows.select("vault", "strategy_address", "closed_at", parse_typed(F.col("val_decoded")).alias("e")).where(F.size("e") > 0)
    top = readable.groupBy("vault", "strategy_address").agg(F.max("closed_at").alias("top"))
    top = top.select(F.col("vault").alias("v"), F.col("strategy_address").alias("s"), "top")
    same = F.col("vault").eqNullSafe(F.col("v")) & F.col("strategy_address").eqNullSafe(F.col("s")) & F.col("closed_at").eqNullSafe(F.col("top"))
    return rows.join(top, same, "left_semi")


def locked_fees(L: Ledger) -> DataFrame:
    """Latest live report per (vault, strategy): newest time, then highest ledger, then values."""
    snaps = _decoded_reports(_newest_snapshots(L)).drop("val_decoded")
    latest = latest_per_key(
        snaps, ["vault", "strategy_address"], ["closed_at", "ledger_sequence"],
        ["locked_fee", "gains_or_losses", "prev_balance"],
    )
    vi = bounded(vault_info_dim(L), L.cfg.max_broadcast_rows)
    j = latest.join(vi.select("vault", "vault_name", "asset", "asset_code"), "vault", "left")
    return j.select(
        "closed_at", "ledger_sequence", "vault", "vault_name", "asset", "asset_code",
        "strategy_address", "locked_fee", "gains_or_losses", "prev_balance",
    )


# -- Q13 ---------------------------------------------------------------------------------------
def apy(start: Column, end: Column, t0: Column, t1: Column) -> Column:
    """((end/start)^(days_per_year * ms_per_day / elapsed_ms) - 1) * 100 as DECIMAL(38,2); the ratio
    is rounded to 7 places first, as a DECIMAL(38,7) quotient would be."""
    elapsed_ms = micros_between(t0, t1) / 1000.0
    ratio = F.round(end.cast("double") / start.cast("double"), 7)
    value = ((F.pow(ratio, F.lit(DAYS_PER_YEAR * MS_PER_DAY) / elapsed_ms) - 1) * 100).try_cast("decimal(38,2)")
    ok = start.isNotNull() & end.isNotNull() & (start > 0) & (t1 > t0)
    return F.when(ok, F.round(value, 2))


def strategy_endpoints(L: Ledger) -> DataFrame:
    """Per APY strategy and horizon (ending at the newest harvest of all strategies): first and last
    harvest time, the price per share at each (largest on equal times) and the harvest count."""
    h = L.level("harvest_events", lambda: harvest_events_df(L))
    h = h.where(F.col("price_per_share").isNotNull() & (F.col("price_per_share") > 0)).select(
        F.col("strategy_address").alias("contract_id"), "closed_at", F.col("price_per_share").alias("pps")
    )
    # the anchor is one scalar subquery, attached once as a column and read by every horizon
    h = h.withColumn("__now", h.agg(F.max("closed_at")).scalar())
    aggs = []
    for suffix, secs in APY_HORIZONS:
        inside = F.col("closed_at") >= F.col("__now") - F.make_dt_interval(secs=F.lit(secs).cast("decimal(18,6)"))
        aggs += [
            F.min(F.when(inside, F.struct(F.col("closed_at").alias("t"), (-F.col("pps")).alias("neg_pps")))).alias(f"f_{suffix}"),
            F.max(F.when(inside, F.struct(F.col("closed_at").alias("t"), F.col("pps").alias("pps")))).alias(f"l_{suffix}"),
            F.count(F.when(inside, F.lit(1))).alias(f"count_{suffix}"),
        ]
    per = h.groupBy("contract_id").agg(*aggs)
    sl = apy_strategies(L).select("contract_id", "asset")
    # the registry is a fixed list, and `per` has one row for each of its strategies at most
    per = per.join(F.broadcast(sl.select("contract_id")), "contract_id", "left_semi")
    j = sl.join(F.broadcast(per), "contract_id", "left")
    cols = [F.col("asset"), F.col("contract_id")]
    for suffix, _ in APY_HORIZONS:
        cols += [
            F.coalesce(F.col(f"count_{suffix}"), F.lit(0).cast("bigint")).alias(f"events_{suffix}"),
            (-F.col(f"f_{suffix}.neg_pps")).cast(DEC).alias(f"pps_{suffix}_start"),
            F.col(f"l_{suffix}.pps").cast(DEC).alias(f"pps_{suffix}_end"),
            F.col(f"f_{suffix}.t").alias(f"first_time_{suffix}"),
            F.col(f"l_{suffix}.t").alias(f"last_time_{suffix}"),
        ]
    return j.select(*cols)


def strategy_apy(L: Ledger) -> DataFrame:
    e = strategy_endpoints(L)
    apys = [
        apy(F.col(f"pps_{s}_start"), F.col(f"pps_{s}_end"), F.col(f"first_time_{s}"), F.col(f"last_time_{s}")).alias(f"apy_{s}")
        for s, _ in APY_HORIZONS
    ]
    rest = []
    for s, _ in APY_HORIZONS:
        rest += [f"pps_{s}_start", f"pps_{s}_end", f"first_time_{s}", f"last_time_{s}"]
    return e.select(
        "asset", "contract_id", *apys, *[f"events_{s}" for s, _ in APY_HORIZONS], *rest
    ).orderBy("asset", "contract_id")


def trailing_endpoints(L: Ledger) -> DataFrame:
    cols = ["asset", "contract_id"]
    for s, _ in APY_HORIZONS:
        cols += [f"first_time_{s}", f"last_time_{s}", f"events_{s}"]
    return strategy_endpoints(L).select(*cols)


def pps_at_endpoints(L: Ledger) -> DataFrame:
    cols = ["asset", "contract_id"]
    for s, _ in APY_HORIZONS:
        cols += [f"pps_{s}_start", f"pps_{s}_end"]
    return strategy_endpoints(L).select(*cols)
