"""Building blocks of the dashboard queries, exposed as their own keys so each step is checked
on its own (scans, decoders, latest-per-key forms, bucketing, price join, grid, fill)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.config import KEY_INSTANCE, TOPIC_DEPOSIT, TOPIC_FEES, TOPIC_WITHDRAW
from vaultlake.functions.payload import parse_payload
from vaultlake.operators.joins import semi_join
from vaultlake.plans import vaults as V
from vaultlake.plans.activity import within
from vaultlake.plans.audit import _flow_numbers
from vaultlake.sources.ledger import Ledger


def scan_state(L: Ledger) -> DataFrame:
    inst = L.contract_data.where(F.col("contract_key_type") == KEY_INSTANCE)
    inst = semi_join(inst, V.registry_dim(L), "contract_id", "vault", L.cfg.max_broadcast_rows)
    return inst.select("contract_id", "closed_at", "ledger_sequence")


def scan_events(L: Ledger, days: int | None = None, as_of: str | None = None) -> DataFrame:
    """Vault events, of the last `days` days if given."""
    ev = V.vault_topic_events(L, TOPIC_WITHDRAW, TOPIC_DEPOSIT)
    if days is not None:
        ev = within(ev, days, as_of, of=L.contract_events)
    return ev.select("contract_id", "closed_at", "transaction_hash")


def scan_transactions(L: Ledger, days: int = 30, as_of: str | None = None) -> DataFrame:
    return within(L.transactions, days, as_of).where("successful").select(
        "id", "account", "fee_charged", "closed_at"
    )


def decode_i128(L: Ledger) -> DataFrame:
    return _flow_numbers(L).drop("event", "least_amount")


def payload_fields(L: Ledger) -> DataFrame:
    ev = V.vault_topic_events(L, TOPIC_WITHDRAW, TOPIC_DEPOSIT)
    e = ev.select("transaction_hash", "closed_at", F.explode(parse_payload(F.col("data_decoded"))).alias("e"))
    return e.select("transaction_hash", "closed_at", F.col("e.key.symbol").alias("symbol"))


def latest_snapshot(L: Ledger) -> DataFrame:
    return V.latest_instances(L).select("vault", "closed_at", "ledger_sequence")


def latest_snapshot_ties(L: Ledger) -> DataFrame:
    return V.asset_contracts(L, V.contract_metadata(L).select("asset"))


def contract_metadata(L: Ledger) -> DataFrame:
    return V.contract_metadata(L)


def asset_code_resolve(L: Ledger) -> DataFrame:
    return V.vault_info_dim(L).select("vault", "asset", "asset_code")


def vault_display_name(L: Ledger) -> DataFrame:
    return V.vault_info_dim(L).select("vault", "vault_name")


def topic_filter(L: Ledger) -> DataFrame:
    return V.vault_topic_events(L, TOPIC_FEES).select("contract_id", "closed_at", "transaction_hash")


def event_classify(L: Ledger) -> DataFrame:
    return V.vault_topic_events(L, TOPIC_WITHDRAW, TOPIC_DEPOSIT).select(
        "transaction_hash", "closed_at", V.event_kind().alias("event")
    )


def registry_semi_join(L: Ledger) -> DataFrame:
    ev = semi_join(L.contract_events, V.registry_vaults(L), "contract_id", "vault", L.cfg.max_broadcast_rows)
    return ev.select("contract_id", "closed_at", "transaction_hash")


def _per_tx(L: Ledger) -> DataFrame:
    return V.flow_event_fields(L).groupBy("vault", "tx_hash").agg(
        F.max("ev_to").alias("to"), F.sum("ev_amount").alias("amount")
    )


def event_account(L: Ledger) -> DataFrame:
    return _per_tx(L).select("vault", "tx_hash", "to")


def event_amount_sum(L: Ledger) -> DataFrame:
    return _per_tx(L).select("vault", "tx_hash", "amount")


def event_tvl(L: Ledger) -> DataFrame:
    return V.flow_event_fields(L).select("vault", "tx_hash", "closed_at", F.explode("tvl_vals").alias("total_amount"))


def hourly_max(L: Ledger) -> DataFrame:
    return V.hourly_max(L)


def dedup_prices(L: Ledger) -> DataFrame:
    return V.dedup_prices(L)


def price_join(L: Ledger) -> DataFrame:
    return V.tvl_hours_df(L).select("hour", "vault", "asset", "asset_code", "asset_price")


def usd_value(L: Ledger) -> DataFrame:
    return V.tvl_hours_df(L).select("hour", "vault", "usd_tvl")


def daily_max(L: Ledger) -> DataFrame:
    return V.daily_max_df(L)


def nonzero_keys(L: Ledger) -> DataFrame:
    return V.nonzero_keys(L)


def calendar(L: Ledger) -> DataFrame:
    d = V.daily_dim(L)
    return d.limit(1).select(F.explode(V.calendar(d)).alias("day"))


def dense_grid(L: Ledger) -> DataFrame:
    return V.dense_grid(L)


def grid_join(L: Ledger) -> DataFrame:
    return V.grid_join(L)


def fill_groups(L: Ledger) -> DataFrame:
    w = Window.partitionBy("vault").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return V.grid_join(L).select("day", "vault", F.count("asset_tvl").over(w).alias("grp"))


def forward_fill(L: Ledger) -> DataFrame:
    f = V.forward_fill(V.grid_join(L), "vault", "day", "asset_tvl", ["usd_tvl"])
    return f.select("day", "vault", "asset_tvl", "usd_tvl")
