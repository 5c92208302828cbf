"""Vault chain: registry -> metadata -> deposit/withdraw log -> hourly TVL -> filled daily TVL
-> latest per vault -> headline total; account totals; report-structure sample.

Plan notes (scale):
* every dimension (registry, metadata, prices, daily series) is bounded by #vaults x #days and is
  persisted and counted (the daily series also checkpointed), and broadcast only within the limits on
  rows and bytes;
* the event log is read once per query, filtered by topic and by a broadcast semi-join on the
  registry, decoded with higher-order functions (no explode before the per-transaction rule); the
  per-transaction rules need no shuffle where the log is bucketed on the transaction hash;
* "latest per key" is a partial aggregate (operators.latest), never a window over a hot key;
* global anchors (first/last day, overall totals) are scalar subqueries, not cross joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.config import (
    FACTORY_CONTRACT,
    KEY_INSTANCE,
    KEY_VEC,
    REPORT_KEY_WORD,
    SYM_AMOUNTS,
    SYM_AMOUNTS_WITHDRAWN,
    SYM_DEPOSITOR,
    SYM_FUNDS_BEFORE,
    SYM_TOTAL_AMOUNT,
    SYM_WITHDRAWER,
    TOPIC_DEPOSIT,
    TOPIC_WITHDRAW,
)
from vaultlake.functions.decimals import multiply
from vaultlake.functions.i128 import i128
from vaultlake.functions.names import display_name, native_code, resolve_code
from vaultlake.functions.payload import (
    parse_typed,
    sum_skip_nulls,
    typed_addresses,
    typed_i128s,
    typed_vecs,
)
from vaultlake.functions.time import day_bucket, hour_bucket
from vaultlake.operators.joins import bounded, keep_rows, semi_join
from vaultlake.operators.latest import latest_per_key, latest_with_ties
from vaultlake.sources.ledger import Ledger

DEC = "decimal(38,7)"


def empty_array(elem_type: str) -> F.Column:
    return F.array().cast(f"array<{elem_type}>")

INSTANCE_NAME = "$.contract_instance.storage[0].val.map[1].val.string"
INSTANCE_SYMBOL = "$.contract_instance.storage[0].val.map[2].val.string"
INSTANCE_ASSET = "$.contract_instance.storage[1].val.map[0].val.address"


# -- Q1 ----------------------------------------------------------------------------------------
def registry_entries(L: Ledger) -> DataFrame:
    return L.contract_data.where(
        (F.col("contract_id") == FACTORY_CONTRACT) & (F.col("contract_key_type") == KEY_VEC)
    ).select("closed_at", F.get_json_object("val_decoded", "$.address").alias("vault"))


def vault_registry(L: Ledger) -> DataFrame:
    """Vault addresses listed by the factory, oldest first."""
    return registry_entries(L).orderBy("closed_at", "vault")


def registry_dim(L: Ledger) -> DataFrame:
    return L.dim("registry", lambda: registry_entries(L).select("vault").where(F.col("vault").isNotNull()).distinct())


# -- Q2 ----------------------------------------------------------------------------------------
def latest_instances(L: Ledger) -> DataFrame:
    """Newest instance snapshot per registered vault (ties on time broken by ledger, then value)."""
    inst = L.contract_data.where(F.col("contract_key_type") == KEY_INSTANCE)
    inst = semi_join(inst, registry_dim(L), "contract_id", "vault", L.cfg.max_broadcast_rows)
    return latest_per_key(inst, ["contract_id"], ["closed_at", "ledger_sequence"], ["val_decoded"]).withColumnRenamed(
        "contract_id", "vault"
    )


def contract_metadata(L: Ledger) -> DataFrame:
    """Name, symbol and first asset read by position from the newest vault instance."""
    latest = latest_instances(L)
    return latest.select(
        "vault",
        F.get_json_object("val_decoded", INSTANCE_NAME).alias("name"),
        F.get_json_object("val_decoded", INSTANCE_SYMBOL).alias("symbol"),
        F.get_json_object("val_decoded", INSTANCE_ASSET).alias("asset"),
    )


def asset_contracts(L: Ledger, assets: DataFrame) -> DataFrame:
    """Asset code of each asset contract at its highest ledger (all tied rows kept)."""
    inst = L.contract_data.where(F.col("contract_key_type") == KEY_INSTANCE).select(
        "contract_id", "ledger_sequence", "asset_code"
    )
    inst = semi_join(inst, assets, "contract_id", "asset", L.cfg.max_broadcast_rows)
    top = latest_with_ties(inst, ["contract_id"], "ledger_sequence")
    return top.select("contract_id", native_code(F.col("asset_code"), F.col("contract_id")).alias("asset_code"))


def vault_info_df(L: Ledger) -> DataFrame:
    meta = L.dim("metadata", lambda: contract_metadata(L))
    codes = asset_contracts(L, meta.select("asset"))
    j = meta.join(codes, meta["asset"] == codes["contract_id"], "left")
    return j.select(
        "vault",
        display_name(F.col("name"), F.col("vault"), L.cfg.name_prefix).alias("vault_name"),
        F.col("symbol").alias("vault_symbol"),
        "asset",
        resolve_code(codes["asset_code"]).alias("asset_code"),
    )


def vault_info_dim(L: Ledger) -> DataFrame:
    return L.dim("vault_info", lambda: vault_info_df(L))


def vault_info(L: Ledger) -> DataFrame:
    return vault_info_dim(L).orderBy("vault")


# -- Q3 ----------------------------------------------------------------------------------------
def vault_topic_events(L: Ledger, *words_any: str) -> DataFrame:
    """Events of registered vaults whose topics name the vault contract and any of `words_any`."""
    t = F.col("topics_decoded")
    cond = t.like(f"%{L.cfg.vault_topic}%")
    if words_any:
        any_word = None
        for w in words_any:
            c = t.like(f"%{w}%")
            any_word = c if any_word is None else (any_word | c)
        cond = cond & any_word
    if L.cfg.only_successful:
        cond = cond & F.col("successful")
    ev = L.contract_events.where(cond)
    return semi_join(ev, registry_vaults(L), "contract_id", "vault", L.cfg.max_broadcast_rows)


def registry_vaults(L: Ledger) -> DataFrame:
    dim = vault_info_dim(L)
    return keep_rows(dim.select("vault"), dim)


def event_kind() -> F.Column:
    t = F.col("topics_decoded")
    return F.when(t.like(f"%{TOPIC_WITHDRAW}%"), F.lit("withdraw")).when(t.like(f"%{TOPIC_DEPOSIT}%"), F.lit("deposit"))


def first_funds_totals(entries: F.Column) -> F.Column:
    """`total_amount` values of the first managed-funds entry of each funds vector."""
    return F.flatten(
        F.transform(
            _matching_funds(entries),
            lambda f: F.coalesce(
                typed_i128s(parse_typed(F.try_element_at(f.getField("val").getField("vec"), F.lit(1))), SYM_TOTAL_AMOUNT),
                empty_array(DEC),
            ),
        )
    )


def _matching_funds(entries: F.Column) -> F.Column:
    return F.filter(entries, lambda e: e.getField("key").getField("symbol") == SYM_FUNDS_BEFORE)


def flow_event_fields(L: Ledger) -> DataFrame:
    """Deposit/withdraw events, one row each, with the per-event decoded fields (the payload is
    parsed once, in its own projection, and every field is read from that parse)."""
    base = vault_topic_events(L, TOPIC_WITHDRAW, TOPIC_DEPOSIT)
    staged = base.select(
        "contract_id", "closed_at", "transaction_hash", "transaction_id", "topics_decoded",
        parse_typed(F.col("data_decoded")).alias("e"),
    )
    e = F.col("e")
    return staged.select(
        F.col("contract_id").alias("vault"),
        "closed_at",
        hour_bucket(F.col("closed_at")).alias("closed_at_hour"),
        F.col("transaction_hash").alias("tx_hash"),
        F.col("transaction_id").alias("tx_id"),
        event_kind().alias("event"),
        F.array_max(typed_addresses(e, [SYM_DEPOSITOR, SYM_WITHDRAWER])).alias("ev_to"),
        sum_skip_nulls(F.transform(typed_vecs(e, [SYM_AMOUNTS, SYM_AMOUNTS_WITHDRAWN]), i128)).alias("ev_amount"),
        first_funds_totals(e).alias("tvl_vals"),
    )


VAULT_EVENT_COLUMNS = [
    "closed_at",
    "vault",
    "vault_name",
    "asset",
    "asset_code",
    "event",
    "to",
    "amount",
    "total_amount",
    "closed_at_hour",
    "tx_hash",
]


def vault_events_df(L: Ledger) -> DataFrame:
    """Deposit/withdraw log.  User and amount are taken per (vault, transaction): several events of
    one transaction on one vault each show the summed amount and the largest address.  Only events
    whose first managed-funds entry holds `total_amount` are kept; that value is the TVL column."""
    ev = flow_event_fields(L)
    w = Window.partitionBy("vault", "tx_hash")
    ev = ev.select(
        "*", F.max("ev_to").over(w).alias("to"), F.sum("ev_amount").over(w).alias("amount")
    ).select(
        "vault", "closed_at", "closed_at_hour", "tx_hash", "tx_id", "event", "to", "amount",
        F.explode("tvl_vals").alias("total_amount"),
    )
    vi = bounded(vault_info_dim(L), L.cfg.max_broadcast_rows)
    j = ev.join(vi.select("vault", "vault_name", "asset", "asset_code"), "vault", "left")
    return j.distinct().select(*VAULT_EVENT_COLUMNS)


def vault_events(L: Ledger) -> DataFrame:
    return vault_events_df(L)


# -- Q4 ----------------------------------------------------------------------------------------
def dedup_prices(L: Ledger) -> DataFrame:
    """One price per (token, day); of duplicate rows the highest price is kept."""
    return L.prices.groupBy(F.col("contract_id").alias("token"), F.col("closed_at_day").alias("day")).agg(
        F.max("price").alias("price")
    )


def prices_dim(L: Ledger) -> DataFrame:
    return L.dim("prices", lambda: dedup_prices(L))


def vault_events_level(L: Ledger) -> DataFrame:
    return L.level("vault_events", lambda: vault_events_df(L))


def hourly_max(L: Ledger) -> DataFrame:
    ve = vault_events_level(L)
    return ve.groupBy(
        "vault", "vault_name", "asset", "asset_code", hour_bucket(F.col("closed_at")).alias("hour")
    ).agg(F.max("total_amount").alias("asset_tvl"))


def usd_value(amount: F.Column, price: F.Column) -> F.Column:
    """amount x price rounded once to 7 places."""
    return multiply(amount, price)


def tvl_hours_df(L: Ledger) -> DataFrame:
    e = hourly_max(L)
    p = bounded(prices_dim(L), L.cfg.max_broadcast_rows)
    j = e.join(p, (e["asset"] == p["token"]) & (day_bucket(e["hour"]) == p["day"]), "left")
    pegged = F.col("asset_code").isin(list(L.cfg.pegged_codes))
    j = j.where(pegged | F.col("price").isNotNull())
    price = F.when(pegged, F.lit(1).cast(DEC)).otherwise(F.col("price")).cast(DEC)
    return j.select(
        "hour", "vault", "vault_name", "asset", "asset_code", "asset_tvl",
        price.alias("asset_price"),
        usd_value(F.col("asset_tvl"), price).alias("usd_tvl"),
    )


def tvl_hours(L: Ledger) -> DataFrame:
    return tvl_hours_df(L)


# -- Q5 ----------------------------------------------------------------------------------------
def daily_max_df(L: Ledger) -> DataFrame:
    th = L.level("tvl_hours", lambda: tvl_hours_df(L))
    return th.groupBy(
        day_bucket(F.col("hour")).alias("day"), "vault", "vault_name", "asset", "asset_code"
    ).agg(F.max("asset_tvl").alias("asset_tvl"), F.max("usd_tvl").alias("usd_tvl"))


def daily_dim(L: Ledger) -> DataFrame:
    """Daily maxima: at most #vaults x #days rows, materialised once."""
    return L.dim("daily", lambda: daily_max_df(L), durable=True)


def nonzero_keys(L: Ledger) -> DataFrame:
    return daily_dim(L).where(F.col("asset_tvl") > 0).select("vault", "vault_name", "asset", "asset_code").distinct()


def calendar(daily: DataFrame, col: str = "day") -> F.Column:
    """All days between the first and the last day present, as an array column (scalar subqueries)."""
    lo = daily.agg(F.min(col)).scalar()
    hi = daily.agg(F.max(col)).scalar()
    return F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))


def dense_grid(L: Ledger) -> DataFrame:
    """day x vault for vaults that were ever non-zero: generated per vault row, no join."""
    daily = daily_dim(L)
    return nonzero_keys(L).select(F.explode(calendar(daily)).alias("day"), "vault", "vault_name", "asset", "asset_code")


def grid_join(L: Ledger) -> DataFrame:
    d = daily_dim(L).select("day", "vault", "asset_tvl", "usd_tvl")
    return dense_grid(L).join(d, ["day", "vault"], "left")


def forward_fill(df: DataFrame, key: str, order: str, lead_col: str, carried: list[str]) -> DataFrame:
    """Carry the last row where `lead_col` is present forward (with `carried` columns taken from that
    same row); one window, one sort."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = F.when(F.col(lead_col).isNotNull(), F.struct(*[F.col(c) for c in [lead_col, *carried]]))
    f = F.last(packed, ignorenulls=True).over(w)
    others = [c for c in df.columns if c not in [lead_col, *carried]]
    return df.select(*others, *[f.getField(c).alias(c) for c in [lead_col, *carried]])


def tvl_days_filled_df(L: Ledger) -> DataFrame:
    filled = forward_fill(grid_join(L), "vault", "day", "asset_tvl", ["usd_tvl"])
    return filled.where(F.col("asset_tvl").isNotNull()).select(
        "day", "vault", "vault_name", "asset", "asset_code",
        F.col("asset_tvl").cast(DEC).alias("asset_tvl"), F.col("usd_tvl").cast(DEC).alias("usd_tvl"),
    )


def filled_dim(L: Ledger) -> DataFrame:
    return L.dim("filled", lambda: L.level("tvl_days_filled", lambda: tvl_days_filled_df(L)))


def tvl_days_filled(L: Ledger) -> DataFrame:
    return tvl_days_filled_df(L)


# -- Q6, Q7 ------------------------------------------------------------------------------------
def latest_vaults_df(L: Ledger) -> DataFrame:
    f = filled_dim(L)
    latest = latest_per_key(f, ["vault"], ["day"], ["vault_name", "asset", "asset_code", "asset_tvl", "usd_tvl"])
    return latest.select(
        F.col("day").alias("latest_day"), "vault", "vault_name", "asset", "asset_code", "asset_tvl", "usd_tvl"
    )


def latest_vaults(L: Ledger) -> DataFrame:
    return latest_vaults_df(L).orderBy(F.col("usd_tvl").desc(), "vault")


def latest_usd_tvl(L: Ledger) -> DataFrame:
    return latest_vaults_df(L).agg(F.sum("usd_tvl").alias("total_usd_tvl"))


# -- Q8 ----------------------------------------------------------------------------------------
def aggregated_stats(L: Ledger) -> DataFrame:
    """Distinct accounts and transactions per vault, with the protocol-wide distinct counts beside
    them.  One pass: grouping sets ((vault, vault_name), ()) over the event log."""
    def build() -> DataFrame:
        ve = vault_events_level(L).select("vault", "vault_name", F.col("to").alias("account"), "tx_hash")
        return ve.groupingSets([["vault", "vault_name"], []], "vault", "vault_name").agg(
            F.countDistinct("account").alias("total_accounts"),
            F.countDistinct("tx_hash").alias("total_txs"),
            F.grouping_id().alias("gid"),
        )

    sets = L.dim("agg_stats", build, durable=True)
    per_vault = sets.where(F.col("gid") == 0)
    overall = sets.where(F.col("gid") != 0)
    return per_vault.select(
        "vault",
        "vault_name",
        "total_accounts",
        "total_txs",
        overall.agg(F.max("total_accounts")).scalar().alias("total_accounts_all"),
        overall.agg(F.max("total_txs")).scalar().alias("total_txs_all"),
    ).orderBy(F.col("total_accounts").desc(), "vault")


# -- Q14 ---------------------------------------------------------------------------------------
def report_rows(L: Ledger) -> DataFrame:
    return L.contract_data.where(
        F.col("key_decoded").like(f"%{REPORT_KEY_WORD}%") & (F.col("deleted") == F.lit(False))
    )


def explore_reports(L: Ledger, n_vaults: int = 5, n_rows: int = 10) -> DataFrame:
    """Newest report rows of the first vaults (by address): a structure sample; the limits are the
    feature."""
    first = L.dim(f"first_vaults_{n_vaults}", lambda: vault_info_dim(L).select("vault").orderBy("vault").limit(n_vaults))
    rows = semi_join(report_rows(L), first, "contract_id", "vault", n_vaults)
    return (
        rows.select(
            F.col("contract_id").alias("vault"), "closed_at", "ledger_sequence", "contract_key_type",
            "key_decoded", "val_decoded", "last_modified_ledger",
        )
        .orderBy(F.col("closed_at").desc(), F.col("ledger_sequence").desc(), "vault", "key_decoded", "val_decoded")
        .limit(n_rows)
    )
