"""Analyses over the value-locked series (D18-D22, N3-N6, N8-N10, N14, N16-N18).

The filled daily series has one row per (vault, day): it is bounded by #vaults x #days, is
materialised once per Ledger, and windows per vault over it are bounded by the calendar length.
Protocol-wide anchors (newest day, means, deviations) are scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.config import SYM_FUNDS_BEFORE
from vaultlake.functions.i128 import i128
from vaultlake.functions.payload import field_values, parse_entries, parse_payload, parse_vec
from vaultlake.functions.time import day_bucket
from vaultlake.operators.joins import bounded
from vaultlake.plans.vaults import (
    aggregated_stats,
    asset_contracts,
    filled_dim,
    prices_dim,
    tvl_hours_df,
    usd_value,
    vault_events_level,
    vault_info_dim,
    vault_topic_events,
)
from vaultlake.functions.names import resolve_code
from vaultlake.sources.ledger import Ledger

DEC = "decimal(38,7)"


def _pct(new: Column, old: Column) -> Column:
    return F.round((new.cast("double") - old.cast("double")) / F.nullif(old.cast("double"), F.lit(0.0)) * 100, 6)


def _with_prev(L: Ledger) -> DataFrame:
    w = Window.partitionBy("vault").orderBy("day")
    return filled_dim(L).select("*", F.lag("usd_tvl").over(w).alias("prev_tvl"))


def newest_day(L: Ledger, as_of: str | None = None) -> Column:
    """`CURRENT_DATE` of the documented queries: `as_of` when given, else the newest filled day."""
    if as_of:
        return F.to_date(F.lit(as_of)).cast("timestamp_ntz")
    return filled_dim(L).agg(F.max("day")).scalar()


# -- D18 ---------------------------------------------------------------------------------------
def tvl_change(L: Ledger, as_of: str | None = None) -> DataFrame:
    """Day-over-day USD TVL change on the newest day (or on `as_of`)."""
    d = _with_prev(L)
    return d.where(F.col("day") == newest_day(L, as_of)).select(
        "vault", "vault_name", "day", "usd_tvl", "prev_tvl", _pct(F.col("usd_tvl"), F.col("prev_tvl")).alias("tvl_change_pct")
    )


# -- D19 / N4 ----------------------------------------------------------------------------------
def tvl_growth(L: Ledger, days: int, as_of: str | None = None) -> DataFrame:
    f = filled_dim(L)
    today = newest_day(L, as_of)
    t = f.where(F.col("day") == today).select("vault", F.col("usd_tvl").alias("tvl_today"))
    b = f.where(F.col("day") == today - F.make_dt_interval(days=F.lit(days))).select(
        "vault", F.col("usd_tvl").alias("tvl_before")
    )
    return t.join(b, "vault").select("vault", "tvl_today", "tvl_before", _pct(F.col("tvl_today"), F.col("tvl_before")).alias("growth_pct"))


def tvl_growth_30d(L: Ledger, as_of: str | None = None) -> DataFrame:
    return tvl_growth(L, 30, as_of)


def fastest_growing(L: Ledger, days: int = 7, n: int = 5) -> DataFrame:
    return tvl_growth(L, days).orderBy(F.col("growth_pct").desc_nulls_last(), "vault").limit(n)


# -- D20, N5 -----------------------------------------------------------------------------------
def _newest_rows(L: Ledger) -> DataFrame:
    return filled_dim(L).where(F.col("day") == newest_day(L))


def tvl_by_asset(L: Ledger) -> DataFrame:
    vi = vault_info_dim(L).select("vault", F.col("asset_code").alias("m_code"))
    t = _newest_rows(L).select("vault", "usd_tvl")
    return vi.join(t, "vault").groupBy(F.col("m_code").alias("asset_code")).agg(
        F.countDistinct("vault").alias("num_vaults"), F.sum("usd_tvl").alias("total_tvl")
    ).orderBy(F.col("total_tvl").desc(), "asset_code")


def asset_share(L: Ledger) -> DataFrame:
    g = _newest_rows(L).groupBy("asset_code").agg(F.sum("usd_tvl").alias("total_tvl"))
    total = g.agg(F.sum("total_tvl")).scalar()
    return g.select(
        "asset_code", "total_tvl", F.round(F.col("total_tvl").cast("double") / total.cast("double") * 100, 6).alias("share_pct")
    )


# -- D21 ---------------------------------------------------------------------------------------
def cross_vault(L: Ledger) -> DataFrame:
    vi = vault_info_dim(L).select("vault", "vault_name", "asset_code")
    t = _newest_rows(L).select("vault", "usd_tvl")
    s = aggregated_stats(L).select("vault", "total_accounts", "total_txs")
    j = vi.join(t, "vault").join(s, "vault")
    per = lambda a, b: F.round(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"), 6)
    return j.select(
        "vault", "vault_name", "asset_code", "usd_tvl", "total_accounts",
        per(F.col("usd_tvl"), F.col("total_accounts")).alias("tvl_per_user"),
        per(F.col("total_txs"), F.col("total_accounts")).alias("txs_per_user"),
    )


# -- D22 ---------------------------------------------------------------------------------------
FUNDS_VEC = "struct<vec:array<string>>"


def vault_assets(L: Ledger) -> DataFrame:
    """Multi-asset TVL: every entry of the managed-funds vector (not only the first), daily maximum
    per (vault, asset), valued with the same-day price (pegged codes at 1)."""
    base = vault_topic_events(L, "withdraw", "deposit")
    entries = parse_payload(F.col("data_decoded"))
    elems = F.flatten(
        F.transform(field_values(entries, SYM_FUNDS_BEFORE), lambda v: F.coalesce(parse_vec(v), F.array().cast("array<string>")))
    )
    x = base.select(
        F.col("contract_id").alias("vault"), day_bucket(F.col("closed_at")).alias("day"), F.explode(elems).alias("elem")
    )
    m = parse_entries(F.get_json_object("elem", "$.map"))
    first = lambda sym: F.try_element_at(field_values(m, sym), F.lit(1))
    x = x.select("vault", "day", F.get_json_object(first("asset"), "$.address").alias("asset"), i128(first("total_amount")).alias("tvl"))
    daily = x.groupBy("day", "vault", "asset").agg(F.max("tvl").alias("asset_tvl"))
    assets = L.dim("funds_assets", lambda: daily.select("asset").where(F.col("asset").isNotNull()).distinct())
    codes = asset_contracts(L, assets)
    codes = L.dim("funds_asset_codes", lambda: codes.groupBy("contract_id").agg(F.max("asset_code").alias("code")))
    p = bounded(prices_dim(L), L.cfg.max_broadcast_rows)
    j = daily.join(bounded(codes, L.cfg.max_broadcast_rows), daily["asset"] == codes["contract_id"], "left")
    j = j.join(p, (j["asset"] == p["token"]) & (j["day"] == p["day"]), "left")
    code = resolve_code(F.col("code"))
    pegged = code.isin(list(L.cfg.pegged_codes))
    price = F.when(pegged, F.lit(1).cast(DEC)).otherwise(F.col("price")).cast(DEC)
    return j.where(pegged | F.col("price").isNotNull()).select(
        daily["day"], "vault", "asset", code.alias("asset_code"), "asset_tvl", usd_value(F.col("asset_tvl"), price).alias("usd_tvl")
    )


# -- N3, N14, N16, N17, N18 ----------------------------------------------------------------------
def tvl_volatility(L: Ledger) -> DataFrame:
    d = _with_prev(L).select("vault", (F.col("usd_tvl").cast("double") - F.col("prev_tvl").cast("double")).alias("chg"))
    return d.groupBy("vault").agg(
        F.round(F.stddev_samp("chg"), 6).alias("stddev_daily_change"), F.count("chg").alias("changes")
    )


def tvl_drops(L: Ledger, threshold_pct: float = -20.0) -> DataFrame:
    d = _with_prev(L).select("day", "vault", "prev_tvl", "usd_tvl", _pct(F.col("usd_tvl"), F.col("prev_tvl")).alias("change_pct"))
    return d.where(F.col("change_pct") <= threshold_pct)


def tvl_trend(L: Ledger) -> DataFrame:
    """Least-squares line of USD TVL against days relative to the newest day, per vault: the
    slope is the daily trend, the intercept the fitted value on the newest day."""
    today = F.to_date(newest_day(L))
    f = filled_dim(L).select("vault", F.datediff(F.to_date("day"), today).cast("double").alias("x"), F.col("usd_tvl").cast("double").alias("y"))
    return f.groupBy("vault").agg(
        F.round(F.regr_slope("y", "x"), 6).alias("slope_per_day"),
        F.round(F.regr_intercept("y", "x"), 4).alias("fitted_today"),
        F.count(F.lit(1)).alias("days"),
    )


def tvl_forecast(L: Ledger, days: int = 7, z: float = 1.96) -> DataFrame:
    """The line of `tvl_trend` carried on over the next `days` days, with bounds z standard errors of a
    single new day off (NULL below three days).  One aggregate gives every sum that the line and its
    errors need; the days ahead are made per vault."""
    newest = newest_day(L)
    f = filled_dim(L).select("vault", F.datediff(F.to_date("day"), F.to_date(newest)).cast("double").alias("x"), F.col("usd_tvl").cast("double").alias("y"))
    s = f.groupBy("vault").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"),
    )
    s = s.select("vault", "n", "mx", "my", "sxx", (F.col("sxy") / F.nullif("sxx", F.lit(0.0))).alias("slope"), "sxy", "syy")
    spread = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2)
    s = s.select("*", spread.alias("spread"), F.explode(F.sequence(F.lit(1), F.lit(days))).alias("ahead"))
    off = F.col("ahead") - F.col("mx")
    s = s.select("*", (F.col("my") + F.col("slope") * off).alias("y"), F.sqrt(F.col("spread") * (1 + 1 / F.col("n") + off * off / F.col("sxx"))).alias("err"))
    return s.select(
        "vault", F.date_add(F.to_date(newest_day(L)), F.col("ahead")).cast("timestamp_ntz").alias("day"), F.round("y", 2).alias("forecast"),
        F.round(F.col("y") - z * F.col("err"), 2).alias("low"), F.round(F.col("y") + z * F.col("err"), 2).alias("high"),
    )


def protocol_tvl(L: Ledger) -> DataFrame:
    return filled_dim(L).groupBy("day").agg(F.sum("usd_tvl").alias("total_usd_tvl"), F.count(F.lit(1)).alias("vaults"))


def market_share(L: Ledger) -> DataFrame:
    """Share of each asset in the day's protocol TVL (window per day over the per-asset rows)."""
    g = filled_dim(L).groupBy("day", "asset_code").agg(F.sum("usd_tvl").alias("tvl"))
    day_total = F.sum("tvl").over(Window.partitionBy("day"))
    return g.select("day", "asset_code", "tvl", F.round(F.col("tvl").cast("double") / day_total.cast("double") * 100, 6).alias("share_pct"))


# -- N6, N8, N9, N10 ----------------------------------------------------------------------------
def price_tvl_corr(L: Ledger) -> DataFrame:
    th = L.level("tvl_hours", lambda: tvl_hours_df(L)).where(~F.col("asset_code").isin(list(L.cfg.pegged_codes)))
    return th.groupBy("asset_code").agg(
        F.round(F.corr(F.col("asset_price").cast("double"), F.col("asset_tvl").cast("double")), 6).alias("corr"),
        F.count(F.lit(1)).alias("hours"),
    )


def large_withdrawals(L: Ledger, share: float = 0.001) -> DataFrame:
    ve = vault_events_level(L).where((F.col("event") == "withdraw") & (F.col("total_amount") > 0))
    ratio = F.col("amount").cast("double") / F.col("total_amount").cast("double")
    return ve.where(ratio >= share).select("closed_at", "vault", "to", "amount", "total_amount", "tx_hash", F.round(ratio, 6).alias("share"))


def vault_ranking(L: Ledger) -> DataFrame:
    """Rank of each vault (newest day) by USD TVL, accounts and transactions, and the mean rank."""
    t = _newest_rows(L).select("vault", "usd_tvl")
    s = aggregated_stats(L).select("vault", "total_accounts", "total_txs")
    j = t.join(s, "vault")
    # ranks over the newest day's rows: one row per vault, so the unpartitioned window is bounded by
    # the number of vaults, not by the data
    r = lambda c: F.rank().over(Window.orderBy(F.col(c).desc())).cast("bigint")
    j = j.select("vault", "usd_tvl", "total_accounts", "total_txs", r("usd_tvl").alias("tvl_rank"), r("total_accounts").alias("accounts_rank"), r("total_txs").alias("txs_rank"))
    return j.select("*", F.round((F.col("tvl_rank") + F.col("accounts_rank") + F.col("txs_rank")) / 3.0, 6).alias("mean_rank"))


def vault_outliers(L: Ledger) -> DataFrame:
    """z-score of each vault's newest USD TVL against all vaults."""
    latest = _newest_rows(L).select("vault", F.col("usd_tvl").cast("double").alias("x"))
    mu = latest.agg(F.avg("x")).scalar()
    sd = latest.agg(F.stddev_samp("x")).scalar()
    return latest.select("vault", F.round((F.col("x") - mu) / F.nullif(sd, F.lit(0.0)), 6).alias("z_score"))
