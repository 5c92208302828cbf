"""Documented ad-hoc analyses over events, transactions and the vault log (D1-D17, N1-N2, N7,
N11-N13, N15, N19-N22).

"Now" is never the wall clock: `as_of` defaults to the newest day in the data (a scalar
subquery), so results are repeatable.  Time windows also bound `closed_at_date`, so a ledger table
that is partitioned by day lists and reads the days of the window only, and its newest day comes from
the partition values.  Groupings over accounts, contracts or days are hash
aggregates with map-side partial aggregation; order-dependent values per account use the
range-split operators in operators.ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.config import KEY_INSTANCE, KEY_MAP, TOPIC_DEPOSIT
from vaultlake.functions.time import day_bucket, hour_bucket
from vaultlake.operators.joins import bounded, semi_join
from vaultlake.operators.latest import latest_per_key
from vaultlake.operators.ordered import lag_by_key, rolling_mean_rows
from vaultlake.operators.quantiles import exact_quantiles
from vaultlake.plans.vaults import vault_events_level, vault_info_dim
from vaultlake.sources.ledger import Ledger


DAY = "closed_at_date"


def newest(df: DataFrame, col: str = "closed_at") -> Column:
    """Newest time of df, looked for in its newest day only."""
    if DAY in df.columns:
        df = df.where(F.col(DAY) == today(df))
    return df.agg(F.max(col)).scalar()


def today(df: DataFrame, as_of: str | None = None) -> Column:
    """`CURRENT_DATE` of the documented queries: the given `as_of` date, else the newest day in df
    (repeatable results)."""
    if as_of:
        return F.to_date(F.lit(as_of))
    return df.agg(F.max(DAY)).scalar() if DAY in df.columns else F.to_date(df.agg(F.max("closed_at")).scalar())


def days_back(df: DataFrame, days: int, as_of: str | None = None) -> Column:
    """First day of the window `CURRENT_DATE - INTERVAL days DAY`."""
    return F.date_sub(today(df, as_of), days)


def within(df: DataFrame, days: int, as_of: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """Rows of df from the first day of the window on; `of`: the table whose newest day ends the window, if it
    is not df.  A table without a day column is bounded by its times."""
    start = days_back(df if of is None else of, days, as_of)
    return df.where(F.col(DAY) >= start) if DAY in df.columns else df.where(F.col("closed_at") >= start.cast("timestamp_ntz"))


# -- D1 ----------------------------------------------------------------------------------------
def recent_events(
    L: Ledger, contract: str = "CV0003", word: str = TOPIC_DEPOSIT, n: int = 100, days: int | None = None, as_of: str | None = None
) -> DataFrame:
    """Newest events of a contract; `days` bounds how far back they may lie."""
    ev = L.contract_events if days is None else within(L.contract_events, days, as_of)
    return (
        ev.where((F.col("contract_id") == contract) & F.col("topics_decoded").like(f"%{word}%") & F.col("successful"))
        .select("contract_id", "closed_at", "transaction_hash", "topics_decoded", "data_decoded")
        .orderBy(F.col("closed_at").desc(), "transaction_hash")
        .limit(n)
    )


# -- D2 ----------------------------------------------------------------------------------------
def events_per_contract(L: Ledger, days: int = 30, as_of: str | None = None) -> DataFrame:
    ev = L.contract_events
    ok = within(ev, days, as_of).where("successful")
    return ok.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.countDistinct("transaction_hash").alias("unique_transactions"),
        F.min("closed_at").alias("first_event"),
        F.max("closed_at").alias("last_event"),
    ).orderBy(F.col("total_events").desc(), "contract_id")


# -- D3 ----------------------------------------------------------------------------------------
def fees_daily(L: Ledger, days: int = 30, as_of: str | None = None) -> DataFrame:
    tx = L.transactions
    ok = within(tx, days, as_of).where("successful")
    return ok.groupBy(day_bucket(F.col("closed_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("num_transactions"),
        F.avg("fee_charged").alias("avg_fee"),
        F.min("fee_charged").alias("min_fee"),
        F.max("fee_charged").alias("max_fee"),
        F.sum("fee_charged").alias("total_fees"),
    ).orderBy(F.col("day").desc())


# -- D4 ----------------------------------------------------------------------------------------
def top_accounts(L: Ledger, days: int = 7, n: int = 20, as_of: str | None = None) -> DataFrame:
    tx = L.transactions
    ok = within(tx, days, as_of).where("successful")
    return (
        ok.groupBy("account")
        .agg(
            F.count(F.lit(1)).alias("num_transactions"),
            F.sum("operation_count").alias("total_operations"),
            F.sum("fee_charged").alias("total_fees_paid"),
            F.min("closed_at").alias("first_tx"),
            F.max("closed_at").alias("last_tx"),
        )
        .orderBy(F.col("num_transactions").desc(), "account")
        .limit(n)
    )


# -- D5 ----------------------------------------------------------------------------------------
def failure_share(L: Ledger, days: int = 7, as_of: str | None = None) -> DataFrame:
    """Failure reasons with their share of all failures; the total is a scalar subquery over the
    aggregated reasons, so no window moves rows to one task."""
    tx = L.transactions
    bad = within(tx, days, as_of).where("not successful")
    g = bad.groupBy("result_code_s").agg(F.count(F.lit(1)).alias("failure_count"))
    total = g.agg(F.sum("failure_count")).scalar()
    return g.select(
        "result_code_s", "failure_count", (F.col("failure_count") * 100.0 / total).alias("failure_percentage")
    ).orderBy(F.col("failure_count").desc(), "result_code_s")


# -- D7 ----------------------------------------------------------------------------------------
def state_changes(L: Ledger, key_type: str = KEY_MAP) -> DataFrame:
    """Per contract: first state (CREATED) and every state that differs from the previous one
    (MODIFIED), in ledger order."""
    cd = L.contract_data.where(F.col("contract_key_type") == key_type).select(
        "contract_id", "ledger_sequence", "closed_at", "val_decoded", "ledger_key_hash"
    )
    # several keys of a contract may change in one ledger
    h = lag_by_key(cd, ["contract_id"], ["ledger_sequence", "ledger_key_hash", "val_decoded"], ["val_decoded"])
    prev = F.col("prev_val_decoded")
    return h.where(prev.isNull() | (F.col("val_decoded") != prev)).select(
        "contract_id",
        "ledger_sequence",
        "closed_at",
        F.col("val_decoded").alias("current_state"),
        prev.alias("previous_state"),
        F.when(prev.isNull(), F.lit("CREATED")).otherwise(F.lit("MODIFIED")).alias("change_type"),
    )


# -- D9 ----------------------------------------------------------------------------------------
def events_transactions(L: Ledger) -> DataFrame:
    """Successful events with their transaction (equi-join on hash; both sides large: shuffled,
    AQE splits skewed partitions)."""
    e = L.contract_events.where(F.col("successful")).select(
        "contract_id", "closed_at", "topics_decoded", F.col("transaction_hash").alias("h")
    )
    t = L.transactions.select(F.col("transaction_hash").alias("h"), "account", "fee_charged", "operation_count")
    return e.join(t, "h").drop("h")


# -- D10 ---------------------------------------------------------------------------------------
def events_latest_state(L: Ledger) -> DataFrame:
    """Successful events joined with the newest instance snapshot of their contract."""
    inst = L.contract_data.where(F.col("contract_key_type") == KEY_INSTANCE)
    latest = latest_per_key(inst, ["contract_id"], ["closed_at", "ledger_sequence"], ["val_decoded"])
    latest = L.dim("latest_instances_all", lambda: latest.select("contract_id", F.col("val_decoded").alias("contract_metadata")))
    e = L.contract_events.where(F.col("successful")).select("contract_id", "closed_at", "topics_decoded")
    return e.join(bounded(latest, L.cfg.max_broadcast_rows), "contract_id")


# -- D11 ---------------------------------------------------------------------------------------
def _event_totals(ev: DataFrame) -> DataFrame:
    return ev.groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("num_events"),
        F.countDistinct("transaction_hash").alias("num_transactions"),
        F.min("closed_at").alias("first_event"),
        F.max("closed_at").alias("last_event"),
    ).orderBy(F.col("num_events").desc(), "contract_id")


def asset_contract_events(L: Ledger, asset_code: str = "USDC") -> DataFrame:
    """Event totals of the contracts that carry `asset_code` in any of their states.  Any account can issue an
    asset of that code, so the set of contracts has no bound: it is kept, counted, and broadcast if it is
    small, else the semi-join is shuffled (with the runtime Bloom filter, where Catalyst finds it pays)."""
    contracts = L.dim(
        f"asset_contracts/{asset_code}",
        lambda: L.contract_data.where(F.col("asset_code") == asset_code).select("contract_id").distinct(),
    )
    return _event_totals(semi_join(L.contract_events.where("successful"), contracts, "contract_id", "contract_id", L.cfg.max_broadcast_rows))


def asset_vault_events(L: Ledger, asset_code: str = "USDC") -> DataFrame:
    """Event totals of the vault contracts holding `asset_code`."""
    vi = vault_info_dim(L).where(F.col("asset_code") == asset_code).select(F.col("vault").alias("contract_id")).distinct()
    return _event_totals(L.contract_events.where("successful").join(bounded(vi, L.cfg.max_broadcast_rows), "contract_id"))


# -- D12 ---------------------------------------------------------------------------------------
def hourly_counts_filled(L: Ledger, days: int = 7, as_of: str | None = None) -> DataFrame:
    """Hourly event counts per vault over the last `days` days, hours without events as 0.
    The grid (vaults x hours) is generated per vault row; counts join on (vault, hour)."""
    ev = L.contract_events
    start = hour_bucket(days_back(ev, days, as_of).cast("timestamp_ntz"))
    # CURRENT_TIMESTAMP: the end of the as_of day, else the newest event time
    end = hour_bucket(F.lit(f"{as_of} 23:00:00").cast("timestamp_ntz") if as_of else newest(ev))
    recent = within(ev, days, as_of)
    counts = recent.groupBy("contract_id", hour_bucket(F.col("closed_at")).alias("hour")).agg(
        F.count(F.lit(1)).alias("events_count")
    )
    vaults = vault_info_dim(L).select(F.col("vault").alias("contract_id"))
    grid = vaults.select("contract_id", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    j = grid.join(counts, ["contract_id", "hour"], "left")
    return j.select("contract_id", "hour", F.coalesce(F.col("events_count"), F.lit(0).cast("bigint")).alias("events_count"))


# -- D13 ---------------------------------------------------------------------------------------
def moving_avg_rank(L: Ledger, days: int = 7, rows: int = 100, as_of: str | None = None) -> DataFrame:
    """Per (closed_at, contract) event counts, their 100-row moving average per contract, and the
    dense rank of the count within its hour.  The moving average uses running sums over a
    range-split order (no whole-contract task); the dense rank is the rank of the distinct
    (hour, count) pairs, a small table, joined back."""
    ev = L.contract_events
    recent = within(ev, days, as_of).where("successful")
    g = recent.groupBy("closed_at", "contract_id").agg(F.count(F.lit(1)).alias("events"))
    g = g.withColumn("hour", hour_bucket(F.col("closed_at")))
    m = rolling_mean_rows(g, ["contract_id"], ["closed_at"], "events", rows, "moving_avg_100")
    pairs = g.select("hour", "events").distinct()
    ranks = pairs.select("hour", "events", F.dense_rank().over(Window.partitionBy("hour").orderBy(F.col("events").desc())).cast("bigint").alias("hourly_rank"))
    out = m.join(ranks, ["hour", "events"])
    return out.select("closed_at", "contract_id", "events", F.round("moving_avg_100", 6).alias("moving_avg_100"), "hourly_rank")


# -- D14-D17 -----------------------------------------------------------------------------------
def _flows(L: Ledger) -> DataFrame:
    return vault_events_level(L)


def _dep(c: Column) -> Column:
    return F.when(F.col("event") == "deposit", c).otherwise(F.lit(0))


def _wd(c: Column) -> Column:
    return F.when(F.col("event") == "withdraw", c).otherwise(F.lit(0))


def user_activity(L: Ledger, n: int = 10) -> DataFrame:
    ve = _flows(L)
    return (
        ve.groupBy(F.col("to").alias("user"))
        .agg(
            F.count(F.lit(1)).alias("num_transactions"),
            F.sum(_dep(F.col("amount"))).alias("total_deposited"),
            F.sum(_wd(F.col("amount"))).alias("total_withdrawn"),
        )
        .orderBy(F.col("total_deposited").desc(), "user")
        .limit(n)
    )


def top_depositors(L: Ledger, n: int = 10) -> DataFrame:
    ve = _flows(L).where(F.col("event") == "deposit")
    return ve.groupBy(F.col("to").alias("user")).agg(F.sum("amount").alias("total_volume")).orderBy(
        F.col("total_volume").desc(), "user"
    ).limit(n)


def _net(c: Column) -> Column:
    return F.when(F.col("event") == "deposit", c).otherwise(-c)


def net_flow_vault(L: Ledger) -> DataFrame:
    ve = _flows(L)
    return ve.groupBy(day_bucket(F.col("closed_at")).alias("day"), "vault_name").agg(
        F.sum(_dep(F.col("amount"))).alias("deposits"),
        F.sum(_wd(F.col("amount"))).alias("withdrawals"),
        F.sum(_net(F.col("amount"))).alias("net_flow"),
    )


def net_flow(L: Ledger) -> DataFrame:
    ve = _flows(L)
    return ve.groupBy(day_bucket(F.col("closed_at")).alias("day")).agg(F.sum(_net(F.col("amount"))).alias("net_flow"))


# -- N1, N2, N7, N11-N13, N15 --------------------------------------------------------------------
def active_users(L: Ledger, n: int = 10) -> DataFrame:
    """Users by number of vault events (ties by address), with their distinct transactions."""
    ve = _flows(L)
    return (
        ve.groupBy(F.col("to").alias("user"))
        .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("tx_hash").alias("transactions"))
        .orderBy(F.col("events").desc(), "user")
        .limit(n)
    )


def cohort_retention(L: Ledger) -> DataFrame:
    """Users by first-activity week (cohort) and weeks since then: distinct active users."""
    week = day_bucket(F.col("closed_at")) - F.make_dt_interval(days=F.weekday("closed_at"))
    ve = _flows(L).select(F.col("to").alias("user"), week.alias("week"))
    first = ve.groupBy("user").agg(F.min("week").alias("cohort_week"))
    j = ve.join(first, "user")
    return j.groupBy(
        "cohort_week", (F.datediff(F.col("week"), F.col("cohort_week")) / 7).cast("int").alias("week_offset")
    ).agg(F.countDistinct("user").alias("users"))


def busiest_days(L: Ledger, n: int = 5) -> DataFrame:
    ve = _flows(L)
    return ve.groupBy(day_bucket(F.col("closed_at")).alias("day")).agg(F.count(F.lit(1)).alias("events")).orderBy(
        F.col("events").desc(), F.col("day").desc()
    ).limit(n)


def activity_profile(L: Ledger) -> DataFrame:
    """Vault events by ISO weekday (1 = Monday) and hour of day."""
    ve = _flows(L)
    return ve.groupBy(
        (F.weekday("closed_at") + 1).alias("iso_weekday"), F.hour("closed_at").alias("hour_of_day")
    ).agg(F.count(F.lit(1)).alias("events"), F.sum("amount").alias("volume"))


def vault_transitions(L: Ledger) -> DataFrame:
    """Moves of users between vaults: for each user's vault event, the vault of their next event;
    edges where the vault changes, counted."""
    ve = _flows(L).select(F.col("to").alias("user"), "closed_at", "tx_hash", "vault").distinct()
    nxt = lag_by_key(ve, ["user"], ["closed_at", "tx_hash", "vault"], ["vault"], prefix="next_", lead=True)
    moves = nxt.where(F.col("next_vault").isNotNull() & (F.col("next_vault") != F.col("vault")))
    return moves.groupBy(F.col("vault").alias("from_vault"), F.col("next_vault").alias("to_vault")).agg(
        F.count(F.lit(1)).alias("moves"), F.countDistinct("user").alias("users")
    )


def multi_vault_users(L: Ledger) -> DataFrame:
    ve = _flows(L)
    g = ve.groupBy(F.col("to").alias("user")).agg(F.countDistinct("vault").alias("vaults"))
    return g.where(F.col("vaults") > 1)


def new_vaults(L: Ledger) -> DataFrame:
    ve = _flows(L)
    return ve.groupBy("vault", "vault_name").agg(
        F.min("closed_at").alias("first_event"), F.count(F.lit(1)).alias("events")
    )


def user_growth(L: Ledger) -> DataFrame:
    """Per day with vault events: active users, users seen for the first time, users so far, and the growth of the
    users so far in percent (NULL on the first day).  Users are reduced to their days before any window, so
    the windows are bounded by the calendar."""
    days = _flows(L).select(F.col("to").alias("user"), day_bucket(F.col("closed_at")).alias("day")).where("user is not null").distinct()
    first = F.min("day").over(Window.partitionBy("user")) == F.col("day")
    d = days.withColumn("first", first).groupBy("day").agg(F.count(F.lit(1)).alias("active_users"), F.count(F.when(F.col("first"), 1)).alias("new_users"))
    d = d.withColumn("total_users", F.sum("new_users").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = F.nullif(F.col("total_users") - F.col("new_users"), F.lit(0)).cast("double")
    return d.withColumn("growth_pct", F.round(F.col("new_users").cast("double") / before * 100, 6))


# -- N19-N22 -----------------------------------------------------------------------------------
def resource_usage(L: Ledger) -> DataFrame:
    tx = L.transactions
    return tx.groupBy("account").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("soroban_resources_instructions").alias("instructions"),
        F.sum("soroban_resources_read_bytes").alias("read_bytes"),
        F.sum("soroban_resources_write_bytes").alias("write_bytes"),
        F.max("soroban_resources_instructions").alias("max_instructions"),
    )


def fee_headroom(L: Ledger) -> DataFrame:
    tx = L.transactions
    return tx.groupBy(day_bucket(F.col("closed_at")).alias("day")).agg(
        F.sum("fee_charged").alias("fee_charged"),
        F.sum("max_fee").alias("max_fee"),
        F.round(F.sum("fee_charged").cast("double") / F.sum("max_fee").cast("double"), 6).alias("charged_ratio"),
        F.count(F.when(F.col("fee_charged") >= F.col("max_fee"), F.lit(1))).alias("at_limit"),
    )


def ingest_lag(L: Ledger) -> DataFrame:
    """Delay between ledger close and ingestion, per day (seconds)."""
    ev = L.contract_events
    lag_s = F.timestamp_diff("MICROSECOND", F.col("closed_at"), F.col("ingested_at")) / 1e6
    return ev.groupBy(day_bucket(F.col("closed_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min(lag_s).alias("min_lag_s"),
        F.max(lag_s).alias("max_lag_s"),
        F.round(F.avg(lag_s), 6).alias("avg_lag_s"),
    )


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def ingest_lag_quantiles(L: Ledger) -> DataFrame:
    """Median, 95th and 99th percentile of the ingestion delay in microseconds, per contract."""
    ev = L.contract_events.select("contract_id", F.timestamp_diff("MICROSECOND", F.col("closed_at"), F.col("ingested_at")).alias("lag"))
    return exact_quantiles(ev, ["contract_id"], "lag", QUANTILES)


def resource_quantiles(L: Ledger) -> DataFrame:
    """The same of the instructions of the transactions that touch a contract, per contract."""
    touched = L.contract_events.select("contract_id", F.col("transaction_hash").alias("h")).distinct()
    tx = L.transactions.select(F.col("transaction_hash").alias("h"), "soroban_resources_instructions")
    return exact_quantiles(touched.join(tx, "h"), ["contract_id"], "soroban_resources_instructions", QUANTILES)


def topic_frequency(L: Ledger) -> DataFrame:
    ev = L.contract_events
    return ev.groupBy("contract_id", "topics_decoded").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("transaction_hash").alias("transactions")
    )
