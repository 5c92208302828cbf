"""Incremental refresh of the stored levels by ledger day.

Every input has a fingerprint per day (row count and sum of row hashes; both are sums, so rows in any order
give the same).  A refresh compares them with those of the last one and computes only the days that differ:

  vault_events     days with changed events, and the other days of the transactions that those days hold
                   (a transaction's amount and account are taken over all its events)
  tvl_hours        those days and the days with changed prices
  tvl_days_filled  computed from the stored hours (vaults x days); only days whose rows differ are written,
                   since a late reading is carried forward until the next one

A changed vault_info recomputes every day.  Levels are stored as <root>/<level>/version=<refresh>/day=<day>; the
table <root>/_state says which version of each day counts.  It is appended to last, in one job, so a refresh that
dies leaves the former tables as they were and the next one repeats it; readers that began before go on with the
versions they know.  Older versions belong to the caller.  Events without a time belong to no day and are left
out.  The lists of days on the driver are bounded by the calendar.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.operators.joins import materialize
from vaultlake.plans import vaults as V
from vaultlake.session import ensure_checkpoint_dir
from vaultlake.sources.ledger import Ledger

STATE = "gen long, kind string, day date, rows long, hash decimal(38,0), version string"
LEVELS = {"vault_events": "closed_at", "tvl_hours": "hour", "tvl_days_filled": "day"}
_VAULT = "vault string, vault_name string, asset string, asset_code string"
SCHEMAS = {
    "vault_events": f"closed_at timestamp_ntz, {_VAULT}, event string, to string, amount decimal(38,7), total_amount decimal(38,7), closed_at_hour timestamp_ntz, tx_hash string",
    "tvl_hours": f"hour timestamp_ntz, {_VAULT}, asset_tvl decimal(38,7), asset_price decimal(38,7), usd_tvl decimal(38,7)",
    "tvl_days_filled": f"day timestamp_ntz, {_VAULT}, asset_tvl decimal(38,7), usd_tvl decimal(38,7)",
}
PARTS = "version string, __part_day date"
EVENT_INPUT = ("contract_id", "transaction_hash", "transaction_id", "successful", "closed_at", "topics_decoded", "data_decoded")


def day_prints(df: DataFrame, time: str, columns) -> DataFrame:
    """day, rows, hash of `df`."""
    h = F.xxhash64(*columns).cast("decimal(38,0)")
    rows = df.select(F.to_date(time).alias("day"), h.alias("h")).where("day is not null")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("hash"))


def _prints(df: DataFrame, time: str, columns) -> dict[date, tuple]:
    return {r["day"]: (r["rows"], r["hash"]) for r in day_prints(df, time, columns).collect()}


def _read(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """The table at `path`; empty where nothing was ever written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _state(spark: SparkSession, root: str) -> tuple[int, dict[str, dict]]:
    """Number of the last refresh, and kind -> day -> (rows, hash, version)."""
    all_ = _read(spark, STATE, f"{root}/_state")
    last = all_.agg(F.max("gen")).first()[0]
    if last is None:
        return 0, {}
    out: dict[str, dict] = {}
    for r in all_.where(F.col("gen") == last).collect():
        out.setdefault(r["kind"], {})[r["day"]] = (r["rows"], r["hash"], r["version"])
    return last, out


def _differing(now: dict, before: dict) -> set[date]:
    return {d for d in now.keys() | before.keys() if now.get(d) != (before[d][:2] if d in before else None)}


def _on_days(df: DataFrame, days: set[date], time: str) -> DataFrame:
    """Rows on `days`; the bounds of the time reach the scan."""
    if not days:
        return df.where(F.lit(False))
    bounds = (F.col(time) >= F.lit(min(days)).cast("timestamp_ntz")) & (F.col(time) < F.date_add(F.lit(max(days)), 1).cast("timestamp_ntz"))
    return df.where(bounds & F.to_date(time).isin(sorted(days)))


def _stored(spark: SparkSession, root: str, level: str, state: dict[str, dict]) -> DataFrame:
    """The current rows of a level."""
    live = [(d, v[2]) for d, v in state.get(level, {}).items()]
    if not live:
        return spark.createDataFrame([], SCHEMAS[level])
    paths = [f"{root}/{level}/version={v}" for v in sorted({v for _, v in live})]
    df = spark.read.schema(f"{SCHEMAS[level]}, {PARTS}").option("basePath", f"{root}/{level}").parquet(*paths)
    of = spark.createDataFrame(live, "__day date, __version string")
    on = (F.col("__part_day") == F.col("__day")) & (F.col("version") == F.col("__version"))
    return df.join(F.broadcast(of), on, "left_semi").drop("__part_day", "version")


def read_level(spark: SparkSession, root: str, level: str) -> DataFrame:
    """A level as the last finished refresh left it."""
    return _stored(spark, root, level, _state(spark, root)[1])


def refresh_dag(L: Ledger, root: str) -> DataFrame:
    """level, day of every day that was computed and stored anew (or that vanished)."""
    spark, root, version = L.spark, root.rstrip("/"), uuid.uuid4().hex
    gen, before = _state(spark, root)
    info = V.vault_info_dim(L)
    inputs = {
        "events": _prints(L.contract_events, "closed_at", EVENT_INPUT),
        "prices": _prints(L.prices, "closed_at_day", ["contract_id", "price"]),
        "vault_info": _prints(info.withColumn("__day", F.lit("1970-01-01")), "__day", info.columns),
    }
    changed = {k: _differing(now, before.get(k, {})) for k, now in inputs.items()}
    state = {k: {d: (*p, None) for d, p in now.items()} for k, now in inputs.items()}
    for level in LEVELS:
        state[level] = dict(before.get(level, {}))
    if changed["vault_info"]:
        changed["events"] = set(inputs["events"]) | set(before.get("events", {}))
    report: list[tuple[str, date]] = []

    def store(level: str, df: DataFrame, days: set[date]) -> DataFrame:
        """Store `df`, the rows of `level` on `days`."""
        time = LEVELS[level]
        if days:
            part = df.withColumns({"version": F.lit(version), "__part_day": F.to_date(time)})
            part.hint("rebalance", "__part_day").write.mode("append").partitionBy("version", "__part_day").parquet(f"{root}/{level}")
            got = _read(spark, SCHEMAS[level], f"{root}/{level}/version={version}")
            for d in days:
                state[level].pop(d, None)
            state[level].update({d: (*p, version) for d, p in _prints(got, time, df.columns).items()})
            report.extend((level, d) for d in sorted(days))
        return _stored(spark, root, level, state)

    def ledger(events: DataFrame) -> Ledger:
        sub = Ledger.from_tables(spark, L.contract_data, events, None, L.prices, L.cfg)
        sub._dims.update(vault_info=info)
        return sub

    # transactions of the changed days, as they are and as they were
    days = changed["events"]
    ev = L.contract_events
    touched = _on_days(ev, days, "closed_at").select(F.col("transaction_hash").alias("__tx"))
    if before.get("vault_events"):
        old = _stored(spark, root, "vault_events", before)
        touched = touched.union(_on_days(old, days, "closed_at").select("tx_hash"))
    theirs = ev.join(touched, F.col("transaction_hash") == F.col("__tx"), "left_semi").select(F.to_date("closed_at").alias("d"))
    days = days | {r["d"] for r in theirs.distinct().collect() if r["d"]}
    # every event of the transactions of those days; only rows on the days are kept
    of = _on_days(ev, days, "closed_at").select(F.col("transaction_hash").alias("__tx"))
    whole = ev.join(of, F.col("transaction_hash") == F.col("__tx"), "left_semi")
    events = store("vault_events", _on_days(V.vault_events_df(ledger(whole)), days, "closed_at"), days)

    days = days | changed["prices"]
    sub = ledger(ev)
    sub.store_level("vault_events", _on_days(events, days, "closed_at"))
    hours = store("tvl_hours", V.tvl_hours_df(sub), days)

    sub.store_level("tvl_hours", hours)
    if days:
        filled = materialize(V.tvl_days_filled_df(sub))
        ours = _prints(filled, "day", filled.columns)
        days = _differing(ours, before.get("tvl_days_filled", {}))
        store("tvl_days_filled", _on_days(filled, days, "day"), days)
        filled.unpersist()

    if report or any(changed.values()) or not gen:
        rows = [(gen + 1, kind, d, *v) for kind, of_days in state.items() for d, v in of_days.items()]
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(f"{root}/_state")
    return spark.createDataFrame(report, "level string, day date")


def refresh_days(L: Ledger) -> DataFrame:
    """The gap-filled daily series after two refreshes: one without the newest day, one that adds it."""
    root = f"{ensure_checkpoint_dir(L.spark).rstrip('/')}/refresh-{uuid.uuid4().hex}"
    ev = L.contract_events
    newest = F.to_date(ev.agg(F.max("closed_at")).scalar()).cast("timestamp_ntz")
    refresh_dag(Ledger.from_tables(L.spark, L.contract_data, ev.where(F.col("closed_at") < newest), None, L.prices, L.cfg), root)
    refresh_dag(L, root)
    return read_level(L.spark, root, "tvl_days_filled")
