"""Structured Streaming versions of the event jobs.

The event log is read as a file stream (each run processes what is available and stops:
trigger availableNow), decoded per event, and written to Parquet.  Output, state and checkpoints lie
below one folder; a run that is given the folder of an earlier one resumes where that stopped (by
default each run gets a new folder in the cluster's checkpoint folder).  Only events of registered
vaults count.

  stream_decode    decoded deposit/withdraw events; events are appended whenever they come, however
                   late; a batch leaves out redelivered ones (same transaction, vault, time, topics and
                   payload) by an anti-join with the stored events of its days
  stream_net_flow  daily net flow per ledger day of the single events' amounts (complete mode; state
                   = one row per day); the batch `net_flow` sums the per-transaction amounts instead
  stream_hourly_tvl  largest TVL per vault and hour: each batch appends its own partial maxima, which
                   are merged on reading, so no event is late
  stream_alerts    large withdrawals, TVL drops and new vaults, from keyed state per vault
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.functions.i128 import i128
from vaultlake.functions.payload import parse_typed, typed_addresses, typed_i128s, typed_vecs
from vaultlake.functions.time import day_bucket, hour_bucket
from vaultlake.operators.joins import semi_join
from vaultlake.plans.vaults import event_kind, sum_skip_nulls, vault_info_dim
from vaultlake.session import ensure_checkpoint_dir
from vaultlake.sources.ledger import Ledger
from vaultlake.streaming.alerts import read_alerts, write_decisions

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _home(spark: SparkSession, name: str, home: str | None) -> str:
    return (home or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}").rstrip("/")


def event_stream(L: Ledger, files_per_trigger: int = 1, source: tuple[str, str] | None = None) -> DataFrame:
    """Driver `events` files as a stream of ledger events; `source` = (folder, file glob), by
    default the data set's events file."""
    folder, glob = source or (L.sf_dir, "events.parquet")
    raw = (
        L.spark.readStream.schema(EVENTS_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return L.events_to_ledger(raw)


def decoded_flows(L: Ledger, source: tuple[str, str] | None = None) -> DataFrame:
    """Per-event decode of deposits/withdrawals of registered vaults."""
    t = F.col("topics_decoded")
    ev = event_stream(L, source=source).where(t.like(f"%{L.cfg.vault_topic}%") & (t.like("%withdraw%") | t.like("%deposit%")))
    ev = semi_join(ev, vault_info_dim(L), "contract_id", "vault", L.cfg.max_broadcast_rows)
    if L.cfg.only_successful:
        ev = ev.where(F.col("successful"))
    ev = ev.select("*", parse_typed(F.col("data_decoded")).alias("e"))
    e = F.col("e")
    one = lambda arr: F.try_element_at(arr, F.lit(1))
    amounts = typed_vecs(e, ["amounts", "amounts_withdrawn"])
    funds = one(typed_vecs(e, "total_managed_funds_before"))
    tvl = one(typed_i128s(parse_typed(funds), "total_amount"))
    return ev.select(
        "closed_at",
        F.col("contract_id").alias("vault"),
        F.col("transaction_hash").alias("tx_hash"),
        event_kind().alias("event"),
        one(typed_addresses(e, ["depositor", "withdrawer"])).alias("account"),
        sum_skip_nulls(F.transform(amounts, i128)).alias("amount"),
        tvl.alias("total_amount"),
        F.sha2(F.concat_ws("|", "topics_decoded", "data_decoded"), 256).alias("event_key"),
    )


FLOW_SCHEMA = (
    "closed_at timestamp_ntz, vault string, tx_hash string, event string, account string, amount decimal(38,7), total_amount decimal(38,7), event_key string"
)
EVENT_ID = ("event_key", "tx_hash", "vault", "closed_at")


def _epochs(spark: SparkSession, out: str) -> DataFrame:
    """What the batches wrote so far, with epoch and day."""
    schema = f"{FLOW_SCHEMA}, epoch long, day date"
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _unseen(batch: DataFrame, before: DataFrame) -> DataFrame:
    """Events of `batch`, once each, that `before` doesn't hold.  An event has one day, so only the stored
    partitions of the batch's days are read (a list bounded by the calendar)."""
    days = [r["day"] for r in batch.select("day").distinct().collect()]
    dated = F.col("day").isin([d for d in days if d is not None])
    known = before.where(dated | F.col("day").isNull() if None in days else dated).select(*[F.col(c).alias(f"of_{c}") for c in EVENT_ID])
    same = F.col("event_key") == F.col("of_event_key")
    for c in EVENT_ID[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return batch.dropDuplicates(EVENT_ID).join(known, same, "left_anti")


def stream_decode(L: Ledger, source: tuple[str, str] | None = None, home: str | None = None) -> DataFrame:
    """Each batch appends the events that were not there before, below its epoch (a repeated batch writes the
    same rows again) and their days, so nothing is late however old, no state is held between batches, and a
    reader needs no shuffle.  The ledger gives events no number of their own: two events of a transaction
    with equal topics and payload count as one."""
    home = _home(L.spark, "decode", home)
    out, ckpt = f"{home}/out", f"{home}/checkpoint"

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("day", F.to_date("closed_at")).persist()
        new = _unseen(batch, _epochs(L.spark, out).where(F.col("epoch") < epoch))
        new.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{out}/epoch={epoch}")
        batch.unpersist()

    decoded_flows(L, source).writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return _epochs(L.spark, out).drop("event_key", "epoch", "day")


def stream_net_flow(L: Ledger, home: str | None = None) -> DataFrame:
    """Net flow (deposits - withdrawals) and event count per ledger day, kept current: the
    aggregate state is one row per day (bounded by the calendar), written in full each batch."""
    flows = decoded_flows(L)
    signed = F.when(F.col("event") == "deposit", F.col("amount")).otherwise(-F.col("amount"))
    agg = flows.groupBy(day_bucket(F.col("closed_at")).alias("day")).agg(
        F.sum(signed).alias("net_flow"), F.count(F.lit(1)).alias("events")
    )
    home = _home(L.spark, "netflow", home)
    out, ckpt = f"{home}/out", f"{home}/checkpoint"

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = agg.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return L.spark.read.parquet(out)


def stream_hourly_tvl(L: Ledger, source: tuple[str, str] | None = None, home: str | None = None) -> DataFrame:
    """vault, hour, max_tvl, readings.  No state is kept: a batch writes one row per vault and hour that it
    has (its folder is named by its epoch, so a repeated batch writes the same rows), and maxima of
    maxima are the maxima of all readings, in whatever order files come."""
    home = _home(L.spark, "hourly", home)
    out, ckpt = f"{home}/out", f"{home}/checkpoint"
    readings = decoded_flows(L, source).where("total_amount is not null").select("vault", hour_bucket(F.col("closed_at")).alias("hour"), "total_amount")

    def write(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy("vault", "hour").agg(F.max("total_amount").alias("max_tvl"), F.count(F.lit(1)).alias("readings"))
        part.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    readings.writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    parts = L.spark.read.schema("vault string, hour timestamp_ntz, max_tvl decimal(38,7), readings long, epoch long").parquet(out)
    return parts.groupBy("vault", "hour").agg(F.max("max_tvl").alias("max_tvl"), F.sum("readings").alias("readings"))


def stream_alerts(
    L: Ledger, withdraw_share: float = 0.001, drop_pct: float = -50.0, source: tuple[str, str] | None = None, home: str | None = None,
    lateness_hours: int = 24 * 7,
) -> DataFrame:
    """Withdrawals of at least `withdraw_share` of the vault's TVL, TVL readings at least `drop_pct` percent
    below the vault's reading before, and the first event of each vault (see streaming.alerts)."""
    home = _home(L.spark, "alerts", home)
    write_decisions(decoded_flows(L, source), home, withdraw_share, drop_pct, lateness_hours)
    return read_alerts(L.spark, home)
