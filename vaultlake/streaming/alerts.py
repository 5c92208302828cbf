"""Alerts per vault from keyed streaming state: large withdrawals, sudden TVL drops, new vaults.

One stateful operator (`transformWithState`, a value state and event-time timers per vault).  The state
holds the time of the vault's first event and its TVL readings of the last `lateness`, in order, with
the newest one before.  A reading may come late: it is compared with the reading before it in ledger
time, and the reading after it is compared anew.  So each decision is written with a version, and the
newest version of a reading counts: what is read equals the batch result in whatever order files come.
A timer empties the state of a vault that has had no event for `lateness`, down to its newest reading.

Bounds: a vault's state holds the readings of `lateness`; its rows of one trigger are taken in Arrow
batches.  A reading older than all that is held, where older ones were let go already, can't be compared any
more and gives no TVL alert (its withdrawal and first-event alerts are given).  Equal readings of one
transaction and time count once.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vaultlake.operators.latest import latest_per_key

DECISIONS = "vault string, kind string, at long, tx_hash string, prev_tvl string, tvl string, version long, active boolean"
STATE = "first long, version long, let_go boolean, readings string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EPOCH = "1970-01-01 00:00:00"


@dataclass
class VaultState:
    """Readings are (time in microseconds, transaction, TVL), ascending."""

    first: int | None = None
    version: int = 0
    let_go: bool = False
    readings: list[tuple[int, str, Decimal]] = field(default_factory=list)

    def pack(self) -> tuple:
        return self.first, self.version, self.let_go, json.dumps([(a, b, str(c)) for a, b, c in self.readings])

    @classmethod
    def unpack(cls, row: tuple | None) -> VaultState:
        if row is None:
            return cls()
        return cls(row[0], row[1], row[2], [(a, b, Decimal(c)) for a, b, c in json.loads(row[3])])

    def next_version(self) -> int:
        self.version += 1
        return self.version

    def let_go_before(self, at: int) -> None:
        """Keeps the readings from `at` on, and the newest one before."""
        keep = max(0, bisect_right(self.readings, (at, "", Decimal("-Infinity"))) - 1)
        if keep:
            self.let_go, self.readings = True, self.readings[keep:]


def is_drop(prev: Decimal | None, now: Decimal, drop_pct: float) -> bool:
    return prev is not None and prev > 0 and (float(now) - float(prev)) / float(prev) * 100 <= drop_pct


def add_reading(state: VaultState, reading: tuple[int, str, Decimal], drop_pct: float) -> Iterator[tuple]:
    """Puts a reading in its place; yields (time, transaction, prev_tvl, tvl, version, active) for each
    reading whose alert changes."""
    at = bisect_right(state.readings, reading)
    if at and state.readings[at - 1] == reading or not at and state.let_go:
        return
    before = state.readings[at - 1][2] if at else None
    if is_drop(before, reading[2], drop_pct):
        yield reading[0], reading[1], before, reading[2], state.next_version(), True
    if at < len(state.readings):
        after = state.readings[at]
        was, now = is_drop(before, after[2], drop_pct), is_drop(reading[2], after[2], drop_pct)
        if was or now:
            yield after[0], after[1], reading[2], after[2], state.next_version(), now
    state.readings.insert(at, reading)


class VaultAlerts(StatefulProcessor):
    def __init__(self, withdraw_share: float, drop_pct: float, lateness: int):
        self.withdraw_share, self.drop_pct, self.lateness = withdraw_share, drop_pct, lateness

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("vault", STATE)

    def handleInputRows(self, key, rows, timerValues):
        state, vault = VaultState.unpack(self.state.get()), key[0]
        for batch in rows:
            out = []
            first = int(batch["at"].min())
            if state.first is None or first < state.first:
                state.first = first
                out.append((vault, "new_vault", first, None, None, None, state.next_version(), True))
            for at, tx, event, amount, total in zip(batch["at"], batch["tx_hash"], batch["event"], batch["amount"], batch["total_amount"]):
                if total is None:
                    continue
                at, total = int(at), Decimal(total)
                if event == "withdraw" and total > 0 and amount is not None and float(Decimal(amount)) / float(total) >= self.withdraw_share:
                    out.append((vault, "large_withdrawal", at, tx, str(total), amount, state.next_version(), True))
                for t, h, prev, now, version, active in add_reading(state, (at, tx, total), self.drop_pct):
                    out.append((vault, "tvl_drop", t, h, None if prev is None else str(prev), str(now), version, active))
            if state.readings:
                state.let_go_before(state.readings[-1][0] - self.lateness)
            yield self._table(out)
        if state.readings:
            self.handle.registerTimer((state.readings[-1][0] + self.lateness) // 1000 + 1)
        self.state.update(state.pack())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = VaultState.unpack(self.state.get())
        if state.readings and (state.readings[-1][0] + self.lateness) // 1000 < timerValues.getCurrentWatermarkInMs():
            state.let_go_before(state.readings[-1][0])
            state.readings, state.let_go = state.readings[-1:], state.let_go or len(state.readings) > 1
            self.state.update(state.pack())
        yield self._table([])

    def close(self) -> None:
        pass

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        kinds = {"string": object, "long": "int64", "boolean": "bool"}
        types = [x.split() for x in DECISIONS.split(", ")]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=kinds[t]) for i, (n, t) in enumerate(types)})


def micros(column: str):
    """A TIMESTAMP_NTZ as microseconds, without any time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(column))


def write_decisions(flows: DataFrame, home: str, withdraw_share: float, drop_pct: float, lateness_hours: int) -> None:
    """Processes what is available of `flows` (vault, closed_at, tx_hash, event, amount, total_amount)."""
    spark = flows.sparkSession
    text = [F.col(c).cast("string").alias(c) for c in ("amount", "total_amount")]
    rows = flows.select("vault", micros("closed_at").alias("at"), "tx_hash", "event", *text).withColumn("event_time", F.timestamp_micros("at"))
    processor = VaultAlerts(withdraw_share, drop_pct, lateness_hours * 3_600_000_000)
    decisions = (
        rows.withWatermark("event_time", f"{lateness_hours} hours").groupBy("vault")
        .transformWithStateInPandas(processor, DECISIONS, "append", "EventTime")
    )
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # keyed state needs it; a query keeps the provider that it starts with
    try:
        q = (
            decisions.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint")
            .outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def read_alerts(spark: SparkSession, home: str) -> DataFrame:
    """vault, closed_at, kind, prev_tvl, tvl: the decisions that hold."""
    made = spark.read.schema(DECISIONS).parquet(f"{home}/out")
    drops = latest_per_key(made.where("kind = 'tvl_drop'"), ["vault", "kind", "at", "tx_hash", "tvl"], ["version"], ["prev_tvl", "active"]).where("active")
    fresh = made.where("kind = 'new_vault'").groupBy("vault", "kind").agg(F.min("at").alias("at"))
    names = ["vault", "kind", "at", "prev_tvl", "tvl"]
    found = drops.select(*names).unionByName(made.where("kind = 'large_withdrawal'").select(*names)).unionByName(fresh, allowMissingColumns=True)
    closed_at = F.timestamp_add("MICROSECOND", F.col("at"), F.lit(EPOCH).cast("timestamp_ntz"))
    return found.select(
        "vault", closed_at.alias("closed_at"), "kind", F.col("prev_tvl").cast("decimal(38,7)").alias("prev_tvl"), F.col("tvl").cast("decimal(38,7)").alias("tvl")
    )
