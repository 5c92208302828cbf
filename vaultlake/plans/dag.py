"""Materialised chain of derived tables (the stored upstream results the dashboards read), and
the preview / raw-inspection helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlake.plans import vaults as V
from vaultlake.session import ensure_checkpoint_dir
from vaultlake.sources.ledger import Ledger

from vaultlake.plans import strategies as S

# Levels in dependency order: each is written, and registered on the Ledger, before its
# dependents are computed, so every level reads its upstream from storage.
LEVELS = (
    ("vault_info", V.vault_info_dim, None),
    ("vault_events", V.vault_events_df, None),
    ("tvl_hours", V.tvl_hours_df, None),
    ("tvl_days_filled", V.tvl_days_filled_df, None),
    ("latest_vaults", V.latest_vaults_df, None),
    ("harvest_events", S.harvest_events_df, None),
)


def materialize_dag(L: Ledger, root: str | None = None) -> DataFrame:
    """Write every level as Parquet under `root` (default: a fresh folder in the cluster's
    checkpoint directory) in topological order, register each stored level on the Ledger, and
    return the headline total read back from the stored latest-per-vault table."""
    base = root or f"{ensure_checkpoint_dir(L.spark).rstrip('/')}/dag-{uuid.uuid4().hex}"
    for name, build, part in LEVELS:
        w = build(L).write.mode("overwrite")
        if part:
            w = w.partitionBy(part)
        w.parquet(f"{base}/{name}")
        stored = L.spark.read.parquet(f"{base}/{name}")
        if part:
            stored = stored.select(*build(L).columns)
        L.store_level(name, stored)
    latest = L.spark.read.parquet(f"{base}/latest_vaults")
    return latest.agg(F.sum("usd_tvl").alias("total_usd_tvl"))


def preview(L: Ledger, key: str = "vault_events", n: int = 10) -> DataFrame:
    """First n rows of a named query (total order over all columns, descending) with the total row
    count of the query beside them."""
    from vaultlake.plans.registry import PLANS

    df = PLANS[key](L)
    total = df.count()
    top = df.orderBy(*[F.col(c).desc_nulls_last() for c in df.columns]).limit(n)
    return top.withColumn("total_rows", F.lit(total).cast("bigint"))


def inspect_raw_decoded(L: Ledger, n: int = 5) -> DataFrame:
    """Newest events with raw and decoded topics and payload side by side."""
    ev = L.contract_events
    return ev.select("closed_at", "transaction_hash", "topics", "topics_decoded", "data", "data_decoded").orderBy(
        F.col("closed_at").desc(), "transaction_hash"
    ).limit(n)
