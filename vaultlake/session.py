"""Spark session settings for running the jobs, and checkpoint-folder handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.ui.enabled": "false",
    # plans spell out the derivation of the payloads; a long session would keep the texts of 1,000 of them
    "spark.sql.ui.retainedExecutions": "20",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "vaultlake", **conf):
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k: str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's `spark.checkpoint.dir`; only when none is configured and the master is local
    (one machine, tests) create a private folder under the system temp directory.  On a cluster a
    missing setting is an error: a machine-local folder would be a different one on each executor."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
    path = tempfile.mkdtemp(prefix="vaultlake-ckpt-", dir=os.environ.get("VAULTLAKE_LOCAL_TMP", "/tmp"))
    sc.setCheckpointDir(path)
    return path
