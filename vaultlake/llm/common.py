"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.session import ensure_checkpoint_dir

#: Runs of these characters separate words.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the cluster's shared checkpoint folder: later steps, and tasks repeated
    after a lost executor, read the files and compute nothing again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet (compressed, unlike a checkpoint) below the cluster's shared
    checkpoint folder, and read again."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with `number`, the place of each row (from 0) in the total order `order`, which must tell
    all rows apart.  One range exchange; no task holds more than its range, and only the row count of
    each range comes to the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("long")
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__part long, __before long")  # one row per range
    within = F.col("__at").bitwiseAND((1 << 33) - 1)
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn("number", within + F.col("__before")).drop("__at", "__part", "__before")
    )


def held_in(doc_id: str, mod: int, held_out_at: int) -> Column:
    """True for the rows a model may learn from: crc32 of the id's text, modulo `mod`, is not
    `held_out_at`.  A null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod != held_out_at, F.lit(False))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """The groups of rows with equal `keys`, from batches sorted by them, one at a time; with `most`,
    a group comes in parts of about so many rows, so that only one part is in memory."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k) for k in keys]
        cuts = [0]
        if batch.num_rows > 1:
            change = None
            for c in columns:
                differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
                change = differs if change is None else change | differs
            cuts += (change.nonzero()[0] + 1).tolist()
        for start, end in zip(cuts, [*cuts[1:], batch.num_rows]):
            key = tuple(c[start].as_py() for c in columns)
            if pending and (key != last or most and sum(x.num_rows for x in pending) >= most):
                yield pa.Table.from_batches(pending)
                pending = []
            last = key
            pending.append(batch.slice(start, end - start))
    if pending:
        yield pa.Table.from_batches(pending)
