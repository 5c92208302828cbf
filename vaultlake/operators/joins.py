"""Joins against small derived tables with a checked size.

Dimensions (vault registry, vault metadata, price table, daily series) are computed once per
Ledger, persisted (memory, spilling to disk; blocks lost with an executor are recomputed from
their lineage) and counted in the same job.  Only a dimension whose counted row count is within the
limit, and whose measured size in bytes is too, is broadcast; a larger one falls back to a shuffled
join, where AQE can still switch strategy at run time.  `checkpoint_small` is the variant that cuts lineage by writing to the
cluster's checkpoint folder, for dimensions at the end of a long plan.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlake.session import ensure_checkpoint_dir

_ROWS_ATTR = "_vaultlake_rows"
#: Bytes of a broadcast at most (Spark's own limit is 8 GB).
MAX_BROADCAST_BYTES = 512 << 20


def _known_rows(df: DataFrame) -> int | None:
    return getattr(df, _ROWS_ATTR, None)


def keep_rows(df: DataFrame, of: DataFrame) -> DataFrame:
    """`df`, a projection or restriction of `of`, with the row count of `of` as its bound."""
    if _known_rows(of) is not None:
        setattr(df, _ROWS_ATTR, _known_rows(of))
    return df


def plan_bytes(df: DataFrame) -> int | None:
    """Size that the optimiser knows for `df` (measured, for what is persisted); None if it doesn't."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 50 else None


def materialize(df: DataFrame) -> DataFrame:
    """Persist `df` and record its row count on the DataFrame object (one job)."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    setattr(df, _ROWS_ATTR, df.count())
    return df


def checkpoint_small(df: DataFrame) -> DataFrame:
    """Persist, write a reliable checkpoint to the cluster's checkpoint folder (lineage cut: a lost
    executor re-reads the files instead of recomputing the plan), and record the row count."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
    setattr(out, _ROWS_ATTR, out.count())
    df.unpersist()
    return out


def row_count(df: DataFrame) -> int:
    known = _known_rows(df)
    if known is not None:
        return known
    return df.count()


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` with a broadcast hint if it holds at most `max_rows` rows (counted, not estimated) and is
    not known to be larger than MAX_BROADCAST_BYTES."""
    return F.broadcast(df) if row_count(df) <= max_rows and (plan_bytes(df) or 0) <= MAX_BROADCAST_BYTES else df


def semi_join(big: DataFrame, keys: DataFrame, big_col: str, key_col: str, max_rows: int) -> DataFrame:
    """Rows of `big` whose `big_col` occurs in `keys[key_col]` (SQL `IN (SELECT ...)`).  The key
    set is bounded by the row count of `keys` when that is known."""
    k = keys.select(F.col(key_col).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    hint = bounded(keep_rows(k, keys), max_rows)
    return big.join(hint, big[big_col] == F.col("__k"), "left_semi")
