"""Order-dependent values (previous row, next row, global position) per key without putting a
whole key into one task.

A plain `Window.partitionBy(key).orderBy(t)` sends every row of a key to one task; with one key
holding a third of the data that task is the job.  Here each row gets a segment number from its
position on the ordering axis: slices between approximate quantiles of the first order column, from
one scalar subquery, so a burst of rows is cut into as many slices as its rows need (rows that share
one value stay together).  Any cuts give the same result; they only decide how rows are dealt out.
Keys are compared null-safely, so rows without a key form a key of their own, as in a window.
Windows run per (key, segment), so a hot key is spread over many tasks; only the first (or last)
row of each (key, segment) run needs a value from a neighbouring segment, and those come from a
small table with one row per run, ordered by segment within the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of the axis at most.
MOST_SLICES = 64


def _same_run(r: DataFrame, runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """`runs` joined to its rows; keys are equal null-safely."""
    names = ["__pid", *key]
    runs = runs.withColumnsRenamed({k: f"__of_{k}" for k in names})
    cond = F.col("__pid") == F.col("__of___pid")
    for k in key:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return r.join(runs, cond, "left").drop(*[f"__of_{k}" for k in names])


def _axis(df: DataFrame, col: str) -> Column:
    """Numeric position of the first order column (micros for timestamps/dates)."""
    t = dict(df.dtypes)[col]
    c = F.col(col)
    if t.startswith("timestamp") or t == "date":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
    return c.cast("bigint")


def _runs(
    df: DataFrame, key: Sequence[str], order: Sequence[str], partitions: int | None, cuts_of: DataFrame | None = None
) -> tuple[DataFrame, Window]:
    """`df` with its segments, and the window of a run.  `cuts_of`: rows with the first order column that are
    cheaper to compute than `df`; the cuts are taken from them."""
    spark = df.sparkSession
    n = min(MOST_SLICES, (partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))) * 4)
    pos = _axis(df, order[0])
    # one scalar subquery (a single scan) for the cuts
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = (df if cuts_of is None else cuts_of).select(pos.alias("__x")).agg(F.percentile_approx("__x", shares, F.lit(1000))).scalar()
    r = df.withColumn("__cuts", cuts).withColumn("__at", pos)
    r = r.withColumn("__pid", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__at"))), F.lit(-1)).cast("bigint"))
    r = r.drop("__cuts", "__at")
    w = Window.partitionBy("__pid", *key).orderBy(*order)
    return r, w


def lag_by_key(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "prev_",
    partitions: int | None = None,
    lead: bool = False,
) -> DataFrame:
    """Add `prev_<v>` (or the next row's value with lead=True) for each v in `values`, per `key`
    in `order` (which should be unique within a key)."""
    key, order, values = list(key), list(order), list(values)
    r, w = _runs(df, key, order, partitions)
    fn = F.lead if lead else F.lag
    r = r.withColumn("__lrn", F.row_number().over(w)).withColumn("__lcnt", F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    for v in values:
        r = r.withColumn(f"__loc_{v}", fn(F.col(v)).over(w))
    # boundary table: first/last row of each (partition, key) run
    pick = F.struct(*[F.col(o) for o in order], *[F.col(v).alias(f"__b_{v}") for v in values])
    runs = r.groupBy("__pid", *key).agg((F.max(pick) if not lead else F.min(pick)).alias("__edge"))
    wk = Window.partitionBy(*key).orderBy("__pid")
    neighbour = F.lead("__edge").over(wk) if lead else F.lag("__edge").over(wk)
    runs = runs.select("__pid", *key, neighbour.alias("__nb"))
    at_edge = (F.col("__lrn") == F.col("__lcnt")) if lead else (F.col("__lrn") == 1)
    out = _same_run(r, runs, key)
    sel = [c for c in df.columns]
    for v in values:
        sel.append(F.when(at_edge, F.col(f"__nb.__b_{v}")).otherwise(F.col(f"__loc_{v}")).alias(f"{prefix}{v}"))
    return out.select(*sel)


def position_by_key(
    df: DataFrame, key: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Add `__rn` (1-based position within key) and `__cum_<s>` (running sum up to the row) for
    each s in `sums`."""
    key, order, sums = list(key), list(order), list(sums)
    r, w = _runs(df, key, order, partitions)
    run_frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("__lrn", F.row_number().over(w))
    for s in sums:
        r = r.withColumn(f"__lsum_{s}", F.sum(s).over(run_frame))
    runs = r.groupBy("__pid", *key).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.partitionBy(*key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "__pid", *key,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        *[F.sum(f"__t_{s}").over(before).alias(f"__soff_{s}") for s in sums],
    )
    out = _same_run(r, runs, key)
    cols: list[Column | str] = list(df.columns)
    cols.append((F.col("__lrn") + F.col("__off")).alias("__rn"))
    for s in sums:
        cols.append(
            F.when(F.col(f"__soff_{s}").isNull(), F.col(f"__lsum_{s}"))
            .otherwise(F.col(f"__lsum_{s}") + F.col(f"__soff_{s}"))
            .alias(f"__cum_{s}")
        )
    return out.select(*cols)


def rolling_mean_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, rows: int, out: str, partitions: int | None = None
) -> DataFrame:
    """Mean of `value` over the current row and up to rows-1 preceding rows of the same key
    (SQL `AVG(v) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN rows-1 PRECEDING AND CURRENT ROW)`),
    from running sums: (S[n] - S[n-rows]) / min(n, rows).  The lookup of S[n-rows] is an equi-join
    on (key, position), which has no hot key.  `value` must not be NULL."""
    key = list(key)
    p = position_by_key(df, key, order, [value], partitions)
    back = p.select(*[F.col(k).alias(f"__k_{k}") for k in key], (F.col("__rn") + rows).alias("__rn_t"), F.col(f"__cum_{value}").alias("__cum_back"))
    cond = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key] + [F.col("__rn") == F.col("__rn_t")]
    j = p.join(back, cond, "left")
    total = F.col(f"__cum_{value}") - F.coalesce(F.col("__cum_back"), F.lit(0))
    mean = total / F.least(F.col("__rn"), F.lit(rows))
    return j.select(*df.columns, mean.alias(out))
