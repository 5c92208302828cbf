"""As-of join: each row with the newest earlier-or-equal row of another table with its key.

Both tables are laid on one axis and cut into slices like the ordered operators (a hot key is spread over the
slices); inside a slice the last value is carried forward, and what reaches a slice from the ones before
comes from a table with one row per (key, slice).  One exchange for the rows, none of pairs of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.operators.ordered import _runs, _same_run


def asof_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
    order: Sequence[str] = (), partitions: int | None = None, cuts_of: DataFrame | None = None,
) -> DataFrame:
    """`left` with `values` of the newest row of `right` at or before `left_time`; NULL where there is none.  Of
    right rows of one time the largest by `order`, then `values`, counts.  Rows without a key or time match
    nothing; every left row stays, repeated ones too.  `cuts_of`: rows with `left_time` that are cheaper to
    compute than `left`; the slices are cut by them."""
    key, values = list(key), list(values)
    known = F.lit(True)
    for k in [*key, right_time]:
        known = known & F.col(k).isNotNull()
    pick = F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    r = right.where(known).groupBy(*key, F.col(right_time).alias("__t")).agg(pick.alias("__r")).withColumn("__side", F.lit(0))
    l = left.select(*key, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    both = l.unionByName(r, allowMissingColumns=True)
    cuts = None if cuts_of is None else cuts_of.select(F.col(left_time).alias("__t"))
    rows, w = _runs(both, key, ["__t", "__side"], partitions, cuts)
    so_far = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("__here", so_far)
    edge = F.max(F.when(F.col("__side") == 0, F.struct("__t", "__r")))
    before = Window.partitionBy(*key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("__pid", *key).agg(edge.alias("__e")).select("__pid", *key, F.last("__e", ignorenulls=True).over(before).alias("__before"))
    out = _same_run(rows.where(F.col("__side") == 1), runs, key)
    found = F.when(F.col("__t").isNotNull(), F.coalesce(F.col("__here"), F.col("__before.__r")))
    out = out.select("__l", found.alias("__f"))
    return out.select("__l.*", *[F.col(f"__f.v{i}").alias(v) for i, v in enumerate(values)])
