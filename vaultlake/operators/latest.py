"""Latest state per key.

`latest_per_key` is the `ROW_NUMBER() OVER (PARTITION BY key ORDER BY t DESC) = 1` pattern written
as an aggregate: max over a struct whose leading fields are the ordering columns.  The aggregate
runs partially on the map side, so a key holding a large share of the rows never lands whole in
one task (a window would sort the entire key in one partition).  Ties are broken by the remaining
struct fields, which makes the result deterministic.

`latest_with_ties` keeps every row at the maximum (SQL `x = (SELECT MAX(x) ... same key)`): a
partial max per key, then an equi-join back on (key, max).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], carry: Sequence[str]
) -> DataFrame:
    """One row per `keys`: the row with the largest `order` tuple; `carry` columns come along
    (and break remaining ties by value).  Output columns: keys + order names + carry."""
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    names = [f"__o{i}" for i in range(len(order_cols))]
    packed = F.struct(*[c.alias(n) for c, n in zip(order_cols, names)], *[F.col(c) for c in carry])
    out = df.groupBy(*keys).agg(F.max(packed).alias("__latest"))
    sel = [F.col(k) for k in keys]
    for o, n in zip(order, names):
        if isinstance(o, str):
            sel.append(F.col(f"__latest.{n}").alias(o))
    sel += [F.col(f"__latest.{c}").alias(c) for c in carry]
    return out.select(*sel)


def latest_with_ties(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    top = df.groupBy(*keys).agg(F.max(order_col).alias("__top"))
    top = top.select(*[F.col(k).alias(f"__t_{k}") for k in keys], "__top")
    cond = [F.col(k) == F.col(f"__t_{k}") for k in keys] + [F.col(order_col) == F.col("__top")]
    return df.join(top, cond, "left_semi")
