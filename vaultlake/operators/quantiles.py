"""Quantiles per key without a key's rows in one task.

`exact_quantiles` first counts equal values (combined before the shuffle), so an aggregate holds distinct
values only.  `quantile_sketches` gives one mergeable KLL sketch per key, small at any number of rows; sketches
of fine keys (day and contract) are rolled up to coarser ones by `rolled_up`.  With `k` = 200 a quantile's
rank is off by about 1.3 % of the rows at most (99 % confidence).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`keys`, rows, and one column per name in `shares`: the interpolated quantile of the non-null `value`s."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    found = F.percentile(F.col(value), F.array(*[F.lit(s) for s in shares.values()]), F.col("__n"))
    out = counted.groupBy(*keys).agg(F.sum("__n").alias("rows"), found.alias("__q"))
    return out.select(*keys, "rows", *[F.round(F.col("__q")[i], 6).alias(n) for i, n in enumerate(shares)])


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 200) -> DataFrame:
    """`keys`, sketch: a KLL sketch of the whole-number `value`s."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """`keys`, rows, and one column per name in `shares`, from merged sketches."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch").alias("__s"))
    picked = [F.kll_sketch_get_quantile_bigint("__s", F.lit(s)).alias(n) for n, s in shares.items()]
    return merged.select(*keys, F.kll_sketch_get_n_bigint("__s").alias("rows"), *picked)
