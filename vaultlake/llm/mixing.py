"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of md5(doc_id), form blocks of `BLOCK` documents.  Time runs in
slots, one block each.  With weight w, the source's block j (from 1) is released at floor((j-1)/w)
and due at ceil(j/w); each slot goes to the released block that is due first (ties: the larger
weight, then the source's name).  On one processor this meets every deadline, so at any time a
source is less than one block away from its weight's share.

Weights are taken exactly, as fractions.  When a source has no blocks left the others go on with
their weights scaled up, which is the next phase.  The mix ends when the sources that are left have
less than `min_weight` of the weight: what follows is in no mix and has in_mix = false, but keeps
its place in the order.

With `parts` the weights are first rounded to whole parts of it: the schedule then repeats after
`parts` slots, one period is all that is planned and every block finds its slot by arithmetic, but
the bound of one block holds for the rounded weights.

The schedule is made on the driver from one row per source, in time proportional to the blocks; it is
written to the shared checkpoint folder in runs of `SLOTS`, so the driver holds no more than one.
Documents are numbered within (source, part of the md5 range), so no task holds a whole source.  All
DataFrame operations, and the text is not read.

Defined cases: a null source is a source of its own.  A source without a given weight has weight 0:
its documents follow after the mix.  Equal or null doc_ids are numbered in any order, one place
each.  Without documents there are no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaultlake.llm.common import checkpointed
from vaultlake.session import ensure_checkpoint_dir

BLOCK = 8
#: Exponent of the default target weights: below 1, small sources weigh more than their share.
ALPHA = 0.7
MIN_WEIGHT = 0.5
#: Documents that a task numbers at once, about.
RUN = 20_000
#: Slots that the driver holds at once.
SLOTS = 200_000


def whole_parts(weights: dict, parts: int) -> dict:
    """The weights as whole parts with sum `parts` (largest remainders), at least one part each."""
    parts = max(parts, 2 * len(weights))
    total, free = sum(weights.values()), parts - len(weights)
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], str(s)))[: parts - sum(out.values())]:
        out[s] += 1
    return out


def exact_parts(weights: dict) -> dict:
    """The weights (above 0) as whole numbers in exactly their proportion."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * common) for s, w in exact.items()}


def earliest_deadline_first(share: dict) -> Iterator:
    """The source of each slot, without end.  `share`: whole parts by source.  Some block is always
    released, because the weights sum to one."""
    total = sum(share.values())
    release = lambda s, j: (j - 1) * total // share[s]
    due = lambda s, j: -(-j * total // share[s])
    names = sorted(share, key=lambda s: (-share[s], s is None, str(s)))
    waiting = [(0, k, 1) for k in range(len(names))]
    ready: list = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(names[k], j), k, j))
        _, k, j = heapq.heappop(ready)
        yield names[k]
        heapq.heappush(waiting, (release(names[k], j + 1), k, j + 1))
        t += 1


def period(share: dict) -> list:
    """One period: the source of each of its slots."""
    return list(islice(earliest_deadline_first(share), sum(share.values())))


def schedule(counts: dict, weights: dict, block: int, min_weight: float) -> Iterator[tuple]:
    """Rows (source, block, slot, in_mix), one per block, by slot, with the weights as they are."""
    left = {s: -(-n // block) for s, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    active = {s: Fraction(weights[s]) for s in left if weights.get(s)}
    whole = sum(active.values())
    slot, in_mix = 0, True
    while left:
        if not active:  # what has no weight follows by its share
            active, in_mix = {s: Fraction(n) for s, n in left.items()}, False
        in_mix = in_mix and sum(active.values()) >= Fraction(min_weight) * whole
        for s in earliest_deadline_first(exact_parts(active)):
            if not left[s]:  # the phase ends where a source would need a block that it does not have
                break
            yield s, done[s], slot, in_mix
            done[s] += 1
            left[s] -= 1
            slot += 1
        for s in [s for s, n in left.items() if not n]:
            del left[s], active[s]


def _stored(spark: SparkSession, rows: Iterator[tuple]) -> DataFrame:
    """The schedule as a table (s, b, slot, in_mix) in the shared checkpoint folder."""
    home = f"{ensure_checkpoint_dir(spark)}/mix-{uuid.uuid4().hex}"
    types = {"s": pa.string(), "b": pa.int64(), "slot": pa.int64(), "in_mix": pa.bool_()}
    some = True
    while some:
        some = list(islice(rows, SLOTS))
        columns = list(zip(*some)) or [()] * len(types)
        part = pa.table({k: pa.array(c, t) for c, (k, t) in zip(columns, types.items())})
        spark.createDataFrame(part, "s string, b long, slot long, in_mix boolean").write.mode("append").parquet(home)
        some = len(some) == SLOTS
    return spark.read.parquet(home)


def plan(counts: dict, weights: dict, block: int, parts: int, min_weight: float) -> list[tuple]:
    """Rows (source, first, held, per_period, n, start, total, slots, in_mix), one per phase and
    source: from its block `first` (from 0) on, `held` blocks fall into the phase; the n-th of
    every `per_period` blocks takes slot slots[n] of each period of `total` slots, from `start`."""
    left = {s: -(-n // block) for s, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    active = {s: Fraction(weights[s]) for s in left if weights.get(s)}
    whole = sum(active.values())
    rows, start, in_mix = [], 0, True
    while left:
        if not active:  # what has no weight follows by its share
            active, in_mix = {s: Fraction(n) for s, n in left.items()}, False
        in_mix = in_mix and sum(active.values()) >= Fraction(min_weight) * whole
        share = whole_parts(active, parts)
        total = sum(share.values())
        order = period(share)
        at: dict = {s: [] for s in share}
        for t, s in enumerate(order):
            at[s].append(t)
        # the phase ends where a source would need a block that it does not have
        end = min(left[s] // share[s] * total + at[s][left[s] % share[s]] for s in share)
        full, rest = divmod(end, total)
        for s in share:
            held = full * share[s] + sum(t < rest for t in at[s])
            if held:
                rows.append((s, done[s], held, share[s], start, total, at[s][:held], in_mix))
            done[s] += held
            left[s] -= held
            if not left[s]:
                del left[s], active[s]
        start += end
    return rows


def numbered(docs: DataFrame, n: int, run: int = RUN) -> DataFrame:
    """doc_id, source, number: the place (from 0) of each of the `n` documents among its source's, by
    md5(doc_id), then doc_id.  Counted by parts of the md5 range, so that a large source is dealt
    out over many tasks."""
    rows = docs.select("doc_id", "source", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("h"))
    digits = 1
    while 16**digits * run < n:
        digits += 1
    rows = rows.withColumn("part", F.substring("h", 1, digits))
    sizes = rows.groupBy("source", "part").count()
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")
    )
    within = F.row_number().over(Window.partitionBy("source", "part").orderBy("h", "doc_id")) - 1
    return (
        rows.withColumn("within", within)
        .join(sizes, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .select("doc_id", "source", "h", (F.col("within") + F.col("offset")).alias("number"))
    )


def _counts(docs: DataFrame) -> dict:
    return {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}


def default_weights(counts: dict, alpha: float = ALPHA) -> dict:
    return {s: n**alpha for s, n in counts.items()}


def mix_sources(
    docs: DataFrame, weights: dict | None = None, block: int = BLOCK, parts: int | None = None, min_weight: float = MIN_WEIGHT
) -> DataFrame:
    """Columns doc_id, source, block (from 0, within the source), slot, place (within the block),
    in_mix of `docs` (doc_id, source), one row each.  The mix is the order by (slot, place).
    `weights`: target weight by source; without it, the source's count to the power ALPHA.
    `parts`: round the weights to whole parts of it, see above."""
    spark = docs.sparkSession
    counts = _counts(docs)
    weights = weights or default_weights(counts)
    out = numbered(docs, sum(counts.values())).withColumn("block", F.expr(f"number div {block}"))
    place = (F.col("number") % block).alias("place")
    if parts is None:
        slots = _stored(spark, schedule(counts, weights, block, min_weight))
        mine = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
        return out.join(slots, mine).select("doc_id", "source", "block", "slot", place, "in_mix")
    phases = spark.createDataFrame(
        plan(counts, weights, block, parts, min_weight),
        "s string, first long, held long, per_period long, start long, total long, slots array<long>, in_mix boolean",
    )
    here = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("first") + F.col("held"))
    slot = F.expr("start + (block - first) div per_period * total + element_at(slots, cast((block - first) % per_period + 1 as int))")
    return out.join(F.broadcast(phases), here).select("doc_id", "source", "block", slot.alias("slot"), place, "in_mix")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are in the mix, all columns.  Of each source these are the first by
    (md5(doc_id), doc_id), so one row per source says where it ends and no text is shuffled."""
    order = F.struct(F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("h"), "doc_id")
    last = checkpointed(
        mix_sources(docs, **options).where("in_mix").groupBy(F.col("source").alias("__source")).agg(F.max(order).alias("__last"))
    )
    inside = docs["source"].eqNullSafe(F.col("__source")) & (
        F.struct(F.coalesce(F.md5(docs["doc_id"].cast("string")), F.lit("")).alias("h"), docs["doc_id"]) <= F.col("__last")
    )
    return docs.join(F.broadcast(last), inside, "left_semi")
