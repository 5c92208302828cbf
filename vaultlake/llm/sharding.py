"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id, row number), 192 bits that tell all rows apart;
rows with equal texts lie together.  A splitter is a boundary in this order.  To find the splitters:

* each round lays `2^STEP` candidate boundaries evenly into the interval that is left for each
  splitter, and counts the exact bytes below each, over all partitions at once (one aggregate; only
  intervals that are still open are read on, and `2^STEP` rows of each come to the driver);
* a splitter is settled when the bytes below a candidate differ from its aim by `tolerance` of a
  shard at most; otherwise the interval shrinks to the one that holds the aim.  Where all bytes of an
  interval belong to one hash, the search goes on with the next part of the order at once, so a text
  with very many copies is cut inside.  An interval of one row is settled at its nearer end.

Then the rows, with their shards, are exchanged once, by ranges of the order; the ranges are as many as
Spark wants, so a shard is dealt out over many tasks, and the place in the shard follows from the row
counts of the ranges.

All DataFrame operations.  Shards hold equal bytes up to twice the tolerance plus one document.

Defined cases: a null text has no bytes, so its size is 1 (each document's size is its bytes plus 1);
it is ordered like an empty one.  Ids may be null or repeat.  Where there are fewer documents than shards,
or one document outweighs a shard, some shards are empty.  Without documents there are no rows.
Other columns are neither read nor returned, unless they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import body, checkpointed, numbered_in_order

SHARDS = 16
#: Share of a shard's bytes by which the bytes below a splitter may differ from its aim.
TOLERANCE = 0.002
#: Bits by which a round refines an interval.
STEP = 8
ORDER = ("__text", "__id", "__row")
TOP = -(1 << 63)


@dataclass
class Splitter:
    """Search state: the interval is all rows whose first `bits` bits of part `part` of the order, and
    the parts before it, are as in `prefix`; `below` bytes lie before it."""

    aim: int
    slack: float
    prefix: tuple[int, ...] = ()  # whole values of the parts before
    part: int = 0
    start: int = TOP  # least value of the current part
    bits: int = 0
    below: int = 0
    at: tuple[int, ...] | None = None  # the boundary, once settled: rows below it lie before

    def boundary(self, value: int) -> tuple[int, ...]:
        return (*self.prefix, value)

    def key(self) -> tuple:
        return (*self.prefix, self.start), self.bits


def _inside(prefix: tuple[int, ...], start: int, bits: int) -> Column:
    cond = F.lit(True)
    for name, value in zip(ORDER, prefix):
        cond = cond & (F.col(name) == value)
    if bits:
        cond = cond & F.col(ORDER[len(prefix)]).between(start, start + (1 << (64 - bits)) - 1)
    return cond


def _before(boundary: tuple[int, ...]) -> Column:
    """Whether a row lies below the boundary, compared part by part."""
    out = F.lit(False)
    for name, value in reversed(list(zip(ORDER, boundary))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _cell(part: int, bits: int) -> Column:
    """Number of the candidate interval that the row is in (values are signed: the least one is cell 0)."""
    return F.shiftrightunsigned(F.col(ORDER[part]).bitwiseXOR(F.lit(TOP)), 64 - bits - STEP).bitwiseAND((1 << STEP) - 1).cast("int")


def _histograms(rows: DataFrame, open_: list[Splitter]) -> dict[tuple, list]:
    """For each open interval: (cell, bytes, rows, least and largest value of the part) by cell."""
    intervals = {s.key(): s for s in open_}
    which, cell = F.lit(None).cast("int"), F.lit(None).cast("int")
    least = largest = F.lit(None).cast("long")
    for i, s in enumerate(intervals.values()):
        here = _inside(s.prefix, s.start, s.bits)
        which, cell = F.when(here, F.lit(i)).otherwise(which), F.when(here, _cell(s.part, s.bits)).otherwise(cell)
        least = F.when(here, F.col(ORDER[s.part])).otherwise(least)
    counted = (
        rows.select("size", which.alias("i"), cell.alias("cell"), least.alias("v")).where("i is not null")
        .groupBy("i", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    out: dict[tuple, list] = {k: [] for k in intervals}
    keys = list(intervals)
    for r in counted.collect():
        out[keys[r["i"]]].append((r["cell"], r["bytes"], r["n"], r["lo"], r["hi"]))
    return {k: sorted(v) for k, v in out.items()}


def _refine(s: Splitter, cells: list) -> None:
    """Settles the splitter at a candidate boundary that is near enough, or goes into the cell with its aim."""
    width = 1 << (64 - s.bits - STEP)
    below = s.below
    for cell, size, n, lo, hi in cells:
        end = below + size
        if end < s.aim:
            below = end
            continue
        first, last = s.start + cell * width, s.start + (cell + 1) * width
        near_first = s.aim - below <= end - s.aim
        off = min(s.aim - below, end - s.aim)
        if off <= s.slack or n == 1 or (lo == hi and s.part == len(ORDER) - 1):
            after = last if last < 1 << 63 else None
            # a boundary beyond the last value of a part is the end of this interval's rows
            s.at = s.boundary(first) if near_first else s.boundary(after) if after is not None else (*s.prefix, hi, (1 << 63) - 1)
        elif lo == hi:
            s.prefix, s.part, s.start, s.bits, s.below = s.boundary(lo), s.part + 1, TOP, 0, below
        else:
            s.start, s.bits, s.below = first, s.bits + STEP, below
        return
    raise AssertionError("the aim lies within its interval")


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Boundaries between `shards` shards of `rows` (the parts of the order, size)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    found = [Splitter(aim=-(-total * i // shards), slack=tolerance * total / shards) for i in range(1, shards)]
    while open_ := [s for s in found if s.at is None]:
        cells = _histograms(rows, open_)
        for s in open_:
            _refine(s, cells[s.key()])
    return [s.at for s in found]


def shard_rows(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of `docs` (doc_id, text), size, text_crc32, law, shard, slot, grown_shard; one row each."""
    utf8 = F.encode(body("text"), "utf-8")
    taken = docs.select(
        *columns, (F.length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"),
        F.xxhash64(body("text")).alias("__text"), F.xxhash64("doc_id").alias("__id"), F.monotonically_increasing_id().alias("__row"),
    )
    rows = checkpointed(taken)
    cuts = splitters(rows, shards, tolerance)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (~_before(cut)).cast("int")
    dealt = numbered_in_order(rows.withColumn("shard", shard), [F.asc(k) for k in ORDER])
    held = dealt.groupBy("shard").agg(F.min("number").alias("__first")).withColumnRenamed("shard", "__shard")  # `shards` rows
    return dealt.join(F.broadcast(held), F.col("shard") == F.col("__shard")).select(
        *columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("number") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Writes all columns of `docs` (doc_id, text) below `path`, one folder shard=<n> each, in the order of
    slot within each file, and reads them back.  The text goes through the one exchange."""
    names = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    out = shard_rows(docs, shards, tolerance, tuple(names)).select(*names, "size", "shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
