"""Best-fit packing of documents into sequences of several permitted lengths.

A document's length is its UTF-8 bytes (byte-level tokens) and one end mark; longer documents than
the largest permitted length are cut into pieces of that length, so that no text is lost.  Pieces are
dealt out by hash to shards of about `SHARD` tokens, longest first, and each shard is packed by one
task on its own: a piece goes into the open bin with the least room that still holds it; if none
does, a new bin is opened.  Its size is the one with the least cost for each token that it can still
get.  The shard is packed once for each smallest size that may be opened, and the cheapest packing
counts; in the end every bin is cut down to the smallest permitted length that holds its contents.

The cost of a sequence of c tokens is OPEN + c + c * c / QUADRATIC: a fixed part, a linear one and
one for attention.

Defined cases: a null or empty text is one piece of one token (the end mark).  Equal rows are packed
each.  A null doc_id is kept.  Without documents there are no rows.  Other columns are neither read
nor returned.  A shard with more than `MOST` pieces is packed in parts of that size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import body, checkpointed, sorted_groups

SIZES = (2_048, 8_192, 32_768)
OPEN, QUADRATIC = 256, 65_536
SHARD = 64_000_000
MOST = 200_000


def cost(size: int) -> float:
    return OPEN + size + size * size / QUADRATIC


def pack(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int]]:
    """`lengths` from the longest to the shortest.  Returns the bin of each, and the bins' sizes."""
    plans = [_pack_from(lengths, sizes, i) for i in range(len(sizes))]
    return min(plans, key=lambda p: sum(map(cost, p[1])))


def _pack_from(lengths: list[int], sizes: tuple[int, ...], smallest: int) -> tuple[list[int], list[int]]:
    rooms: list[tuple[int, int]] = []  # (room, bin), by room
    used: list[int] = []
    out, left = [], sum(lengths)
    for n in lengths:
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fit = [c for c in sizes[smallest:] if c >= n]
            room, b = min(fit, key=lambda c: cost(c) / min(c, left)), len(used)
            used.append(0)
        used[b] += n
        left -= n
        if room > n:
            insort(rooms, (room - n, b))
        out.append(b)
    return out, [next(c for c in sizes if c >= n) for n in used]


def _pack_shards(sizes: tuple[int, ...]):
    def run(batches):
        part, last = 0, None
        for t in sorted_groups(batches, ["shard"], MOST):
            shard = t.column("shard")[0].as_py()
            part = part + 1 if shard == last else 0
            last = shard
            lengths = t.column("length").to_pylist()
            bins, caps = pack(lengths, sizes)
            ends = [0] * len(caps)
            offsets = []
            for b, n in zip(bins, lengths):
                offsets.append(ends[b])
                ends[b] += n
            t = t.combine_chunks()
            cols = [t.column(k).combine_chunks() for k in ("doc_id", "piece", "start", "length")]
            cols += [pa.array([f"{shard}-{part}-{b}" for b in bins]), pa.array([caps[b] for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
            yield from pa.table(cols, names=["doc_id", "piece", "start", "length", "bin", "size", "offset"]).to_batches()

    return run


def best_fit(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard: int = SHARD) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, piece (from 0), start (in bytes), length
    (tokens), bin, size (permitted length of the bin), offset (of the piece in its bin)."""
    sizes = tuple(sorted(sizes))
    largest = sizes[-1]
    whole = docs.select("doc_id", (F.octet_length(body("text")) + 1).cast("long").alias("tokens"))
    pieces = checkpointed(
        whole.withColumn("piece", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {largest}L)"))).select(
            "doc_id", "piece", (F.col("piece") * largest).alias("start"),
            F.least(F.col("tokens") - F.col("piece") * largest, F.lit(largest).cast("long")).alias("length"),
        )
    )
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    return ordered.mapInArrow(
        _pack_shards(sizes), "doc_id long, piece long, start long, length long, bin string, size long, offset long"
    )
