"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers floor(SCALE * x).  Rows are put into blocks of about
`BLOCK_ROWS`; for each block and dimension the index holds the bits of (value + offset) as slices,
one bitmap over the block's rows per bit.  For a query, each component's signed binary digits pick
slices (or their complements, for negative digits); picked slices of equal weight are added with
carry-save adders, which are bitmap operations, until one slice per weight is left: the bit slices
of every row's score plus a constant of the query.  The top k of a block are selected from the most
significant slice downward by bit counts; rows that tie at the boundary are resolved by their ids.
Scores of the selected rows come from the slices.  The blocks' winners are merged per query.

Queries are a stated subset of the rows, in blocks too; a task handles one pair of blocks, so memory
is bounded by the two.  Only k rows per query and block are shuffled to the merge.

Defined cases: vectors that are null or hold null or non-finite components take no part.  Shorter
vectors, empty ones too, count as filled with 0.  Scores are compared exactly (up to 125 bits); one
that does not fit a long is returned as the nearest long, and a quantised component counts as that too.  Rows with equal vec_id are rows of their own: each is a query with its own ranking,
and a candidate for the others.  Equal scores go by vec_id.  A null vec_id takes no part.  An empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlake.llm.common import checkpointed, sorted_groups

SCALE = 64
LONG, LOW = (1 << 63) - 1, (1 << 62) - 1
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 256


def quantised(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))  # beyond 64 bits: the nearest long


def usable(vector: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def nearest(n: int) -> int:
    return max(-LONG - 1, min(LONG, n))


class Slices:
    """Bit slices of one block: ones[d][b] is the bitmap of bit b of values[:, d] + offset."""

    def __init__(self, values: np.ndarray):
        rows, dims = values.shape
        self.rows, self.words = rows, -(-rows // 64)
        self.offset = max(0, -int(values.min())) if values.size else 0
        top = int(values.max()) + self.offset if values.size else 0
        self.bits = max(1, top.bit_length())
        self.ones = np.zeros((dims, self.bits, self.words), dtype=np.uint64)
        for d in range(dims):
            shifted = values[:, d].astype(np.uint64) + np.uint64(self.offset)  # modulo 2^64
            for b in range(self.bits):
                self.ones[d, b].view(np.uint8)[: -(-rows // 8)] = np.packbits((shifted >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
        self.zeros = ~self.ones

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
        """Slices of score + constant by weight, and the constant."""
        piles: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d, q in enumerate(query.tolist()):
            constant += q * self.offset
            for weight, sign in digits(q):
                if sign > 0:
                    slices = self.ones[d]
                else:  # -v = complement - (2^bits - 1)
                    slices = self.zeros[d]
                    constant += ((1 << self.bits) - 1) << weight
                for b in range(self.bits):
                    piles.setdefault(weight + b, []).append(slices[b])
        out: list[np.ndarray | None] = []
        weight = 0
        while piles:
            pile = piles.pop(weight, [])
            up = piles.get(weight + 1, [])
            carried = []
            while len(pile) > 2:  # full adder: three slices of a weight are one of it and one of the next
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                x = a ^ b
                carried.append((a & b) | (x & c))
                pile.append(x ^ c)
            if len(pile) == 2:
                a, b = pile
                carried.append(a & b)
                pile = [a ^ b]
            out.append(pile[0] if pile else None)
            if up or carried:
                piles[weight + 1] = up + carried
            weight += 1
        return out, constant

    def top(self, slices: list, k: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the rows surely among the k best allowed ones, and of those that tie for the rest."""
        sure, tied = np.zeros(self.words, dtype=np.uint64), allowed.copy()
        for s in reversed(slices):
            if s is None:
                continue
            high = tied & s
            n = int(np.bitwise_count(sure | high).sum())
            if n > k:
                tied = high
            else:
                sure = sure | high
                tied = tied & ~s
                if n == k:
                    return sure, np.zeros_like(sure)
        return sure, tied

    def value(self, slices: list, rows: np.ndarray) -> list[int]:
        out = np.zeros(len(rows), dtype=object)
        for weight, s in enumerate(slices):
            if s is not None:
                out += ((s[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(object) * (1 << weight)
        return out.tolist()


def digits(q: int) -> list[tuple[int, int]]:
    """Signed binary digits (weight, +1 or -1) with no two next to each other."""
    out, weight = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            out.append((weight, d))
            q -= d
        q >>= 1
        weight += 1
    return out


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best_of_block(ids: np.ndarray, rows: np.ndarray, index: Slices, queries: list[tuple[int, int, np.ndarray]], k: int):
    """(query row, query_id, vec_id, score, its high and low parts) of each query's k best rows of the block; `ids` ascending."""
    full = np.zeros(index.words, dtype=np.uint64)
    full.view(np.uint8)[: -(-index.rows // 8)] = np.packbits(np.ones(index.rows, dtype=np.uint8), bitorder="little")
    place = {row: at for at, row in enumerate(rows.tolist())}
    for query_row, query_id, q in queries:
        slices, constant = index.scores(q)
        allowed = full.copy()
        own = place.get(query_row)
        if own is not None:
            allowed[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
        sure, tied = index.top(slices, k, allowed)
        best = positions(sure)
        best = np.concatenate([best, positions(tied)[: k - len(best)]])  # rows are in the order of ids
        for r, v in zip(best.tolist(), index.value(slices, best)):
            yield query_row, query_id, int(ids[r]), *(nearest(x) for x in (v - constant, (v - constant) >> 62)), (v - constant) & LOW


def _matrix(vectors: list, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pack(dims: int):
    def run(batches):
        for t in sorted_groups(batches, ["block"]):
            ids, rows = (np.array(t.column(c).to_pylist(), dtype=np.int64) for c in ("vec_id", "row"))
            values = _matrix(t.column("v").to_pylist(), dims)
            small = not values.size or max(abs(int(values.min())), abs(int(values.max()))) < 1 << 31
            packed = [ids.tobytes(), rows.tobytes(), (values.astype(np.int32) if small else values).tobytes()]
            block = pa.array([t.column("block")[0].as_py()], pa.int64())
            yield pa.RecordBatch.from_arrays([block, *[pa.array([x], pa.binary()) for x in packed]], ["block", "ids", "rows", "vectors"])

    return run


def _unpack(ids: bytes, rows: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = np.frombuffer(ids, dtype=np.int64)
    kind = np.int64 if len(vectors) == 8 * dims * len(out) else np.int32
    return out, np.frombuffer(rows, dtype=np.int64), np.frombuffer(vectors, dtype=kind).reshape(len(out), dims).astype(np.int64)


def _search(k: int, dims: int):
    def run(batches):
        last, index, ids, rows = None, None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                block, *own = (batch.column(i)[at].as_py() for i in range(4))
                if block != last:
                    ids, rows, values = _unpack(*own, dims)
                    last, index = block, Slices(values)
                query_ids, query_rows, queries = _unpack(*(batch.column(i)[at].as_py() for i in range(4, 7)), dims)
                found = list(best_of_block(ids, rows, index, list(zip(query_rows.tolist(), query_ids.tolist(), queries)), k))
                cols = list(zip(*found)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_row", "query_id", "vec_id", "score", "high", "low"])

    return run


def _blocks(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """Rows as packed blocks of about `size`, in the order of vec_id inside a block."""
    count = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "vec_id", "row")
    return checkpointed(dealt.mapInArrow(_pack(dims), "block long, ids binary, rows binary, vectors binary"))


def top_k(vectors: DataFrame, query: Column, k: int, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` (vec_id, embedding) that `query`
    marks, the k other rows with the largest integer inner product."""
    rows = checkpointed(
        vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select(
            F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding", scale).alias("v"), query.alias("asked"), F.monotonically_increasing_id().alias("row")
        )
    )
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 1
    index = _blocks(rows.select("vec_id", "row", "v"), dims, block_rows)
    asked = _blocks(rows.where("asked").select("vec_id", "row", "v"), dims, block_queries)
    blocks = max(1, -(-rows.count() // block_rows))
    asked = asked.select(F.col("block").alias("part"), F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"), F.col("vectors").alias("queries"))
    # every query block goes to every row block once; a task gets pairs of one row block at a time
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(index, "block")
    pairs = pairs.repartition("block", "part").sortWithinPartitions("block", "part").select(
        "block", "ids", "rows", "vectors", "query_ids", "query_rows", "queries"
    )
    found = pairs.mapInArrow(_search(k, dims), "query_row long, query_id long, vec_id long, score long, high long, low long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
