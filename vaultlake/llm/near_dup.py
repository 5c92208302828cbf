"""Near-duplicate documents by b-bit MinHash.

1. Each text gives its set of word shingles, `HASHES` minima over it, band keys of several minima
   each (as many and as long as the threshold asks for), and a packed signature of the low `BITS` bits of every minimum.  Equal sets form one class;
   only a class's smallest document goes on.
2. Classes that share a band key are candidates.  Inside a key, the number of equal signature slots
   (XOR and bit counts) estimates the similarity, corrected for the chance agreement of low bits;
   pairs far below the threshold are left out, and a spanning forest of the rest is kept, never all
   pairs.  Keys with very many classes are dealt out in pairs of blocks.
3. The forest's components are groups whose members are then compared on their full shingle sets;
   pairs that links already connect need no comparison.  Large groups are again dealt out in pairs
   of blocks of bounded size, and each block pair gives a spanning forest of its confirmed links.
4. Components of the confirmed links are the result.

Missed links: two sets at the threshold share no band key with probability `MISSED` at most, and the
estimate leaves such a pair out with probability 1e-5 (at 0.85; 7e-6 at 0.8); above the threshold
both fall quickly.

Defined cases: a null or blank text has an empty set and is linked with nothing.  A text shorter
than a shingle is one shingle.  Repeated rows come back as often as they occur.  Rows that share a
doc_id are one node of the graph, with the links of all their texts.  A null doc_id takes part in no link and is its own component
(null).  An empty table gives no rows.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import checkpointed, sorted_groups
from vaultlake.llm.graph import connected_components
from vaultlake.llm.shingles import mix, text_shingles

SHINGLE = 5
HASHES, BITS = 128, 2
#: Probability that a pair at the threshold may share no band key.
MISSED = 5e-7
#: Standard errors that the estimate may lie below the threshold before a pair is left out.
SLACK = 4.6
#: Classes of one band key, or documents and shingles of one group, that a task compares at once.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 2_000_000
_LOW = np.uint64(0x5555555555555555)

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_MUL = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, ((x[None, at : at + 2048] ^ _XOR) * _MUL).min(axis=1), out=least)
    return least


def signature(least: np.ndarray) -> bytes:
    """The low BITS bits of each (mixed) minimum, 32 slots to a 64-bit word."""
    slots = mix(least.astype(np.uint64)) & np.uint64(2**BITS - 1)
    return (slots.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).tobytes()


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the longest keys, and the fewest, that miss a pair at the threshold with
    probability `MISSED` at most."""
    for rows in range(HASHES, 0, -1):
        shared = (percent / 100) ** rows
        bands = math.ceil(math.log(MISSED) / math.log1p(-shared)) if shared < 1 else 1
        if bands * rows <= HASHES:
            return bands, rows
    raise ValueError(f"{HASHES} minima are too few for a threshold of {percent} %")


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = bands * rows
    parts = (least[:n].astype(np.uint64) * _BAND[:n]).reshape(bands, rows)
    return mix(parts.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def only_equal(n: int, percent: int) -> bool:
    """Whether a set of n shingles is similar enough to no other set: the nearest one has n + 1."""
    return 100 * n < percent * (n + 1)


def equal_slots(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of a signature and many others: how many slots agree."""
    differ = one ^ many
    return HASHES - np.bitwise_count((differ | (differ >> np.uint64(1))) & _LOW).sum(axis=-1, dtype=np.int64)


def least_slots(percent: int) -> int:
    """Equal slots from which a pair is compared: the expected number at the threshold, less SLACK
    standard errors.  Slots of different minima agree by chance once in 2^BITS."""
    p = percent / 100 + (1 - percent / 100) / 2**BITS
    return int(HASHES * p - SLACK * (HASHES * p * (1 - p)) ** 0.5)


def _describe(percent: int):
    bands, per_band = banding(percent)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = text_shingles(text.as_py(), SHINGLE)
                m = None if only_equal(len(s), percent) or doc_id is None else minima(s)
                digest = set_digest(s) if len(s) and doc_id is not None else None
                rows.append((doc_id, len(s), digest, None if m is None else signature(m), None if m is None else band_keys(m, bands, per_band)))
                if len(rows) == 2000:
                    yield _described(rows)
                    rows = []
            yield _described(rows)

    return run


def _described(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n_shingles", "digest", "sig", "bands"])


def _signatures(t: pa.Table) -> np.ndarray:
    raw = b"".join(t.column("sig").to_pylist())
    return np.frombuffer(raw, dtype=np.uint64).reshape(t.num_rows, -1)


def _pair_batch(pairs: list) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _emit(found):
    out: list = []
    for pairs in found:
        out += pairs
        if len(out) > 50_000:
            yield _pair_batch(out)
            out = []
    yield _pair_batch(out)


def forest(sig: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the graph that joins signatures with `least` equal slots or more."""
    if len(sig) == 2:
        return [(0, 1)] if equal_slots(sig[0], sig[1]) >= least else []
    left = np.arange(len(sig))
    edges = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        u = queue.pop()
        near = equal_slots(sig[u], sig[left]) >= least
        edges += [(u, int(v)) for v in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return edges


def _candidates(least: int):
    def run(batches):
        def found():
            for t in sorted_groups(batches, ["key", "i", "j"]):
                if t.num_rows > 1:  # two texts of one id are no candidates
                    ids = t.column("cid").to_pylist()
                    yield [(ids[u], ids[v]) for u, v in forest(_signatures(t), least) if ids[u] != ids[v]]

        yield from _emit(found())

    return run


class _Confirm:
    """Exact sizes of intersections for pairs of documents of one group."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes, self.bits = sets, np.array([len(s) for s in sets]), None
        if len(sets) < 8:
            return
        flat = np.concatenate(sets)
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        width = int(shared.sum()) // 64 + 1
        if width * len(sets) > 8_000_000:
            return
        place = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), self.sizes)
        keep = shared[inverse]
        at = place[inverse[keep]]
        word, bit = row[keep] * width + at // 64, np.uint64(1) << (at % 64).astype(np.uint64)
        self.bits = np.zeros(len(sets) * width, dtype=np.uint64)
        if len(word):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            self.bits[word[starts]] = np.bitwise_or.reduceat(bit, starts)
        self.bits = self.bits.reshape(len(sets), width)

    def step(self) -> int:
        return 64 if self.bits is None else max(64, 2_000_000 // self.bits.shape[1])

    def linked(self, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        if self.bits is not None:
            both = np.bitwise_count(self.bits[u] & self.bits[v]).sum(axis=1, dtype=np.int64)
        else:
            both = np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for x, y in zip(u, v)], dtype=np.int64)
        return 100 * both >= percent * (self.sizes[u] + self.sizes[v] - both)


def confirmed_forest(sig: np.ndarray, sets: list[np.ndarray], percent: int, least: int) -> list[tuple[int, int]]:
    """Spanning forest of the links confirmed on full sets.  Pairs are taken by falling estimate;
    those that are connected already are passed over."""
    n, confirm = len(sets), _Confirm(sets)
    root = np.arange(n)
    edges: list[tuple[int, int]] = []
    us, vs, slots = [], [], []
    for u in range(n - 1):
        same = equal_slots(sig[u], sig[u + 1 :])
        small = np.minimum(confirm.sizes[u], confirm.sizes[u + 1 :])
        large = np.maximum(confirm.sizes[u], confirm.sizes[u + 1 :])
        v = np.flatnonzero((same >= least) & (100 * small >= percent * large))
        us.append(np.full(len(v), u, dtype=np.int32))
        vs.append((v + u + 1).astype(np.int32))
        slots.append(same[v].astype(np.int16))
    if not us:
        return edges
    order = np.argsort(-np.concatenate(slots), kind="stable")
    u, v = np.concatenate(us)[order], np.concatenate(vs)[order]
    done, step = 0, confirm.step()
    while done < len(u):
        apart = np.flatnonzero(root[u[done:]] != root[v[done:]])
        if not len(apart):
            break
        take = apart[:step] + done
        for x, y in zip(u[take][hit := confirm.linked(u[take], v[take], percent)], v[take][hit]):
            if root[x] != root[y]:
                edges.append((int(x), int(y)))
                root[root == max(root[x], root[y])] = min(root[x], root[y])
        done = int(take[-1]) + 1
    return edges


def _links(percent: int, least: int):
    def run(batches):
        def found():
            for t in sorted_groups(batches, ["cluster", "i", "j"]):
                if t.num_rows > 1:
                    ids = t.column("cid").to_pylist()
                    sets = [np.frombuffer(x, dtype=np.uint64) for x in t.column("shingles").to_pylist()]
                    yield [(ids[u], ids[v]) for u, v in confirmed_forest(_signatures(t), sets, percent, least)]

        yield from _emit(found())

    return run


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _with_sets(batches):
    """Adds the shingle sets; an id may come with several texts, only that of the digest counts."""
    kept = ["cluster", "blocks", "cid", "digest", "sig"]
    for batch in batches:
        step = 500
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            sets = [text_shingles(x.as_py(), SHINGLE) for x in part.column("text")]
            own = pa.array([set_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist())], pa.bool_())
            cols = [*(part.column(k) for k in kept), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "shingles"]).filter(own)


def _block_pairs(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of a key with `blocks` > 1 are dealt out by hash to blocks, and each row goes to every
    pair of blocks that has its own, so any two rows of a key meet in some (i, j)."""
    own = F.pmod(F.xxhash64("cid", "digest"), F.col("blocks"))
    one = df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return one.select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *keep)


def _whole_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, kept of `docs` (doc_id, text), one row each."""
    least = least_slots(percent)
    described = checkpointed(
        docs.select("doc_id", "text").mapInArrow(
            _describe(percent), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"
        )
    )
    copies = described.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("cid"))
    own = checkpointed(
        described.select("doc_id", "n_shingles", "digest").join(copies, "digest", "left").select("doc_id", "n_shingles", "cid")
    )
    # an id with texts of several classes is one node: its classes are linked
    several = own.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z").select(F.col("doc_id").alias("of"), "a")
    same_id = own.join(several, F.col("doc_id") == F.col("of")).select("a", F.col("cid").alias("b")).where("a < b").distinct()
    first = copies.withColumnRenamed("digest", "d")
    classes = described.where("sig is not null").join(first, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("cid")))
    bands = classes.select("cid", "digest", "sig", F.explode("bands").alias("key"))
    large = (
        bands.groupBy("key").count().where(F.col("count") > BLOCK_ROWS)
        .select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("long").alias("blocks"))
    )
    dealt = bands.join(large, "key", "left").fillna(1, ["blocks"])
    near = _whole_groups(_block_pairs(dealt, "key", ["cid", "sig"]), ["key", "i", "j"]).mapInArrow(_candidates(least), "a long, b long")
    groups = connected_components(near)
    members = (
        groups.select(F.col("node").alias("cid"), F.col("component").alias("cluster"))
        .join(classes.select("cid", "digest", "sig", "n_shingles").dropDuplicates(["cid", "digest"]), "cid")
    )
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("long").alias("blocks")
    )
    members = members.join(sizes, "cluster").select("cluster", "blocks", "cid", "digest", "sig")
    texts = docs.select(F.col("doc_id").alias("cid"), "text").join(members, "cid").select("cluster", "blocks", "cid", "digest", "sig", "text")
    with_sets = texts.mapInArrow(_with_sets, "cluster long, blocks long, cid long, digest binary, sig binary, shingles binary")
    links = _whole_groups(_block_pairs(with_sets, "cluster", ["cid", "sig", "shingles"]), ["cluster", "i", "j"]).mapInArrow(
        _links(percent, least), "a long, b long"
    )
    found = connected_components(links.unionByName(same_id))
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "cid"))
    return (
        own.join(found.withColumnRenamed("node", "cid"), "cid", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
