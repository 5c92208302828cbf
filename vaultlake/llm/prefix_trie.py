"""Prefix trie of conversations by truncation peeling.

Paths.  Turns are range-sorted by (conversation, turn) and scanned in order: the scan numbers them and
gives each the hash of its prefix, a polynomial over 128-bit turn hashes in two 64-bit lanes, k -> A * k +
turn.  A conversation may go over several ranges: from one row per range (its first and last
conversation) follows what each range has to carry on, so no task needs a whole conversation.  The
first scan numbers the original turns, the second one the rebuilt conversations.

Peeling.  Conversations that are equal as a whole are one class, with its smallest conv_id as its
representative.  Where only one class goes on, its nodes down to the end are known at once.  The rest
is peeled: from the greatest depth on, the classes that end (or go on alone) at the depth join the
surviving nodes; equal prefixes become one node with its members, children, leaves and savings added up;
then the last turn is stripped and the nodes are grouped anew (the paths through a depth tell the length of
its turns and what is left of a prefix without its last one).  So nodes are found and added up in the same
pass, with one exchange a round.  There are as many rounds as
turns that two different conversations share; each writes its nodes to the shared checkpoint folder.

Hot groups: equal conversations are counted, and nodes added up, before any shuffle; the parents with
very many children are looked up by broadcast (at most `HOT` of them), the others by a shuffled
join.  The hash over a node's ended conversations is one sequence by its definition: tasks pack the
sorted ids into texts of `PACK` ids, and only these are streamed through the hash of their node.

Defined cases: a null conv_id takes no part.  A null role or text is empty.  Turns come in the order of
`turn`, null first; equal turns in a fixed order by the hash of their contents; repeated rows are turns of
their own.  A conversation may have no turns after rebuilding: it ends at the root.  An empty table gives no
nodes.  Other columns are not read.  The text itself is not shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.llm.common import body, checkpointed, sorted_groups, stored
from vaultlake.session import ensure_checkpoint_dir

#: Conversations that share a base, and remainders of crc32 that give the turns taken from it.
FAMILY, HEADS = 100, 6
HOT = 1000
PACK = 4096
LANES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_INVERSE = [pow(a, -1, 1 << 64) for a in LANES]
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _powers(a: int, n: int) -> np.ndarray:
    """a^0 .. a^n modulo 2^64."""
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, a, dtype=np.uint64))))


def _prefixes(batches):
    """Sorted rows (conv_id, x, size) with at (from 1), k1, k2 (prefix with the row), p1, p2 (without
    it), upto (size so far), all from the conversation's first row in this task on."""
    last, count, upto, tail = None, 0, 0, [0, 0]
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        conv = batch.column("conv_id").to_numpy()
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.uint64).reshape(m, 2)
        size = batch.column("size").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        lengths = np.diff(np.append(starts, m))
        first = np.repeat(starts, lengths)
        goes_on = conv[0] == last
        at = np.arange(m) - first + 1
        sums = np.cumsum(size)
        run = sums - np.repeat(sums[starts] - size[starts], lengths)
        over = slice(0, int(lengths[0])) if goes_on else slice(0, 0)
        run[over] += upto
        lanes = []
        for lane, (a, inverse) in enumerate(zip(LANES, _INVERSE)):
            up = _powers(a, m)
            added = np.cumsum(x[:, lane] * _powers(inverse, m)[1:], dtype=np.uint64)
            k = up[1:] * (added - np.repeat(np.concatenate(([np.uint64(0)], added))[starts], lengths))
            k[over] += up[at[over]] * np.uint64(tail[lane])
            p = np.concatenate(([np.uint64(0)], k[:-1]))
            p[starts] = np.uint64(0)
            if goes_on:
                p[0] = np.uint64(tail[lane])
            lanes.append((k, p))
            tail[lane] = int(k[-1])
        at[over] += count
        last, count, upto = conv[-1], int(at[-1]), int(run[-1])
        (k1, p1), (k2, p2) = lanes
        new = [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v, pa.int64()) for v in (at, k1, k2, p1, p2, run)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("x"), batch.column("size"), *new], ["conv_id", "x", "size", "at", "k1", "k2", "p1", "p2", "upto"]
        )


def _joined(before: tuple, after: tuple) -> tuple:
    """(at, k1, k2, upto) of a stretch of turns and the one that follows it."""
    n = after[0]
    ks = [((b * pow(a, n, 1 << 64)) + k) % (1 << 64) for a, b, k in zip(LANES, before[1:3], after[1:3])]
    return (before[0] + n, *ks, before[3] + after[3])


def _carried(edges: list) -> dict[int, tuple]:
    """For each range whose first conversation began before: (conv_id, at, k1, k2, upto) so far."""
    out, conv, so_far = {}, None, None
    for part, first, (last, at, k1, k2, upto) in sorted(edges):
        here = (at, k1 % (1 << 64), k2 % (1 << 64), upto)
        if first == conv:
            out[part] = (conv, *so_far)
            if last == conv:
                here = _joined(so_far, here)
        conv, so_far = last, here
    return out


def _carry_on(carried: dict[int, tuple]):
    def run(batches):
        for batch in batches:
            part = batch.column("part").to_numpy()
            cols = {n: batch.column(n).to_numpy().copy() for n in ("at", "k1", "k2", "p1", "p2", "upto")}
            conv = batch.column("conv_id").to_numpy()
            for p in np.unique(part).tolist():
                if p not in carried:
                    continue
                of, at, k1, k2, upto = carried[p]
                rows = np.flatnonzero((part == p) & (conv == of))
                if not len(rows):
                    continue
                n = cols["at"][rows]
                for a, k, names in zip(LANES, (k1, k2), (("k1", "p1"), ("k2", "p2"))):
                    up = _powers(a, int(n.max())) * np.uint64(k)
                    for name, back in zip(names, (0, 1)):
                        cols[name][rows] = (cols[name][rows].view(np.uint64) + up[n - back]).view(np.int64)
                cols["at"][rows] += at
                cols["upto"][rows] += upto
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("conv_id", "x", "size")] + [pa.array(c, pa.int64()) for c in cols.values()],
                ["conv_id", "x", "size", *cols],
            )

    return run


_SCANNED = "conv_id long, x binary, size long, at long, k1 long, k2 long, p1 long, p2 long, upto long"


def scanned(turns: DataFrame, order: list[Column]) -> DataFrame:
    """`turns` (conv_id, x, size), in `order`, which begins with conv_id, with their prefixes."""
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "x", "size")
    local = checkpointed(ranged.mapInArrow(_prefixes, _SCANNED).withColumn("part", F.spark_partition_id()))
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "k1", "k2", "upto")).alias("last"))
    carried = _carried([(r["part"], r["first"], tuple(r["last"])) for r in edges.collect()])  # a row per range
    return local.mapInArrow(_carry_on(carried), _SCANNED) if carried else local.drop("part")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id), and the turns of the rebuilt ones as `scanned` returns them."""
    role, text = body("role"), body("text")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("x"),
        F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    own = scanned(turns, [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("x"), F.asc("row")]).select("conv_id", "at", "x", "size")
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ids = own.select("conv_id").where("at = 1").select("conv_id", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    # a base has FAMILY conversations and HEADS - 1 turns here at most
    lent = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS)).withColumnRenamed("conv_id", "of")
    taken = ids.join(lent, F.col("base") == F.col("of")).where("at <= h").select("conv_id", F.lit(0).alias("kind"), "at", "x", "size")
    rest = own.where(F.col("at") > heads).select("conv_id", F.lit(1).alias("kind"), "at", "x", "size")
    return ids.select("conv_id"), scanned(taken.unionByName(rest), [F.asc("conv_id"), F.asc("kind"), F.asc("at")]).drop("x")


def _packed(batches):
    for t in sorted_groups(batches, ["at", "k1", "k2"], PACK):
        ids = t.column("conv_id").to_pylist()
        head = [pa.array([t.column(c)[0].as_py()], pa.int64()) for c in ("at", "k1", "k2", "conv_id")]
        yield pa.RecordBatch.from_arrays([*head, pa.array([",".join(map(str, ids))])], ["at", "k1", "k2", "first", "ids"])


def _hashed(batches):
    rows, key, h = [], None, None

    def flush():
        cols = list(zip(*rows)) or [()] * 4
        types = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["at", "k1", "k2", "sha"])

    for batch in batches:
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("at", "k1", "k2", "ids"))):
            if now == key:
                h.update(b",")
            else:
                if key:
                    rows.append((*key, h.hexdigest()))
                key, h = now, hashlib.sha256()
            h.update(ids.encode())
        if len(rows) > 10_000:
            yield flush()
            rows = []
    if key:
        rows.append((*key, h.hexdigest()))
    yield flush()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(at, k1, k2, sha): the SHA-256 of the conv_ids of each end, ascending, comma-joined."""
    order = ["at", "k1", "k2", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _packed, "at long, k1 long, k2 long, first long, ids string"
    )
    in_order = packed.repartition("at", "k1", "k2").sortWithinPartitions("at", "k1", "k2", "first")
    return in_order.mapInArrow(_hashed, "at long, k1 long, k2 long, sha string")


def _peeled(spark: SparkSession, steps: DataFrame, deepest: int) -> DataFrame:
    """Nodes (at, k1, k2, p1, p2, conv_id, n, children, leaves, saved), depth by depth from the deepest.
    `steps`: the classes that enter at a depth, and without members (n = 0) the paths through it."""
    home = f"{ensure_checkpoint_dir(spark)}/trie-{uuid.uuid4().hex}"
    known = [F.max(c).alias(c) for c in ("p1", "p2", "size", "alone")]
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    survivors = None
    for depth in range(deepest, -1, -1):
        level = steps.where(F.col("at") == depth).drop("at")
        if survivors is not None:
            stripped = survivors.select(
                F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved"
            )
            level = level.unionByName(stripped, allowMissingColumns=True)
        nodes = level.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), *known, *sums)
        added = F.when(F.col("alone"), 0).otherwise((F.col("n") - 1) * F.coalesce("size", F.lit(0)))  # the root has no text
        nodes = nodes.select(
            "k1", "k2", "p1", "p2", "conv_id", "n", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
            (F.col("saved") + added).alias("saved"),
        )
        nodes.write.parquet(f"{home}/at={depth}")
        survivors = spark.read.schema(nodes.schema).parquet(f"{home}/at={depth}")
    return spark.read.schema(nodes.withColumn("at", F.lit(0)).schema).parquet(home).withColumn("at", F.col("at").cast("long"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """`nodes` with parent_conv_id.  At most HOT nodes have more than a HOT-th part of all as children."""
    many = F.col("children") > nodes.count() // HOT
    parents = nodes.select((F.col("at") + 1).alias("p_at"), F.col("k1").alias("p_k1"), F.col("k2").alias("p_k2"), F.col("conv_id").alias("parent_conv_id"), many.alias("many"))
    mine = (F.col("at") == F.col("p_at")) & (F.col("p1") == F.col("p_k1")) & (F.col("p2") == F.col("p_k2"))
    tried = nodes.join(F.broadcast(parents.where("many")), mine, "left")
    extra = ["p_at", "p_k1", "p_k2", "many"]
    found = tried.where("parent_conv_id is not null").drop(*extra)
    rest = tried.where("parent_conv_id is null").select(*nodes.columns).join(parents.where("not many"), mine, "left").drop(*extra)
    return found.unionByName(rest)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt `conversations` (conv_id, turn, role, text), columns `NODES`."""
    spark = conversations.sparkSession
    ids, turns = rebuilt(conversations)
    turns = checkpointed(turns)
    key = ["at", "k1", "k2"]
    none = ids.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("size", "at", "k1", "k2", "p1", "p2", "upto")])
    last = F.max(F.struct("at", "k1", "k2", "p1", "p2", "size", "upto")).alias("last")
    ends = checkpointed(turns.unionByName(none).groupBy("conv_id").agg(last).select("conv_id", "last.*"))
    classes = checkpointed(
        ends.groupBy(*key).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("p1", "p2", "size", "upto")])
    )
    paths = checkpointed(turns.join(classes.select(F.col("conv_id").alias("of")), F.col("conv_id") == F.col("of"), "left_semi"))
    lone = (
        paths.groupBy(*key).agg(F.count("*").alias("classes"), F.min("conv_id").alias("of")).where("classes = 1")
        .groupBy("of").agg(F.min("at").alias("lone_from"))
    )
    ended = checkpointed(classes.join(lone, F.col("conv_id") == F.col("of"), "left").drop("of"))
    whole = ended.select(F.col("conv_id").alias("of"), "lone_from", "n", F.col("at").alias("end"), F.col("upto").alias("total"))
    marked = paths.join(whole, F.col("conv_id") == F.col("of")).drop("of")
    alone = stored(
        marked.where("at >= lone_from").select(
            *key, "p1", "p2", "size", "conv_id", "n", (F.col("at") < F.col("end")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
            ((F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("size"))).alias("saved"), F.lit(True).alias("alone"), (F.col("at") > F.col("lone_from")).alias("deeper"),
        ),
        "trie-alone",
    )
    zero = F.lit(0).cast("long")
    nothing = [zero.alias(c) for c in ("children", "leaves", "saved")]
    closing = ended.where("lone_from is null").select(*key, "p1", "p2", "size", "conv_id", "n", *nothing, F.lit(False).alias("alone"))
    passing = marked.where("lone_from is null or at < lone_from").select(
        *key, "p1", "p2", "size", F.lit(None).cast("long").alias("conv_id"), zero.alias("n"), *nothing, F.lit(False).alias("alone")
    )
    steps = alone.where("not deeper").drop("deeper").unionByName(closing).unionByName(passing)
    # in the order of depth, so that a round reads its depth only; the paths through one node are dealt out
    steps = stored(steps.withColumn("deal", F.rand(1)).repartitionByRange("at", "deal").sortWithinPartitions("at").drop("deal"), "trie-steps")
    deepest = steps.agg(F.max("at")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], NODES)
    nodes = _with_parents(_peeled(spark, steps, deepest))
    deeper = alone.where("deeper").drop("size", "alone", "deeper").withColumn("parent_conv_id", F.col("conv_id"))
    hashes = end_hashes(ends).select(*[F.col(c).alias(f"e_{c}") for c in key], "sha")
    same = (F.col("at") == F.col("e_at")) & (F.col("k1") == F.col("e_k1")) & (F.col("k2") == F.col("e_k2"))
    return nodes.unionByName(deeper).join(hashes, same, "left").select(
        "conv_id", F.col("at").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
