"""Exact de-duplication with an extendible-hash index kept in shared files.

* Key: 64-bit hash of the normalised text.  A slot is the key's first `MAX_DEPTH` bits.
* Directory: a bucket covers all keys with one prefix.  It starts with the empty prefix; while it
  holds more than `capacity` distinct keys it splits, which doubles the part of the directory that
  points to it.  The directory has one row per slot, 2^MAX_DEPTH at most, so it may be broadcast.
* Index: rows with equal key and equal bytes are combined, before the shuffle as well, so a text
  with very many copies is one entry per task.  Each owner task then holds whole buckets (ranges of
  keys) and chains the entries whose keys collide.  The buckets are written to shared Parquet files.
* Probe: every document finds its entry in its key's chain by the digest of the compared bytes.

Everything is DataFrame operations.  A text is read twice and shuffled once at most.

Defined cases: null counts as empty.  Equal texts with any doc_id form one group, and the smallest
non-null doc_id stays; in a group of null ids only, keep_id is null and the rows are kept.  Rows that
repeat both id and text are each returned, and share `kept`.  An empty table gives no rows.  Other
columns are neither read nor returned.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import body, checkpointed
from vaultlake.session import ensure_checkpoint_dir

#: Runs of white space other than one plain space; replacing these is replacing every run.
UNEVEN_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
MAX_DEPTH = 16
CAPACITY = 16_384


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(body(text), UNEVEN_SPACES, " ")


def text_key(text: Column, key_bits: int = 64) -> Column:
    """The first `key_bits` bits of a 64-bit hash; few bits make keys of different texts collide."""
    h = F.xxhash64(text)
    return h if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)


def _slot(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """`keys` has a column key.  Returns slot, depth, bucket: the prefix length and the first slot of
    the bucket that holds the slot's keys.  A bucket of the full depth may exceed the capacity."""
    slots = keys.select("key").distinct().groupBy(_slot(F.col("key")).alias("slot")).agg(F.count("*").alias("n"))
    levels = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))))
    span = F.lit(MAX_DEPTH) - F.col("depth")
    levels = levels.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)"))
    fits = (
        levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (span == 0))
    )
    return (
        levels.join(F.broadcast(fits), ["depth", "bucket"])  # 2^(MAX_DEPTH + 1) rows at most
        .groupBy("slot").agg(F.min("depth").alias("depth"))
        .withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)"))
    )


def build_index(docs: DataFrame, path: str, capacity: int = CAPACITY, key_bits: int = 64, keys: DataFrame | None = None) -> str:
    """Writes the index of `docs` (doc_id, text): depth, bucket, key, chain of (sha, keep_id, group_size)."""
    rows = docs.select("doc_id", normalised().alias("norm")).withColumn("key", text_key(F.col("norm"), key_bits))
    slots = checkpointed(directory(rows if keys is None else keys, capacity))
    entries = (
        rows.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("key", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "keep_id", "group_size", _slot(F.col("key")).alias("slot"))
    )
    owned = entries.join(F.broadcast(slots), "slot").repartition("bucket")
    chains = owned.groupBy("bucket", "key").agg(
        F.first("depth").alias("depth"), F.collect_list(F.struct("sha", "keep_id", "group_size")).alias("chain")
    )
    chains.sortWithinPartitions("bucket", "key").write.parquet(path)
    return path


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64, path: str | None = None) -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256 of `docs` (doc_id, text), one row each.
    The index stays in `path` (by default a new folder of the shared checkpoint folder)."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/exact-index-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", normalised().alias("norm"))
    postings = checkpointed(
        rows.select("doc_id", text_key(F.col("norm"), key_bits).alias("key"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    )
    build_index(docs, path, capacity, key_bits, postings)
    links = spark.read.parquet(path).select("key", F.inline("chain"))
    return postings.join(links, ["key", "sha"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )
