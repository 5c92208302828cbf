"""The training-data pipeline: each stage works on the documents that the stage before has kept.

language       documents whose language can't be told (no letter, or too narrow a margin) go
exact_dedup    of equal texts (white space aside) the one with the smallest doc_id stays
near_dedup     of each group of near-duplicates the one with the smallest doc_id stays
mix            the mix of sources in target weights; what follows after its end goes
pack           every document that is left, packed into sequences: one row per piece

Decisions go by id and text, so an id may have several texts and be null.  A row with a null id takes no
part in near_dedup and stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.llm.common import checkpointed, numbered_in_order, table
from vaultlake.llm.exact_dedup import exact_duplicates, normalised
from vaultlake.llm.language import accepted_documents
from vaultlake.llm.mixing import mixed_documents
from vaultlake.llm.near_dup import near_duplicates
from vaultlake.llm.packing import best_fit
from vaultlake.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents of this very stage, held-out rows aside."""
    return accepted_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, also where whole rows repeat or an id has several texts."""
    found = checkpointed(exact_duplicates(docs).select("doc_id", "kept", "text_sha256"))
    digest = F.sha2(normalised().cast("binary"), 256)
    gone = found.where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("__id")) & (digest == F.col("__sha")), "left_anti")
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not again.isEmpty():
        out = out.withColumn("__sha", digest).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
    return out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Links: 5-word shingles, similarity of 0.85 or more.  Documents without words stay.  Where an id has
    several texts, the rows get numbers in the order of (doc_id, text hash) in its place."""
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _without(docs, near_duplicates(docs).where("not kept"), "doc_id")
    rows = checkpointed(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows = numbered_in_order(rows, [F.asc_nulls_last("doc_id"), F.sha2("text", 256).asc(), F.asc("__row")])
    rows = checkpointed(rows.withColumnRenamed("number", "__number").withColumn("__number", F.when(F.col("doc_id").isNotNull(), F.col("__number"))))
    near = near_duplicates(rows.select(F.col("__number").alias("doc_id"), "text"))
    return _without(rows, near.where("not kept"), "__number").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Target weight of a source: its number of documents to the power 0.7.  The mix ends when the
    sources that still have documents hold less than half of the weight."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit(docs)


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    dropped = dropped.select(F.col("doc_id").alias("__dropped"))
    return docs.join(dropped, docs[name] == F.col("__dropped"), "left_anti")


STAGES = [("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: The stages are outside SQL (compression, MinHash, scheduling, packing): tests hold the rows
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written as Parquet to the cluster's shared
    folder and read again as the next one's documents."""
    home = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
