"""Target-distribution importance resampling over hashed n-grams.

Documents that look like the target texts are drawn more often.  Words and n-grams are found by
overlapped scanning: separators are collapsed to single spaces, then one regular expression per n,
with look-arounds at both word boundaries and `overlapped=True`, yields every n-gram as a span of the
text; its CRC-32 modulo `buckets` is the feature.

1. Each document gives its bucket counts (all words of the whole text), written once.
2. The counts of all documents, and of all target texts, are added up per bucket: each task adds up
   its own rows first, so a task sends `buckets` rows at most, and so many come to the driver.
3. A bucket's gain is floor(1000 * ln(target share / document share)), shares smoothed by one; a
   document's weight is the floored mean over its features.
4. score = weight + floor(1000 * Gumbel noise), the noise drawn from a hash of the seed and the id, so
   that the highest scores are a sample without replacement with probabilities by weight.
5. The cut-off is found from the counts per score (scores are integers within about +-60,000, so the
   table is bounded); only the rows from it on are ordered, by one range exchange.

Defined cases: a null text has no words, weight 0 and a score; it is drawn only if `least_words` is
0.  A null id is hashed as an empty one and follows other ids of its score.  Rows that repeat an id are
documents of their own; equal rows at the cut-off are told apart arbitrarily.  Without documents there are
no rows; without target texts all gains follow from the smoothing.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultlake.llm.common import checkpointed, numbered_in_order, stored

BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Runs of UTF-8 bytes that are no letter a-z, digit or part of a character beyond ASCII.
SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Documents that a task turns into one output batch.
ROWS = 1000


def gram_pattern(n: int) -> regex.Pattern:
    """Matches n words joined by single spaces, from a word's start to a word's end."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def plain(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and every run of separators as one space."""
    return SEPARATORS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip(b" ")


def gram_buckets(flat: bytes, patterns: list[regex.Pattern], buckets: int) -> np.ndarray:
    crc = zlib.crc32
    spans = (crc(m[0]) for p in patterns for m in p.finditer(flat, overlapped=True))
    return np.fromiter(spans, dtype=np.uint32) % np.uint32(buckets)


def _scan(n_max: int, buckets: int):
    def run(batches):
        patterns = [gram_pattern(n) for n in range(1, n_max + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words, features, which, often = [], [], [], []
                for text in part.column("text"):
                    flat = plain(text.as_py())
                    found, n = np.unique(gram_buckets(flat, patterns, buckets), return_counts=True)
                    words.append(flat.count(b" ") + 1 if flat else 0)
                    features.append(int(n.sum()))
                    which.append(found.astype(np.uint32).tobytes())
                    often.append(n.astype(np.uint32).tobytes())
                cols = [pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(which, pa.binary()), pa.array(often, pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), *cols], ["doc_id", "digest", "n_words", "n_features", "which", "often"]
                )

    return run


def _added_up(buckets: int):
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for which, often in zip(batch.column("which"), batch.column("often")):
                total[np.frombuffer(which.as_py(), dtype=np.uint32)] += np.frombuffer(often.as_py(), dtype=np.uint32)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return run


def features(texts: DataFrame, n_max: int, buckets: int) -> DataFrame:
    """doc_id, digest, n_words, n_features, which (buckets), often (their counts) of `texts` (doc_id,
    digest, text)."""
    return texts.select("doc_id", "digest", "text").mapInArrow(
        _scan(n_max, buckets), "doc_id long, digest binary, n_words long, n_features long, which binary, often binary"
    )


def bucket_totals(found: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows: `buckets` numbers."""
    sums = found.select("which", "often").mapInArrow(_added_up(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    k = len(documents)
    s, t = float(documents.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log(((b + 1) * s) / ((a + 1) * t))) for a, b in zip(documents.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 * a Gumbel variable), from the first 32 bits of sha256(seed:doc_id)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gains: np.ndarray, seed: int):
    def run(batches):
        for batch in batches:
            weight = []
            for n, which, often in zip(batch.column("n_features").to_pylist(), batch.column("which"), batch.column("often")):
                of = gains[np.frombuffer(which.as_py(), dtype=np.uint32)]
                weight.append(int(of @ np.frombuffer(often.as_py(), dtype=np.uint32).astype(np.int64)) // n if n else 0)
            score = [w + noise(d, seed) for w, d in zip(weight, batch.column("doc_id").to_pylist())]
            kept = ["doc_id", "digest", "n_words", "n_features"]
            new = [pa.array(weight, pa.int64()), pa.array(score, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], [*kept, "weight", "score"])

    return run


def _cut_off(counts: dict[int, int], percent: int) -> tuple[int, int | None]:
    """How many rows are drawn, and the least score among them."""
    draw = percent * sum(counts.values()) // 100
    above = 0
    for score in sorted(counts, reverse=True):
        above += counts[score]
        if above >= draw > 0:
            return draw, score
    return 0, None


def _ranked(docs: DataFrame, target: DataFrame, n_max: int, buckets: int, percent: int, least_words: int, seed: int) -> DataFrame:
    """doc_id, digest, n_features, weight, score, rank of `docs` (doc_id, digest, text)."""
    found = stored(features(docs, n_max, buckets), "resample")
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest")]
    aim = features(target.select(*none, "text"), n_max, buckets)
    gains = bucket_gains(bucket_totals(found, buckets), bucket_totals(aim, buckets))
    scored = checkpointed(
        found.mapInArrow(_scores(gains, seed), "doc_id long, digest binary, n_words long, n_features long, weight long, score long")
        .withColumn("__row", F.monotonically_increasing_id())
    )
    able = F.col("n_words") >= least_words
    counts = {r["score"]: r["n"] for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()}
    draw, least = _cut_off(counts, percent)
    out = ["doc_id", "digest", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*out, undrawn)
    high = able & (F.col("score") >= least)
    top = numbered_in_order(scored.where(high), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__row")])
    rank = F.when(F.col("number") < draw, F.col("number") + 1).alias("rank")
    return top.select(*out, rank).unionByName(scored.where(~high).select(*out, undrawn))


def resample(
    docs: DataFrame, target: DataFrame, n_max: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """Columns doc_id, n_features, weight, score, rank (from 1; null: not drawn) of `docs` (doc_id,
    text), one row each; `target`: the target texts (text).  Of the documents with `least_words` words or
    more, `percent` % are drawn."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest"), "text")
    return _ranked(rows, target, n_max, buckets, percent, least_words, seed).drop("digest")


def drawn_documents(
    docs: DataFrame, target: DataFrame, n_max: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """The rows of `docs` that are drawn, all columns.  Of rows with equal id and text all come if one does."""
    mine = [F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("digest")]
    drawn = _ranked(docs.select(*mine, "text"), target, n_max, buckets, percent, least_words, seed).where("rank is not null")
    drawn = drawn.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & F.unhex(F.sha2(docs["text"], 256)).eqNullSafe(F.col("__digest"))
    return docs.join(drawn, same, "left_semi")
