"""Language identification by compression: a text is encoded with one raw-content zstandard
dictionary per language, and the language that makes it smallest wins.

Dictionaries: for each language, `SAMPLE_DOCS` of the labelled documents (those with the smallest
md5 of the id) give up to `SAMPLE_CHARS` characters each; nothing else is learned.  The whole
lower-cased text is compressed in blocks of `BLOCK` bytes, each against the dictionary, and the sizes
are added up; small blocks keep a text's repetitions of itself from outweighing the dictionary.

Result: doc_id, held_out, lang_pred, score, rejected.  The score is s / (b + s) with the best size b
and the second s.  A text is rejected when its margin (s - b) / s is below `MARGIN`, or its language
is undetermined.

Defined cases: a null text, or one without a letter, is `und` with score 0.  If nothing could be
learned all texts are `und`; with one learned language every other text has it, with score 1.  Equal
sizes: the first language by name, score 0.5, rejected.  Repeated rows are each returned; a null
doc_id is predicted too and counts as not held out.  Other columns are neither read nor returned.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaultlake.llm.common import held_in

HELD_MOD, HELD_AT = 3, 1
SAMPLE_DOCS, SAMPLE_CHARS = 200, 1_500
BLOCK = 2_048
LEVEL = 6
MARGIN = 0.002
#: Rows that a task passes on at once with their texts; bounds its memory.
PASS_ON = 1_000
UNKNOWN = "und"

def learn(docs: DataFrame) -> dict[str, bytes]:
    """One dictionary per language, from rows that are not held out and have a language."""
    known = docs.where(held_in("doc_id", HELD_MOD, HELD_AT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.md5(F.col("doc_id").cast("string"))
    counts = known.groupBy(F.col("lang").alias("known_lang")).agg((F.lit(4.0 * SAMPLE_DOCS) / F.count("*")).alias("share"))
    few = known.select("doc_id", "lang", h.alias("h")).join(F.broadcast(counts), F.col("lang") == F.col("known_lang"))  # a row per language
    few = few.where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**32 < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("doc_id", "h").distinct()
    # SAMPLE_DOCS rows per language at most, so the broadcast is bounded
    texts = known.select("doc_id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    out: dict[str, list] = {}
    for row in sorted(texts.select("lang", "h", "text").collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        out.setdefault(row["lang"], []).append(row["text"].lower())
    return {lang: " ".join(parts[:SAMPLE_DOCS]).encode("utf-8", "replace") for lang, parts in out.items()}


def _compressors(dictionaries: dict[str, bytes]) -> list:
    out = []
    for lang in sorted(dictionaries):
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def predict(text: str | None, compressors: list) -> tuple[str, float, bool]:
    if not text or not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    raw = text.lower().encode("utf-8", "replace")
    blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    best, second = sizes[0][0], sizes[1][0]
    return sizes[0][1], second / (best + second), (second - best) < MARGIN * second or second == best


def _predict(dictionaries: dict[str, bytes]):
    def run(batches):
        compressors = _compressors(dictionaries)
        for batch in batches:
            found = [predict(t.as_py(), compressors) for t in batch.column(1)]
            langs, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """Columns doc_id, held_out, lang_pred, score, rejected of `docs` (doc_id, text, and lang if the
    dictionaries are to be learned)."""
    dictionaries = learn(docs) if dictionaries is None else dictionaries
    out = docs.select("doc_id", "text").mapInArrow(_predict(dictionaries), "doc_id long, lang_pred string, score double, rejected boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD_MOD == HELD_AT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def accepted_documents(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose language is accepted; the text is compressed in the task
    that reads it and the rows are passed on as they are."""
    dictionaries = learn(docs) if dictionaries is None else dictionaries
    at = docs.columns.index("text")

    def run(batches):
        compressors = _compressors(dictionaries)
        for batch in batches:
            for start in range(0, batch.num_rows, PASS_ON):
                part = batch.slice(start, PASS_ON)
                keep = [not predict(t.as_py(), compressors)[2] for t in part.column(at)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
