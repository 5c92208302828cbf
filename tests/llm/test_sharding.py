"""Histogram-sorted shards against the contract, exact bounds and a plain sort."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from conftest import SF_SMALL
from vaultlake.llm import queries as Q
from vaultlake.llm.sharding import ORDER, TOLERANCE, shard_rows, splitters, write_shards

DOCS = "doc_id long, text string, size string, shard string"


def check(rows, docs, shards, tolerance=TOLERANCE):
    """Every document once with its own size and checksum; slots gapless; bytes near equal."""
    facts = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, *facts(t)) for i, t in docs)
    slots, sizes = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(sizes.values()) / shards, max((r["size"] for r in rows), default=0)
    assert all(abs(n - mean) <= 2 * tolerance * mean + largest + 1 for n in sizes.values()), sizes
    return sizes


def test_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = Q.op13_histogram_shards(spark, SF_SMALL)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert dict(got.dtypes)["shard"] == dict(got.dtypes)["grown_shard"] == "int"
    check(got.collect(), [tuple(r) for r in docs.collect()], 16)


def test_splitters_equal_a_plain_sort(spark):
    """Without tolerance each splitter is the row border that is nearest to its aim."""
    docs = spark.createDataFrame([(i, "t" * (i * i % 97)) for i in range(400)], "doc_id long, text string")
    rows = docs.select(F.length("text").cast("long").alias("size") + 0, F.xxhash64("text").alias("__text"), F.xxhash64("doc_id").alias("__id"), F.col("doc_id").alias("__row"))
    rows = rows.toDF("size", *ORDER)
    table = sorted((tuple(r[k] for k in ORDER), r["size"]) for r in rows.collect())
    total = sum(n for _, n in table)
    for i, cut in enumerate(splitters(rows, 7, tolerance=0.0), 1):
        full = cut + (-(1 << 63),) * (3 - len(cut))
        below = sum(n for key, n in table if key < full)
        borders, run = [0], 0
        for _, n in table:
            run += n
            borders.append(run)
        assert abs(below - -(-total * i // 7)) == min(abs(b - -(-total * i // 7)) for b in borders)


def test_hot_text_is_cut_and_equal_texts_lie_together(spark):
    docs = [(i % 3, "the hot text " * 3) for i in range(900)] + [(None, "none")] * 300 + [(i, f"text {i % 200} " * (1 + i % 7)) for i in range(1500)]
    got = shard_rows(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), shards=8)
    rows = got.collect()
    check(rows, docs, 8)
    place = {(r["shard"], r["slot"]): r["text_crc32"] for r in rows}
    runs = 1 + sum(a[1] != b[1] for a, b in zip(sorted(place.items()), sorted(place.items())[1:]))
    assert runs == len({r["text_crc32"] for r in rows})  # one run of places for each text, over the shards
    assert len({r["shard"] for r in rows if r["text_crc32"] == zlib.crc32(("the hot text " * 3).encode())}) > 1


def test_defined_cases(spark):
    docs = [(None, None), (None, None), (1, None), (1, ""), (1, "a"), (1, "a"), (2, "é" * 50_000), (3, "x" * 3_000_000)] + [(i, "some text") for i in range(90)]
    df = spark.createDataFrame([(*d, "s", "t") for d in docs], DOCS)
    sizes = check(shard_rows(df, shards=4).collect(), docs, 4)
    assert max(sizes.values()) >= 3_000_001
    assert shard_rows(df.limit(0)).collect() == []
    check(shard_rows(spark.createDataFrame([(1, "only")], "doc_id long, text string")).collect(), [(1, "only")], 16)
    same = [(4, "same")] * 500  # rows that nothing but their number tells apart
    check(shard_rows(spark.createDataFrame(same, "doc_id long, text string").repartition(3), shards=5).collect(), same, 5)


def test_written_shards(spark, tmp_path):
    docs = [(i, f"text {i} " * (i % 50), "kept", "column") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, slot string")
    back = write_shards(df, str(tmp_path / "shards"), shards=4)
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in back.collect()) == Counter(d[:3] for d in docs)
    per = {r["shard"]: r["b"] for r in back.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert set(per) == {0, 1, 2, 3} and max(per.values()) - min(per.values()) < 1000


def test_no_python_in_the_plan(spark):
    plan = Q.op13_histogram_shards(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "mapIn" not in plan
