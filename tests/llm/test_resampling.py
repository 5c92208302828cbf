"""Importance resampling against a plain Python version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from conftest import SF_SMALL
from tools.compare import duck, rows_of
from vaultlake.llm import queries as Q
from vaultlake.llm.resampling import drawn_documents, gram_pattern, plain, resample

DOCS = "doc_id long, text string, number long, rank string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def grams(text, n_max):
    w = WORD.findall(lower(text))
    return [" ".join(w[i : i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, n_max=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    of = lambda texts: Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, n_max))
    s, t = of(x for _, x in docs), of(target)
    S, T = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        g = [gain[zlib.crc32(x.encode()) % buckets] for x in grams(text, n_max)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(grams(text, 1))])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def test_query_equals_sql_and_brute_force(spark):
    got = Q.op11_importance_resampling(spark, SF_SMALL)
    rows = [tuple(r) for r in got.collect()]
    cols, want = duck(SF_SMALL, Q.ORACLE_SQL["op11_importance_resampling"])
    assert rows_of(got.columns, rows) == rows_of(cols, want)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("text").collect()]
    assert Counter(rows) == brute(docs, target)
    assert any(r[4] for r in rows)


def test_spans_overlap_and_keep_to_word_borders():
    flat = plain("One--two, THREE\x00four_five Été x")
    assert flat.decode() == "one two three four five Été x"  # only A-Z are lower-cased; beyond ASCII all is a letter
    assert [m[0].decode() for m in gram_pattern(2).finditer(flat, overlapped=True)] == [
        "one two", "two three", "three four", "four five", "five Été x"
    ]
    assert not list(gram_pattern(3).finditer(b"a b", overlapped=True))
    assert plain(None) == plain("--") == b""


def test_defined_cases(spark):
    common, own = "alpha beta gamma delta " * 6, "a target text about kites and string " * 3
    docs = [(i, f"{common} w{i}") for i in range(40)] + [(100 + i, own) for i in range(4)]
    docs += [(7, own), (7, own), (None, own), (None, None), (60, None), (61, ""), (62, "?!"), (63, "word " * 300_000), (64, "x" * 400_000), (65, "Zürich " * 25)]
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], DOCS)
    target = [own, None, "", "kites"]
    for options in ({}, {"n_max": 3, "buckets": 50, "percent": 35, "least_words": 1}, {"percent": 100, "least_words": 0}, {"percent": 1}):
        got = resample(df, texts(spark, target), **options)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(tuple(r) for r in got.collect()) == brute(docs, target, **options), options


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert resample(none, texts(spark, ["a b"])).collect() == []
    docs = [(i, "some words " * 15) for i in range(30)]
    got = resample(spark.createDataFrame([(*d, 1, "r") for d in docs], DOCS), texts(spark, []))
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, [])


def test_drawn_documents_come_whole_and_by_their_text(spark):
    near, far = "kites and string in the wind today " * 4, "sums of rows and more sums of rows " * 4
    docs = [(i, near if i < 5 else far, i, "r") for i in range(50)] + [(2, far, 99, "same id, other text")]
    df = spark.createDataFrame(docs, DOCS)
    out = drawn_documents(df, texts(spark, [near] * 50))
    rows = out.collect()
    ranked = resample(df, texts(spark, [near] * 50)).where("rank is not null")
    assert out.columns == df.columns and len(rows) == ranked.count() == 5
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in ranked.collect())
    assert all(r["number"] != 99 for r in rows)


def test_equal_scores_over_many_ranges(spark):
    """One id holds a third of all rows: its copies share a score and are numbered over several tasks."""
    docs = [(5, "one common text of words " * 5)] * 300 + [(i, "one common text of words " * 5) for i in range(600)]
    df = spark.createDataFrame([(*d, 1, "r") for d in docs], DOCS).repartition(6)
    got = resample(df, texts(spark, ["common words"]), percent=60)
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, ["common words"], percent=60)
