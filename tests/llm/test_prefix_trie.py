"""The prefix trie against a plain Python version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tools.compare import duck, rows_of
from vaultlake.llm import queries as Q
from vaultlake.llm.prefix_trie import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth string, n_convs long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(turn, role, text):
    digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    return (turn is not None, turn or 0, digest)


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: tie(*x))] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, len(path)))
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (
            first[p], len(p), first[p[:-1]] if p else None, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c, n in sorted(m) if n == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(parts)
    got = prefix_trie(df)
    assert got.columns == COLUMNS and {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    return Counter(tuple(r) for r in got.collect())


def test_query_equals_sql_and_brute_force(spark):
    got = Q.op12_prefix_trie(spark, SF_SMALL)
    rows = [tuple(r) for r in got.collect()]
    cols, want = duck(SF_SMALL, Q.ORACLE_SQL["op12_prefix_trie"])
    assert rows_of(got.columns, rows) == rows_of(cols, want)
    table = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert Counter(rows) == brute([tuple(r) for r in table.collect()])


def test_defined_cases(spark):
    rows = [(c, t, "user" if t % 2 else "bot", f"{'é' * (t % 4)} turn {t} of {c // 40 % 3}") for c in range(0, 250, 3) for t in range(c % 9)]
    rows += [(7, None, None, None), (7, None, "a", ""), (7, 3, "b", "late"), (7, 3, "a", "tie"), (7, 3, "a", "tie")]  # nulls, ties, repeats
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(100 * k + 5, t, "user", "without a base") for k in (30, 31) for t in range(8)]
    rows += [(100 * k + j, 1, "user", "one turn") for k in (40, 41) for j in range(1, 30)]  # many are left without turns
    rows += [(500 + j, t, "r", "the same text " * 2000) for j in range(12) for t in range(7)]  # copies, long texts
    rows += [(600, t, "ab", "c") for t in range(3)] + [(601, t, "a", "bc") for t in range(3)]
    assert run(spark, rows) == brute(rows)


def test_long_shared_prefixes_and_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows; three others share up to 15 turns with it and leave it at odd places."""
    long = [(9, t, "user", f"turn {t % 11}") for t in range(400)]
    rows = long + [(c, t, "user", f"turn {t % 11}") for c in (11, 13) for t in range(15)] + [(13, 50, "user", "leaves")]
    rows += [(15, t, "user", f"turn {t % 11}") for t in range(13)] + [(15, 99, "user", "elsewhere")]
    assert run(spark, rows, 8) == brute(rows)


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "hello") for c in range(0, 900) for t in range(2)]
    rows += [(1000 + c, t, "user", "hello" if t < 6 else f"own {c}") for c in range(300) for t in range(7)]
    assert run(spark, rows, 6) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(4, 1, "a", "b")], [(0, 1, "a", "b")]])
def test_small_tables(spark, rows):
    assert run(spark, rows, 1) == brute(rows)


def test_negative_ids_are_families_too(spark):
    rows = [(c, t, "r", f"{t}") for c in (-5, -3, 0, 3) for t in range(8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    assert prefix_trie(df).where(F.col("depth") == 0).first()["n_convs"] == 4
