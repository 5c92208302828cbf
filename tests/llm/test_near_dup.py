import random
import re

import numpy as np
import pytest

from vaultlake.llm import near_dup
from vaultlake.llm.near_dup import near_duplicates
from vaultlake.llm.shingles import BLOCK, text_shingles, word_hashes

SCHEMA = "doc_id long, text string, component_id string, sig long"


def brute(rows, percent=85):
    sets = {}
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 85 * max(len(x), len(y)) <= 100 * min(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in sets)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed=3, groups=30, copies=6):
    r = random.Random(seed)
    rows, word = [], lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    for _ in range(groups):
        base = [word() for _ in range(r.choice([1, 3, 5, 9, 40, 200, 700]))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows) * 3 + 1, r.choice([" ", "\t", " \n"]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [near_dup.BLOCK_ROWS, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert rows_of(near_duplicates(df)) == brute(rows)


def similar_pairs(rows, percent):
    """Roots of the graph of all pairs with intersection >= percent % of the union."""
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


@pytest.mark.parametrize("percent", [80, 85])
def test_small_sets_at_the_threshold(spark, percent):
    """Texts of 4 to 7 shingles and their extensions by one or two words."""
    rows = []
    for g in range(40):
        for n in range(4, 8):
            words = [f"g{g}n{n}w{i}" for i in range(n + 6)]
            rows += [(len(rows) + k, " ".join(words[: n + 4 + k])) for k in range(3)]
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == similar_pairs(rows, percent)


def test_bands_follow_the_threshold():
    assert near_dup.banding(85) == (25, 5)
    for percent in range(70, 100):
        bands, rows = near_dup.banding(percent)
        assert bands * rows <= near_dup.HASHES and (1 - (percent / 100) ** rows) ** bands <= near_dup.MISSED
    assert [n for n in range(1, 9) if near_dup.only_equal(n, 80)] == [1, 2, 3]
    assert [n for n in range(1, 9) if near_dup.only_equal(n, 85)] == [1, 2, 3, 4, 5]


def test_hot_group_of_noisy_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(160)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert rows_of(near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "Ä b c d e"), (8, "ä b c d e"),
            (9, long), (10, long + " end"), (None, "one"), (11, "same row"), (11, "same row")]
    got = {(r[0], r[1]): r[2] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0): 1, (2, 0): 2, (3, 0): 3, (4, 1): 4, (5, 1): 4, (6, 1): 6, (7, 1): 7, (8, 1): 8, (9, 59_996): 9,
                   (10, 59_997): 9, (None, 1): None, (11, 1): 11}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_over_blocks():
    words = ["a" * 5, "b" * (2 * BLOCK + 3), "c" * 70_000, "d", "e" * (BLOCK - 1)]
    one = word_hashes(" ".join(words).encode())
    assert one.tolist() == [word_hashes(w.encode())[0] for w in words]
    assert len(set(one.tolist())) == len(words)
    assert len(text_shingles("a b c d", 5)) == 1 and not len(text_shingles("", 5))


def test_estimate_is_near_the_similarity():
    r = np.random.default_rng(0)
    for share in (0.5, 0.7, 0.9):
        a = r.integers(0, 2**63, 4000, dtype=np.uint64)
        b = np.concatenate([a[: int(4000 * share)], r.integers(0, 2**63, 4000 - int(4000 * share), dtype=np.uint64)])
        sig = [np.frombuffer(near_dup.signature(near_dup.minima(np.unique(x))), dtype=np.uint64) for x in (a, b)]
        est = (near_dup.equal_slots(*sig) / 128 - 0.25) / 0.75
        assert abs(est - share / (2 - share)) < 0.15


def test_an_id_with_several_texts_in_any_order(spark):
    """All texts of an id count, whichever row comes first."""
    r = random.Random(11)
    text = lambda seed: [f"w{seed}_{i}" for i in range(60)]
    near = lambda words: [*words[:-1], "other"]
    rows = [(1, text(0)), (0, text(1)), (1, text(1)), (5, text(2)), (5, text(3)), (6, near(text(3))), (7, near(text(2))), (8, near(text(0))), (9, text(9)), (9, text(9)), (9, text(10))]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = {0: 0, 1: 0, 8: 0, 5: 5, 6: 5, 7: 5, 9: 9}
    for _ in range(3):
        r.shuffle(rows)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {x["doc_id"]: x["component_id"] for x in got} == want and len(got) == len(rows)
        assert all(x["kept"] == (want[x["doc_id"]] == x["doc_id"]) and x["n_shingles"] == 56 for x in got)
