import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from vaultlake.llm import mixing, packing
from vaultlake.llm.exact_dedup import directory, exact_duplicates, normalised
from vaultlake.llm.mixing import mix_sources, mixed_documents, numbered, period, plan, whole_parts
from vaultlake.llm.packing import best_fit, pack

DOCS = "doc_id long, text string"


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


TEXTS = ["a b", "a  b", "a\t\nb", " a b", "a b ", "", None, " ", "\x0b\x0c\r", " a b", "é 漢\U0001f600", "x" * 200_000, "A b"]


@pytest.mark.parametrize("bits,capacity", [(64, 16_384), (2, 1), (9, 3)])
def test_exact_dedup_with_colliding_keys(spark, bits, capacity):
    r = random.Random(1)
    rows = [(i, r.choice(TEXTS) if r.random() < 0.6 else f"t {r.randrange(40)}") for i in range(300)]
    rows += [(None, "only null"), (None, "a b"), (7, rows[7][1]), (2**40, "big")]
    got = exact_duplicates(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 key", "2 norm", "3 sha"), capacity=capacity, key_bits=bits)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_exact(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_normalised_equals_the_plain_rule(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = spark.createDataFrame(rows, DOCS).select("doc_id", normalised().alias("n")).collect()
    assert {x[0]: x[1] for x in got} == {i: norm(t) for i, t in rows}


def test_directory_splits_only_overfull_buckets(spark):
    keys = [-(2**63) + i for i in range(100)] + [5, 2**62]
    d = directory(spark.createDataFrame([(k,) for k in keys], "key long"), 10).collect()
    depth = {x["slot"]: x["depth"] for x in d}
    assert depth[0] == 1 and depth[1 << 14] == 1 and depth[1 << 15] == 16


def test_period_stays_within_one_block():
    for share in ({"a": 500, "b": 300, "c": 199, None: 1}, {"a": 910, **{f"s{i}": 9 for i in range(10)}}, {"x": 7}):
        total, got = sum(share.values()), Counter()
        for t, s in enumerate(period(share)):
            got[s] += 1
            for k, w in share.items():
                assert abs(got[k] - (t + 1) * w / total) < 1
        assert got == share


def brute_mix(counts, weights, block, parts, min_weight):
    """Slot by slot, with the blocks counted."""
    left = {s: math.ceil(n / block) for s, n in counts.items() if n}
    done, out, slot, in_mix = Counter(), {}, 0, True
    active = {s: weights[s] for s in left if weights.get(s)}
    whole = sum(active.values())
    while left:
        if not active:
            active, in_mix = dict(left), False
        in_mix = in_mix and sum(active.values()) >= min_weight * whole
        share = whole_parts(active, parts)
        order = period(share)
        for t in range(10**9):
            s = order[t % len(order)]
            if not left[s]:
                break
            out[s, done[s]] = (slot, in_mix)
            done[s] += 1
            left[s] -= 1
            slot += 1
        for s in [s for s, n in left.items() if not n]:
            del left[s], active[s]
    return out


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 1, None: 2}, {"a": 5, "b": 1, "c": 3, None: 1}])
def test_mix_equals_the_slot_by_slot_version(spark, weights):
    r = random.Random(2)
    sources = ["a"] * 300 + ["b"] * 40 + ["c"] * 90 + [None] * 25
    rows = [(i, s, "t") for i, s in enumerate(sources)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, h string")
    counts = Counter(sources)
    want = brute_mix(counts, weights or {s: n**0.7 for s, n in counts.items()}, 4, 50, 0.5)
    ranks = defaultdict(list)
    for i, s, _ in rows:
        ranks[s].append((hashlib.md5(str(i).encode()).hexdigest(), i))
    got = mix_sources(df, weights, block=4, parts=50).collect()
    assert len(got) == len(rows)
    for x in got:
        number = sorted(ranks[x["source"]]).index((hashlib.md5(str(x["doc_id"]).encode()).hexdigest(), x["doc_id"]))
        assert (x["block"], x["place"]) == divmod(number, 4)
        assert (x["slot"], x["in_mix"]) == want[x["source"], x["block"]]
    assert len({(x["slot"], x["place"]) for x in got}) == len(rows)
    kept = mixed_documents(df, weights=weights, block=4, parts=50)
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(x["doc_id"] for x in got if x["in_mix"])


@pytest.mark.parametrize("weights", [None, {"hot": 0.5, **{f"s{i}": 0.5 / 19 for i in range(19)}}])
def test_mix_stays_within_one_block_of_the_target_weights(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "SLOTS", 1000, raising=False)
    counts = {"hot": 20_000, **{f"s{i}": 2_000 for i in range(19)}}
    df = spark.range(58_000).selectExpr("id as doc_id", "if(id < 20000, 'hot', concat('s', (id - 20000) div 2000)) as source")
    got = mix_sources(df, weights).collect()
    assert len({(x["slot"], x["place"]) for x in got}) == len({x["doc_id"] for x in got}) == 58_000
    order = [s for _, s in sorted({(x["slot"], x["source"]) for x in got})]
    assert len(order) == sum(math.ceil(n / 8) for n in counts.values())
    target = {s: Fraction(w) for s, w in (weights or {s: n**0.7 for s, n in counts.items()}).items()}
    whole, done = sum(target.values()), Counter()
    for t, s in enumerate(order):
        done[s] += 1
        assert all(abs(done[k] - (t + 1) * w / whole) < 1 for k, w in target.items())
        if done[s] * 8 >= counts[s]:
            break
    assert t > 2000


def test_numbers_over_small_parts(spark):
    df = spark.range(500).selectExpr("id as doc_id", "'s' as source")
    got = numbered(df, 500, run=3).collect()
    assert sorted(x["number"] for x in got) == list(range(500))


def test_mix_of_odd_rows(spark):
    schema = "doc_id long, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None), (None, None), (1, "a"), (1, "a"), (2, "")]
    assert mix_sources(spark.createDataFrame(rows, schema)).count() == 5
    assert plan({"a": 3}, {"a": 1}, 8, 10, 0.5) == [("a", 0, 1, 10, 0, 10, [0], True)]


def test_pack_fits_and_costs_no_more_than_one_size():
    r = random.Random(4)
    for _ in range(20):
        lengths = sorted((r.choice([r.randint(1, 100), r.randint(100, 3000), 32_768]) for _ in range(300)), reverse=True)
        bins, sizes = pack(lengths)
        held = Counter()
        for b, n in zip(bins, lengths):
            held[b] += n
        assert all(held[b] <= c and not any(held[b] <= s < c for s in packing.SIZES) for b, c in enumerate(sizes))
        only = pack(lengths, (32_768,))[1]
        assert sum(map(packing.cost, sizes)) <= sum(map(packing.cost, only))


def test_best_fit_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST", 50)
    r = random.Random(6)
    rows = [(i, "ä" * r.choice([0, 1, 40, 900, 5000])) for i in range(200)] + [(None, None), (5, "twice"), (5, "twice"), (900, "x" * 100_000)]
    got = best_fit(spark.createDataFrame(rows, DOCS), shard=100_000).collect()
    total = Counter()
    for x in got:
        total[x["doc_id"]] += x["length"]
    want = Counter()
    for i, t in rows:
        want[i] += len((t or "").encode()) + 1
    assert total == want
    bins = defaultdict(list)
    for x in got:
        bins[x["bin"], x["size"]].append((x["offset"], x["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= size
    assert sorted((x["piece"], x["start"], x["length"]) for x in got if x["doc_id"] == 900) == [(0, 0, 32768), (1, 32768, 32768), (2, 65536, 32768), (3, 98304, 1697)]
    assert best_fit(spark.createDataFrame([], DOCS)).count() == 0
