import hashlib
import random
import re

from vaultlake.llm import pii
from vaultlake.llm.common import table
from vaultlake.llm.pii import find_personal_data, scan

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(t):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", t))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


VALID = {
    "email": lambda t: True,
    "ip": lambda t: all(int(x) <= 255 for x in t.split(".")),
    "card": lambda t: 13 <= len(re.sub("[^0-9]", "", t)) <= 19 and luhn(t),
    "phone": lambda t: 9 <= len(re.sub("[^0-9]", "", t)) <= 15,
}


#: What the first part of a pattern is made of.  Where a match fails at the start of a whole run of these
#: it fails at every later place of the run too, as the run has to be followed by "@" or ".".
RUNS = {"email": r"[A-Za-z0-9._%+-]+", "ip": r"[0-9]+"}


def leftmost(kind, text):
    """The matches of re.finditer, in linear time: whole runs first."""
    if kind not in RUNS:
        yield from re.finditer(PATTERNS[kind], text)
        return
    run, pattern, at = re.compile(RUNS[kind]), re.compile(PATTERNS[kind]), 0
    while start := run.search(text, at):
        found = pattern.match(text, start.start())
        if found:
            yield found
        at = (found or start).end()


def brute(text):
    return [(k, m.start(), m.end()) for k in PATTERNS for m in leftmost(k, text or "") if VALID[k](m.group())]


def check(spark, rows):
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    for i, text in rows:
        want = brute(text)
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        x = by[i]
        assert x["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (text, base, x["spans"])
        assert [x[f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        spans = x["spans"].split(",") if x["spans"] else []
        assert spans[: len(want)] == [f"{k}:{s}:{e}" for k, s, e in want]
        for extra in spans[len(want) :]:
            _, s, e = extra.split(":")
            assert all(int(e) <= a or b <= int(s) for _, a, b in want)
    return by


def test_linear_reference_equals_finditer():
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("a1.@-_ +") for _ in range(r.randint(0, 16)))
        for k, p in PATTERNS.items():
            assert [m.span() for m in leftmost(k, text)] == [m.span() for m in re.finditer(p, text)], text


def test_random_strings_equal_the_plain_patterns(spark):
    r = random.Random(8)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "+", " ", "  ", "1", "25", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "(", ")", "é", "\U0001f600", "%", "_",
             "10.0.0.1", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713", "00255", "\n", "9" * 13, "0" * 16]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(3000)]
    check(spark, rows)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "a@b.c 10.0.0.1"), (3, "7" * 200_000), (4, "a" * 200_000), (5, "a@" + "b." * 100_000 + "c"), (6, "1.2.3." * 30_000),
            (7, "x@y.z " * 2_000), (8, "+" + "1 " * 50_000), (9, "aa" * 50_000 + "@b.c"), (10, "a.b@c.d_e@f.g"), (11, "300.1.2.3.4.5.6 1.2.3.0255"), (12, "4111 1111 1111 1111 " * 3)]
    check(spark, rows)
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_real_texts_and_added_spans(spark):
    docs = table(spark, SF, "documents")
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    by = check(spark, rows)
    extra = sum(len(x["spans"].split(",")) - sum(x[f"n_{k}"] for k in PATTERNS) for x in by.values() if x["spans"])
    print("added spans", extra)


def test_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.c", 5), (1, "a@b.c", 5)], "doc_id long, text string, base int").selectExpr("*", "1 as x", "2 as rid", "'t' as email")
    assert [x["spans"] for x in find_personal_data(df).collect()] == ["email:0:5"] * 2


def test_generators_propose_what_the_patterns_miss(spark):
    text = "mail me: jane.doe [at] host [dot] org or 555 010 4477, host fe80:0:0:1::12"
    got = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["proposed"]
    assert [x["t"] for x in got] == ["555 010 4477", "jane.doe [at] host [dot] org", "fe80:0:0:1::12"]


def test_thresholds_of_a_rare_generator_at_any_size(spark, monkeypatch):
    """60 documents with an address; a generator's threshold must not go as the other proposals grow."""
    found, plain = [], pii._thresholds

    def thresholds(scored):
        counts = {x["g"]: x["count"] for x in scored.groupBy("g").count().collect()}
        found.append((counts, plain(scored)))
        return found[-1][1]

    monkeypatch.setattr(pii, "_thresholds", thresholds)
    rare = spark.range(60).selectExpr("id as doc_id", "concat('from 10.0.', id, '.7 on') as text")
    for each in (5, 130):
        many = spark.range(1000, 1240).selectExpr("id as doc_id", f"repeat('a +1 555 010 4477 b 555 010 4477 ', {each}) as text")
        find_personal_data(rare.union(many)).count()
        docs = rare.union(many).selectExpr("doc_id", "pmod(xxhash64(1, doc_id), 2) as part").where("part = 1")
        odd = docs.where("doc_id < 60").count()
        counts, limits = found[-1]
        assert counts[0] == 2 * each * docs.where("doc_id >= 1000").count()
        assert counts[2] == odd >= pii.LEAST_CASES
        assert 2 in limits
