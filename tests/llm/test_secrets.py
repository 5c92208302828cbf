import hashlib
import itertools
import random
import re

import numpy as np

from vaultlake.llm import secrets
from vaultlake.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    low = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(low + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(1)) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def check(spark, rows, train=None):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in secrets.find_secrets(frame(rows), train and frame(train)).collect()}
    for i, text in rows:
        want, x = brute(text), got[i]
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x["n_assign"], x["n_access"], x["n_hex"]] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        spans = x["spans"].split(",") if x["spans"] else []
        assert [s for s in spans if not s.startswith("crf")] == want
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    return got


def test_random_strings(spark):
    r = random.Random(9)
    parts = ["password", "PassWd", "Secret", "toKen", "Key", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "ab12", "+/_.-", "é", "\U0001f600", "\n", "x" * 11, "y" * 12]
    check(spark, [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for i in range(2000)])


def test_odd_texts_and_an_added_secret(spark):
    r = random.Random(1)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    rows = [(i, " ".join([*(word() for _ in range(r.randint(5, 40))), *(["token", "=", f'"{key(40)}"' if i % 6 else f'"{key(12)}-{key(12)}-{key(12)}"'] if i % 3 == 0 else []), *(word() for _ in range(9))])) for i in range(300)]
    hidden = f'ding dong é credential = "{key(10)}-{key(12)}-{key(12)}" and so on'
    rows += [(1000, None), (1001, ""), (None, "token = 0123456789abcdef0"), (1002, "a" * 300_000), (1003, "word " * 60_000), (1004, hidden), (1005, " \n\t ")]
    got = check(spark, rows, [x for x in rows if x[0] != 1004])
    assert re.fullmatch(r"crf:\d+:\d+", got[1004]["spans"])
    _, s, e = got[1004]["spans"].split(":")
    assert hidden[int(s) : int(e)] == hidden.split('"')[1]
    assert all("crf" not in got[i]["spans"] for i in range(300))
    assert secrets.find_secrets(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id long, text string").selectExpr("*", "1 as spans", "2 as hit")
    assert [x["spans"] for x in secrets.find_secrets(twice).collect()] == ["", ""]


def test_stretches_equal_the_whole_path():
    r = np.random.default_rng(3)
    for _ in range(30):
        weights = r.normal(0, 2, (sum(secrets.FIELDS), 3))
        weights[:, 0] += 0.6
        model = secrets.Model(weights, r.normal(0, 1, (3, 3)))
        code = r.integers(0, int(np.prod(secrets.FIELDS)), 8)
        best = max(itertools.product(range(3), repeat=8), key=lambda y: sum(model.scores[c][k] for c, k in zip(code, y)) + sum(model.moves[a][b] for a, b in zip((0, *y), (*y, 0))))
        spans = []
        for at, k in enumerate(best):
            if k == 2 and spans and spans[-1][1] == at - 1:
                spans[-1] = (spans[-1][0], at)
            elif k:
                spans.append((at, at))
        assert model.tag(code) == spans


def test_real_texts(spark):
    docs = table(spark, SF, "documents")
    got = check(spark, [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()])
    assert sum("crf" in x["spans"] for x in got.values()) <= 10
