import numpy as np

from vaultlake.llm import quality
from vaultlake.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_ranking(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    s, y = np.array([x["score"] for x in got]), np.array([x["quality"] for x in got])
    better = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    right = np.mean([x["predicted"] == x["quality"] for x in got])
    print("auc", better, "accuracy", right, "kept clean", np.mean([x["predicted"] for x in got if x["quality"]]))
    assert better > 0.95 and right > 0.93
    assert ((0 <= s) & (s <= 1)).all()


def test_compiled_rules_equal_numpy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    names, x, y = quality.sample(docs, labels)
    b, rules = quality.fit(x, y)
    assert 0 < len(rules) < len(quality.find_rules(x, y))
    rows = quality.statistics(docs, "doc_id").withColumn("score", quality.compiled(names, b, rules)).collect()
    z = np.array([[r[c] for c in names] for r in rows])
    want = 1 / (1 + np.exp(-(b + sum(w * quality.holds(rule, z) for rule, w in rules))))
    assert np.allclose(want, [r["score"] for r in rows], atol=1e-12)


def test_odd_rows(spark):
    rows = [(i, "clean words in a line. " * (i % 5 + 1) if i % 2 else "### $$$ %%% " * (i % 7 + 1)) for i in range(200)]
    odd = [(900, None), (901, ""), (902, "x" * 300_000), (None, "a b"), (903, "twice"), (903, "twice"), (904, "\n" * 50_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as score", "2 as label", "3 as id")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(5000, 1, 0), (6000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 207
    by = {x["doc_id"]: x for x in got.collect()}
    assert all((by[i]["score"] > 0.5) == bool(i % 2) for i in range(200)) and by[901]["score"] == by[900]["score"] and not by[None]["held_out"]
    assert {x["score"] for x in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    one = {x["predicted"] for x in quality.classify(docs, labels.where("quality = 0")).collect()}
    assert one == {0}
    assert quality.classify(docs.limit(0), labels).count() == 0
