from vaultlake.llm.common import table
from vaultlake.llm.language import _compressors, accepted_documents, identify, learn, predict

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_few_rejections(spark):
    docs = table(spark, SF, "documents")
    got = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out").collect()
    right = sum(x["lang_pred"] == x["lang"] for x in got)
    assert right / len(got) > 0.97
    clean = [x for x in got if len(x["text"]) > 200]
    assert sum(x["rejected"] for x in clean) / len(clean) < 0.01
    assert all(0 <= x["score"] <= 1 for x in got)


def test_odd_texts(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs away", "en") for i in range(40)]
    rows += [(100 + i, f"der schnelle braune Fuchs Nummer {i} springt über den faulen Hund", "de") for i in range(40)]
    odd = [(200, None, "en"), (201, "", "en"), (202, "12 34 !?", "de"), (None, "the lazy dog jumps over the fox", None), (203, "über den faulen Hund " * 50_000, None),
           (204, "the quick brown fox", "en"), (204, "the quick brown fox", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred")
    got = {(x["doc_id"]): (x["lang_pred"], x["rejected"], x["held_out"]) for x in identify(df).collect()}
    assert len(got) == 86 and identify(df).count() == 87
    assert [got[i][0] for i in (200, 201, 202)] == ["und"] * 3 and all(got[i][1] for i in (200, 201, 202))
    assert got[None] == ("en", False, False) and got[203][0] == "de"
    kept = accepted_documents(df)
    assert kept.columns == df.columns and kept.count() == 84
    empty = df.limit(0)
    assert identify(empty).count() == 0 and learn(empty) == {}
    assert {x["lang_pred"] for x in identify(df.withColumn("lang", df["lang"].substr(0, 0).cast("string")).selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_one_language_and_ties():
    one = _compressors({"en": b"the quick brown fox"})
    assert predict("any text", one) == ("en", 1.0, False)
    same = _compressors({"b": b"the same content", "a": b"the same content"})
    assert predict("the same", same) == ("a", 0.5, True)
