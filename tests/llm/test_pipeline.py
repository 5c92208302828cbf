import random

import corpus_pipeline
from tests.llm.test_near_dup import brute as near_brute
from vaultlake.llm import language
from vaultlake.llm.exact_dedup import normalised
from vaultlake.llm.mixing import mix_sources

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(3).collect()
    odd = [(None, "the first null id", "en", None, None), (9_001, None, None, None, 0), (9_002, "", "en", "src1", 0),
           (some[0]["doc_id"], some[0]["text"], some[0]["lang"], some[0]["source"], some[0]["n_chars"])]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 as kept", "'x' as norm", "2 as component_id")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    step = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        if name != "pack":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        step[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = step[name][1]
    ids = lambda df: sorted((x[0] for x in df.select("doc_id").collect()), key=str)

    before, after = step["language"]
    dictionaries = language._compressors(language.learn(before))
    assert ids(after) == sorted((x["doc_id"] for x in before.collect() if not language.predict(x["text"], dictionaries)[2]), key=str)
    before, after = step["exact_dedup"]
    firsts = {}
    for x in before.select("doc_id", normalised().alias("n")).collect():
        firsts[x["n"]] = min((i for i in (firsts.get(x["n"]), x["doc_id"]) if i is not None), default=None)
    assert ids(after) == sorted(firsts.values(), key=str)
    before, after = step["near_dedup"]
    want = [i for i, _, _, kept in near_brute([(x["doc_id"], x["text"]) for x in before.collect() if x["doc_id"] is not None]) if kept]
    assert ids(after) == sorted([*want, *[None] * before.where("doc_id is null").count()], key=str)
    before, after = step["mix"]
    assert ids(after) == ids(mix_sources(before).where("in_mix"))
    before, after = step["pack"]
    assert set(ids(after)) == set(ids(before))
    total = sum(len((x["text"] or "").encode()) + 1 for x in before.collect())
    assert after.agg({"length": "sum"}).first()[0] == total


def test_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_text_is_lost_where_ids_repeat(spark):
    """Rows share ids but not texts: decisions go by id and text."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, rows: sorted((x["doc_id"], x["text"]) for x in stages[name](spark, spark.createDataFrame([(*x, "en", "s", 1) for x in rows], schema), "").collect())
    rows = [(1, "A text"), (0, "B text"), (1, "B text"), (1, "B  text"), (2, "C text"), (2, "C text"), (None, "A\ttext")]
    for order in (rows, rows[::-1]):
        assert run("exact_dedup", order) == [(0, "B text"), (1, "A text"), (2, "C text")]
    long = lambda seed, end="": " ".join([*(f"w{seed}_{i}" for i in range(60)), end])
    rows = [(1, long(0)), (0, long(1)), (1, long(1, "x")), (3, long(2)), (3, long(3)), (4, long(3, "y")), (4, long(4)), (5, long(0, "z"))]
    want = sorted([(1, long(0)), (0, long(1)), (3, long(2)), (3, long(3)), (4, long(4))])
    for order in (rows, rows[::-1]):
        assert run("near_dedup", order) == want
