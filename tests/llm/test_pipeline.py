"""The pipeline's stages on the smallest tables: each decision takes effect and nothing else goes."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphlens.llm import common, decontam, mixing, neardup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, SF), name)
        if name != "sharding":
            assert out.columns == docs.columns
        before, after = ids(docs), ids(out)
        if name == "toxicity":
            model = toxicity.train(docs, common.table(spark, SF, "labels"))
            scored = toxicity.score(docs, model)
            assert after == ids(scored.where(F.col("score") < toxicity.THRESHOLD))
        elif name == "near_duplicates":
            assert after == ids(neardup.near_duplicates(docs).where("kept"))
        elif name == "decontamination":
            assert before - after == ids(decontam.contaminated(docs, common.table(spark, SF, "benchmark")))
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs).collect() if r["taken"]}
            words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
            assert words == taken
        else:
            assert out.count() == docs.count() and out.where("shard IS NULL").count() == 0
        seen[name], docs = out, out
    assert list(seen) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_decide_by_row(spark):
    item = next(r["text"] for r in common.table(spark, SF, "benchmark").orderBy("item_id").collect())
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(60))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    rest = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    clean = [(1, text(1)), (1, text(2)), (None, text(3)), (None, ""), (None, ""), (None, None), (2, text(4)), (3, text(5))]
    leaked = [(1, "a " + item), (None, "b " + item), (4, item)]
    assert rest(corpus_pipeline.decontamination_stage(spark, make(clean + leaked), SF)) == sorted(clean, key=str)
    near = text(4).replace("t4w59", "other")
    copies = [(7, text(4)), (8, near), (None, text(5)), (1, text(1)), (None, text(3)), (3, text(4))]
    own = [(7, text(6)), (8, text(7))]
    got = rest(corpus_pipeline.near_duplicate_stage(spark, make(clean + own + copies), SF))
    one_of = {t: [r for r in got if r[1] == t] for t in map(text, range(1, 8))}
    assert all(len(x) == 1 for x in one_of.values()) and near not in [t for _, t in got]
    assert (7, text(6)) in got and (8, text(7)) in got and (1, text(2)) in got
    assert got.count((None, "")) == 2 and got.count((None, None)) == 1 and len(got) == 10


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages_take_odd_rows(spark):
    text = lambda n: " ".join(f"t{n}w{i}" for i in range(60))
    rows = [(1, text(1), "a"), (2, text(1), "b"), (2, text(2), "a"), (3, text(2), "b"), (4, None, "a"), (5, "", None), (6, " \n", "a"), (None, text(3), "a"), (None, None, None), (7, text(4), None), (7, text(4), None), (8, text(5) * 40, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["row_", "key", "row", "score", "shared", "id", "kept", "gone", "count", "words", "take", "n_chars"]
    odd = docs.withColumns({n: F.lit(7) for n in names})
    near = corpus_pipeline.near_duplicate_stage(spark, odd, SF).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in near), key=str)
    # every text has one row left, that of its smallest doc_id; blank rows stay
    assert got == sorted([(1, text(1)), (3, text(2)), (4, None), (5, ""), (6, " \n"), (None, text(3)), (None, None), (7, text(4)), (8, text(5) * 40)], key=str)
    for table in (odd, odd.where("false")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = common.stored(stage(spark, now, SF), name)
            assert now.columns[: len(odd.columns)] == odd.columns
            for r in now.collect():
                assert all(r[n] == 7 for n in names if n != "n_chars" or name not in ("mixing", "sharding"))
        assert (now.count() > 0) == (table is odd)
