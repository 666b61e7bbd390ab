"""The pipeline's stages: what they keep, and that each works on what the one before it kept."""

import corpus_pipeline
from millrace.llm import quality
from pyspark.sql import functions as F


def prose(seed, n=120):
    import random

    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_stages(spark, sf_dir, tmp_path):
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    shared = prose(99, 12)
    rows = [(1, prose(1)), (2, prose(2) + "\n" + shared), (3, prose(3) + "\n" + shared), (4, prose(4)[:-1] + "\n" + leak), (5, "buy now " * 200), (6, prose(1)), (7, prose(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone__id string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert shared in texts[2][0] and shared not in texts[3][0] and texts[3][1] == len(texts[3][0])
    assert kept["quality_rules"] == {1, 2, 3, 4, 6, 7}
    assert kept["line_dedup"] == {1, 2, 3, 4, 7}
    assert kept["simhash"] == {1, 2, 3, 4, 7} and kept["decontamination"] == kept["packing"] == {1, 2, 3, 7}


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = docs.where(quality.quality_verdict(F.col("text")).getField("kept")).count()
    assert 0 < found.select("doc_id").distinct().count() <= good
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
