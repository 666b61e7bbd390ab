"""The pipeline's near copies are linked by fingerprints and by shingle sets, and links of both kinds chain."""

import random

import corpus_pipeline
from millrace.llm import simhash, similar


def words(seed, n):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_fingerprints_link_what_sets_do_not(spark, sf_dir):
    base = ["alpha", "beta", "gamma"] * 400
    first, second = base + words(1, 60), base + words(2, 60)
    third = [*second[:-1], "changed"]  # near the second by its set
    texts = {5: " ".join(first), 3: " ".join(second), 8: " ".join(third), 9: " ".join(words(3, 200))}
    assert simhash.fingerprint(texts[5]) == simhash.fingerprint(texts[3])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in similar.drop_similar(docs).collect()} == {3, 5, 9}
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.collect()} == {3, 9}


def test_long_texts_with_a_common_passage_are_not_compared(spark, monkeypatch):
    passage = words(4, 900)
    docs = spark.createDataFrame([(i, " ".join(passage + words(10 + i, 600))) for i in range(8)], "doc_id long, text string")
    made = docs.select("doc_id", similar.sets(docs["text"]).alias("s")).select("doc_id", "s.*")
    compared = []
    monkeypatch.setattr(similar, "verified", lambda pairs, docs, nodes: compared.append(pairs.count()) or pairs)
    similar.similar_links(made, docs, made.selectExpr("node", "doc_id AS rep", "1L AS copies"))
    assert compared == [0, 0]
