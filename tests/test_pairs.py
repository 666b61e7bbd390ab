"""Pairs of a query and a passage are summed up where the passage's words lie."""

import re

import pytest
from pyspark.sql import functions as F

from millrace import catalogue
from millrace.operators import retrieval


@pytest.mark.parametrize("name", ["tfidf_topk", "doc_gate"])
def test_no_pair_is_moved_before_it_is_summed(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not [x for x in moved if "item_id" in x and "doc_id" in x]


def test_norms_of_common_and_rare_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a"), (4, "")], "doc_id long, text string")
    index = retrieval.Index(docs, "doc_id", F.split("text", " ")).counted()
    want = {r["doc_id"]: round(r["norm"], 9) for r in index.norms().collect()}
    monkeypatch.setattr(retrieval, "MOST_WORDS", 3)  # words in more than two documents are common
    assert {r["doc_id"]: round(r["norm"], 9) for r in index.norms().collect()} == want
    weights = index.weighted().groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    assert {r["doc_id"]: round(r["norm"], 9) for r in weights.collect()} == want
