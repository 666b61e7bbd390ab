"""The quality rules are fitted to all labelled documents."""

import dataclasses
import inspect

import numpy as np
from millrace.llm import quality
from pyspark.sql import functions as F


def test_quantiles_of_counted_values():
    rnd = np.random.default_rng(1)
    values, counts = np.round(rnd.uniform(0, 1, 300), 4), rnd.integers(1, 9, 300)
    for q in (0.0, 0.002, 0.31, 0.5, 0.998, 1.0):
        assert abs(quality.quantile(values, counts, q) - np.quantile(np.repeat(values, counts), q)) < 1e-12


def test_no_labelled_document_is_left_out(spark, sf_dir, monkeypatch):
    assert "sample" not in {x.name for x in dataclasses.fields(quality.Fit)} and ".limit(" not in inspect.getsource(quality.fitted_policy)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    told = labels.where("quality IS NOT NULL").select("doc_id").distinct()
    verdict = quality.quality_verdict(F.col("text"))
    judged = docs.join(told, "doc_id", "left_semi").select("doc_id", verdict.alias("v")).where("NOT v.base_failed AND v.n_bytes > 0")
    seen = {}
    monkeypatch.setattr(quality, "fitted", lambda sizes, ratios, least, most, good, policy, fit, counts: seen.update(n=counts[~np.isnan(ratios)].sum()) or policy)
    quality.fitted_policy(docs, labels)
    assert seen["n"] == judged.count() > 0


def test_no_text_is_moved_for_the_fit(spark, sf_dir, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    plans, own = [], quality.settle
    monkeypatch.setattr(quality, "settle", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, label))
    quality.fitted_policy(docs, labels)
    assert plans and not any("Join" in x or "Exchange" in x for x in plans)
