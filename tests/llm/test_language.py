"""Language identification: held-out accuracy, mixtures, the likelihoods against a plain count, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from millrace.llm import language, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.learn(docs.where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.QUERIES["op13_language_id"](spark, SF).collect()}
    told = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.select("doc_id", "lang", "text").collect()}
    assert rows.keys() == told.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [r["lang_pred"] == told[i][0] for i, r in rows.items() if r["held_out"] and told[i][0]]
    assert len(held) > 100 and np.mean(held) > 0.98


def test_mixtures(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) BETWEEN 2000 AND 6000")
    texts = {r["lang"]: r["text"] for r in docs.select("lang", "text").collect()}
    de, fr = texts["de"][:1500], texts["fr"][:500]
    one, two = language.verdicts(model, [texts["en"][:1500], f"{de} {fr}"], language.Known(model))
    assert [x["lang"] for x in one["languages"]] == ["en"]
    share = language.words_of(de).total() / language.words_of(f"{de} {fr}").total()
    assert [x["lang"] for x in two["languages"]] == ["de", "fr"] and abs(two["score"] - share) < 0.05


def test_likelihoods_are_those_of_plain_counts(spark):
    rows = [("aba abb", "x"), ("bab ba aba", "x"), ("cc", "y")]
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    chars = [(a, b, c) for t, lang in rows if lang == "x" for w in t.split() for a, b, c in zip("\0\0" + w, "\0" + w, w + "\0", strict=False)]
    three, two, one, context, last = (Counter(f(x) for x in chars) for f in (lambda x: x, lambda x: x[1:], lambda x: x[2], lambda x: x[:2], lambda x: x[1]))
    policy, want = model.policy, 0.0
    for a, b, c in zip("\0\0abba", "\0abba", "abba\0", strict=False):
        p1 = (one[c] + policy.floor * len(chars)) / (len(chars) * (1 + policy.floor * 256))
        p2 = (two[b, c] + policy.back_off * p1) / (last[b] + policy.back_off)
        want += math.log((three[a, b, c] + policy.back_off * p2) / (context[a, b] + policy.back_off))
    assert model.names == ["x", "y"] and model.likelihoods(["ba", "abba"])[1, 0] == pytest.approx(want)


def test_expectation_maximisation_raises_the_likelihood(model):
    rnd = np.random.default_rng(1)
    owner, count, like = np.repeat([0, 1], [40, 60]), rnd.integers(1, 4, 100).astype(float), rnd.normal(-9, 3, (100, len(model.names)))
    fits = []
    for rounds in (1, 3, 12, 50):
        own = language.LanguageModel(model.names, model.counts, language.LanguagePolicy(rounds=rounds))
        share, fit = own.mixture(owner, 2, count, like, np.ones((2, 4)), np.full((2, 4), 0.25))
        fits.append(fit)
        plain = [sum(n * math.log(sum(share[d] * np.exp(x))) for o, n, x in zip(owner, count, like, strict=True) if o == d) for d in (0, 1)]
        assert np.allclose(share.sum(1), 1) and np.allclose(fit, plain)
    assert all((b >= a - 1e-9).all() for a, b in zip(fits, fits[1:], strict=False))


def test_odd_rows(spark, model):
    long = "the and of " * 100_000
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 ² _ --", None), (4, "the", None), (4, "the", None), (None, long, "x"), (5, "a²b", None), (6, "x" * 300_000, None), (7, "\ud800 the".encode("utf-8", "ignore").decode(), None)]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, language string")
    found = language.identify(docs, model, out="found").collect()
    assert [r["found"]["lang_pred"] for r in found][:3] == ["und"] * 3 and all(r["found"]["lang_pred"] != "und" for r in found[3:])
    assert found[3]["found"] == found[4]["found"] and found[5]["found"]["lang_pred"] == "en" and all(r["language"] == "own" for r in found)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.op13_language_id(none).count() == 0
    untold = language.op13_language_id(spark.createDataFrame([(1, "the", None), (None, "x", "en")], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"], r["held_out"]) for r in untold if r["doc_id"]] == [("und", 0.0, zlib.crc32(b"1") % 4 == 2)]
