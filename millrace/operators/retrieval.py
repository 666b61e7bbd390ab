"""Retrieval: postings, BM25, TF-IDF, thresholds, focus and extraction.

An index is four tables: postings (key, term, tf), term_stats (term, df), passage_stats (key, len) and corpus figures in
one row. Queries are a table as well, so many are answered by one join; only the corpus row and the words of queries are
broadcast, and the most common words where documents are normed. A pair of a query and a passage is summed up where the
passage's words lie, so that what a common word gives to each pair is never moved.
"""

from __future__ import annotations

import copy
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.runtime import settle

#: Words of queries, and distinct words of passages, that are broadcast at most.
MOST_WORDS = 100_000


def corpus_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


class Index:
    """passages: key and text; tokens are taken by terms."""

    def __init__(self, passages: DataFrame, key: str, terms: Column):
        self.key = key
        listed = passages.select(key, terms.alias("terms"))
        self.lengths = listed.select(key, F.size("terms").alias("len"))
        self.words = listed.select(key, F.explode("terms").alias("term"))
        self.postings = self.words.groupBy(key, "term").agg(F.count("*").alias("tf"))
        self.term_stats = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        self.corpus = corpus_of(self.lengths)

    def counted(self) -> Index:
        """The index with its words counted once and written, so that texts are taken apart once for all that reads them."""
        if self.words is None:
            return self
        out = copy.copy(self)
        placed = by_key(self.words, self.key).groupBy(self.key, "term").agg(F.count("*").alias("tf"))
        out.words, out.postings = None, settle(placed, "index-postings")
        out.term_stats = settle(out.postings.groupBy("term").agg(F.count("*").alias("df")), "index-terms")
        return out

    def holding(self, asked: DataFrame) -> Index:
        """The index as far as queries need it: only their own words are counted, those of a settled index only read."""
        wanted = asked.select("term").distinct()
        if wanted.limit(MOST_WORDS + 1).count() <= MOST_WORDS:
            wanted = F.broadcast(wanted)
        out = copy.copy(self)
        if self.words is not None:
            out.words = self.words.join(wanted, "term", "left_semi")
            out = out.counted()
        else:
            out.postings, out.term_stats = self.postings.join(wanted, "term", "left_semi"), self.term_stats.join(wanted, "term", "left_semi")
        return out

    def norms(self) -> DataFrame:
        """key and norm of each passage's TF-IDF vector, of a counted index. Words are broadcast if they are so common that there can't be many such; only
        what passages have of rarer ones is moved to meet them."""
        least = self.postings.count() / MOST_WORDS
        square = lambda stats: self.weighted(stats).groupBy(self.key).agg(F.sum(F.col("weight") * F.col("weight")).alias("square"))
        common, rare = F.broadcast(self.term_stats.where(F.col("df") > least)), self.term_stats.where(F.col("df") <= least)
        left = copy.copy(self)
        left.postings = self.postings.join(common, "term", "left_anti")
        rest = left.weighted(rare).select(self.key, (F.col("weight") * F.col("weight")).alias("square"))
        return square(common).unionByName(rest).groupBy(self.key).agg(F.sqrt(F.sum("square")).alias("norm"))

    def weighted(self, stats: DataFrame | None = None) -> DataFrame:
        """postings with their TF-IDF weight, not normed; of the words in stats, if they are given."""
        idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
        return self.postings.join(self.term_stats if stats is None else stats, "term").crossJoin(F.broadcast(self.corpus.select("n"))).select(self.key, "term", "tf", (F.col("tf") * idf).alias("weight"), idf.alias("idf"))


def by_key(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key, in as many parts as shuffles have: pairs of a part's keys and all queries are far more than its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def few(asked: DataFrame) -> DataFrame:
    """Words of queries, to be broadcast if they aren't too many."""
    return F.broadcast(asked) if asked.limit(MOST_WORDS + 1).count() <= MOST_WORDS else asked


def query_terms(queries: DataFrame, query_key: str, terms: Column) -> DataFrame:
    return queries.select(query_key, F.explode(terms).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))


def bm25(index: Index, asked: DataFrame, query_key: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score) for each pair with a term in common; a query's repeated terms count once."""
    key, stored, index = index.key, index.words is None, index.holding(asked)
    lengths, corpus = index.lengths, index.corpus
    if not stored:
        lengths = settle(lengths, "index-lengths")
        corpus = corpus_of(lengths)
    words = few(settle(asked.select(query_key, "term").join(index.term_stats, "term"), "asked-words"))
    hits = by_key(index.postings, key).join(lengths, key).join(words, "term").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return hits.groupBy(query_key, key).agg(F.sum(part).alias("score"))


def tfidf(index: Index, asked: DataFrame, query_key: str) -> DataFrame:
    """Cosine of TF-IDF vectors; a query's repeated terms count, unknown ones don't."""
    index = index.counted()
    key, own = index.key, index.holding(asked)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    known = asked.join(own.term_stats, "term").crossJoin(F.broadcast(index.corpus.select("n"))).select(query_key, "term", idf.alias("idf"), (F.col("qtf") * idf).alias("qw"))
    known = settle(known, "asked-words")
    qnorms = known.groupBy(query_key).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = by_key(own.postings, key).join(few(known), "term").groupBy(query_key, key).agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
    return dots.join(index.norms(), key).join(F.broadcast(qnorms), query_key).select(query_key, key, (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def share(index: Index, asked: DataFrame, query_key: str) -> DataFrame:
    """What the words that a query has, each once, make up of a passage's TF-IDF vector of length 1, summed up."""
    index = index.counted()
    key, own = index.key, index.holding(asked)
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    known = settle(asked.join(own.term_stats, "term").crossJoin(F.broadcast(index.corpus.select("n"))).select(query_key, "term", idf.alias("idf")), "asked-words")
    weights = by_key(own.postings, key).join(index.norms(), key)
    return weights.join(few(known), "term").groupBy(query_key, key).agg(F.sum(F.col("tf") * F.col("idf") / F.col("norm")).alias("score"))


def top_k(scores: DataFrame, query_key: str, key: str, k: int = 5) -> DataFrame:
    """The k best of each query with a positive score; equal ones by key."""
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scores.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)


def by_temperature(scores: DataFrame, query_key: str, temperature: float) -> DataFrame:
    """All whose score reaches best * (1 - temperature); no top-k here."""
    best = scores.where("score > 0").groupBy(query_key).agg(F.max("score").alias("best"))
    return scores.join(best, query_key).where(F.col("score") >= F.col("best") * (1 - temperature)).drop("best")


def score_all(passages: DataFrame, key: str, scores: DataFrame, queries: DataFrame, query_key: str) -> DataFrame:
    """Every pair of a query and a passage, those without a common term at 0. Its size is the product by definition."""
    every = passages.select(key).crossJoin(F.broadcast(queries.select(query_key)))
    return every.join(scores, [query_key, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def distance_activation(scored: DataFrame, doc: str, place: str, tau: float = 1.6, reach: int = 40, *more: str) -> DataFrame:
    """Each sentence's score spreads to its neighbours in the document by exp(-distance / tau).

    A score that is farther than reach * tau places away adds less than exp(-reach) of itself and is left out, so the
    join is a band, not a square."""
    tau = max(tau, 1e-6)
    width = max(1, int(reach * tau))
    sources = scored.where("score <> 0").select(doc, *more, F.col(place).alias("from_place"), "score")
    bounds = scored.groupBy(*(F.col(x).alias(f"of_{x}") for x in (doc, *more))).agg(F.min(place).alias("low"), F.max(place).alias("high"))
    # a document mostly has fewer places than the band, so the band ends with it
    sources = sources.join(bounds, reduce(and_, (F.col(x) == F.col(f"of_{x}") for x in (doc, *more))))
    spread = sources.withColumn("to_place", F.explode(F.sequence(F.greatest("low", F.col("from_place") - width), F.least("high", F.col("from_place") + width))))
    spread = spread.withColumn("part", F.col("score") * F.exp(-F.abs(F.col("from_place") - F.col("to_place")) / tau))
    sums = spread.groupBy(doc, *more, F.col("to_place").alias(place)).agg(F.sum("part").alias("activation"))
    return scored.join(sums, [doc, *more, place], "left").withColumn("activation", F.coalesce("activation", F.lit(0.0)))


def focus_windows(active: DataFrame, query: str, doc: str, place: str, radius: int = 2, k: int = 5) -> DataFrame:
    """Greedy windows of each query around the peaks of activation: a sentence inside an accepted window is no peak.

    Peaks compete within a document alone (windows are clipped to it), so each (query, document) is its own group; the
    k best of a query are picked after that."""
    peaks = F.array_sort(F.collect_list(F.when(F.col("activation") > 0, F.struct((-F.col("activation")).alias("less"), F.col(place).cast("int").alias("at")))))
    none = F.array().cast("array<struct<less: double, at: int>>")
    free = lambda taken, x: (F.size(taken) < k) & ~F.exists(taken, lambda t: F.abs(t["at"] - x["at"]) <= radius)
    picked = F.aggregate("peaks", none, lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    held = active.groupBy(query, doc).agg(peaks.alias("peaks"), F.min(place).cast("int").alias("first"), F.max(place).cast("int").alias("last"))
    each = held.select(query, doc, "first", "last", F.explode(picked).alias("x"))
    low, high = F.greatest("first", F.col("x.at") - radius), F.least("last", F.col("x.at") + radius) + 1
    found = each.select(query, doc, F.col("x.at").alias("peak"), low.alias("low"), high.alias("high"), (-F.col("x.less")).alias("activation"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("activation"), doc, "peak"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def extract_best(candidates: DataFrame, query_key: str, order: list[str], question: Column, sentence: Column) -> DataFrame:
    """The sentence with the most words of the question for the root of its length; the first in order of equal ones.

    question, sentence: arrays of tokens without stopwords."""
    asked = F.array_distinct(question)
    overlap = F.size(F.filter(sentence, lambda x: F.array_contains(asked, x)))
    scored = candidates.withColumn("overlap", overlap).where("overlap > 0").withColumn("score", F.col("overlap") / F.sqrt(F.size(sentence)))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), *order))
    return scored.withColumn("rank", rank).where("rank = 1").drop("rank", "overlap")

