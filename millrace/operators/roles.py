"""The predicate-and-role engine: frames, templates, routing, ranking, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def frame_signature(slot: Column, window: Window, radius: int = 2, joiner: str = "·") -> Column:
    """Slots of a token and its neighbours; places beyond the sentence are left out."""
    around = [F.lag(slot, d).over(window) if d > 0 else F.lead(slot, -d).over(window) if d < 0 else slot for d in range(radius, -radius - 1, -1)]
    return F.concat_ws(joiner, *around)


def confirmed(observed: DataFrame, least: int = 3) -> DataFrame:
    """frame, role: frames that were seen often enough and always in one role."""
    return observed.groupBy("frame").agg(F.count("*").alias("n"), F.count_distinct("role").alias("roles"), F.min("role").alias("role")).where(f"roles = 1 and n >= {least}").select("frame", "role", "n")


def template_match(asked: DataFrame, templates: DataFrame, least: float = 0.5) -> DataFrame:
    """asked: query, slots; templates: template, slots. Equal slots score 1; only where no template is equal, those by
    the Jaccard measure from least on. Pairs meet by a slot that they share, never as a product."""
    by_slot = lambda frame, key: frame.select(key, F.array_distinct("slots").alias("slots")).withColumn("size", F.size("slots")).select(key, "size", F.explode("slots").alias("slot"))
    common = by_slot(asked, "query").withColumnRenamed("size", "n").join(by_slot(templates, "template").withColumnRenamed("size", "m"), "slot")
    scored = common.groupBy("query", "template", "n", "m").agg(F.count("*").alias("both")).withColumn("score", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    best = scored.where(F.col("score") >= least).withColumn("best", F.max("score").over(Window.partitionBy("query")))
    return best.where("best < 1 or score = 1").select("query", "template", "score")


def route_docs(facts: DataFrame, predicate: str, hole: str, known: Sequence[str], most_refs: int = 24, most_docs: int = 4) -> DataFrame:
    """facts: doc, sent, predicate, role, lemma. Documents with a known lemma in another role than the one asked for, of
    facts that have that role: by matched terms, then references, then id."""
    mine = facts.where(F.lower("predicate") == predicate.lower())
    holes = mine.where(F.col("role") == hole).select("doc", "sent").distinct()
    hits = mine.where((F.col("role") != hole) & F.lower("lemma").isin(*(x.lower() for x in known))).select("doc", "sent", F.lower("lemma").alias("lemma")).distinct().join(holes, ["doc", "sent"], "left_semi")
    terms = hits.groupBy("doc").agg(F.count_distinct("lemma").alias("terms"))
    refs = hits.select("doc", "sent").distinct().orderBy("doc", "sent").limit(most_refs).groupBy("doc").agg(F.count("*").alias("refs"))
    return refs.join(terms, "doc").orderBy(F.desc("terms"), F.desc("refs"), "doc").limit(most_docs).select("doc", "terms", "refs")


def rank_candidates(candidates: DataFrame, key: str, measures: Sequence[str], heat: str, factor: float = 2.0) -> DataFrame:
    """The first two of each key by measures, then heat: the answer, and whether it stands clear of the second (by a
    measure, or by more than factor times its heat)."""
    order = [F.desc(m) for m in (*measures, heat)]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order, "value"))
    two = candidates.withColumn("rank", rank).where("rank <= 2")
    first = two.where("rank = 1").select(key, "value", F.struct(*measures).alias("m1"), F.col(heat).alias("h1"))
    second = two.where("rank = 2").select(key, F.struct(*measures).alias("m2"), F.col(heat).alias("h2"))
    joined = first.join(second, key, "left")
    clear = F.col("m2").isNull() | (F.col("m1") > F.col("m2")) | (F.col("h1") > factor * F.col("h2"))
    return joined.select(key, "value", F.when(clear, "answer").otherwise("clarify").alias("verdict"))


def polar(pairs: DataFrame, cooccurring: DataFrame) -> DataFrame:
    """pairs: a, b -> a, b, answer: yes where they occur in one fact, else null (absence is no denial)."""
    seen = cooccurring.select("a", "b").distinct().withColumn("answer", F.lit("yes"))
    return pairs.join(seen, ["a", "b"], "left")


def zone_profile(rows: DataFrame, key: str, zone: str) -> DataFrame:
    """key, zone, n, share of the key's rows."""
    counted = rows.groupBy(key, zone).agg(F.count("*").alias("n"))
    total = counted.groupBy(key).agg(F.sum("n").alias("total"))
    return counted.join(total, key).select(key, zone, "n", (F.col("n") / F.col("total")).alias("share"))


def compose_mount(routed: DataFrame, lexical: DataFrame, key: str, mode: str = "union") -> DataFrame:
    """routed, lexical: key, doc, rank. Without routed documents the lexical ones; else replaced by, joined with, or
    joined and cut to the longer list."""
    first = routed.select(key, "doc", F.lit(0).alias("part"), "rank")
    second = lexical.select(key, "doc", F.lit(1).alias("part"), "rank")
    if mode == "replace":
        second = second.join(routed.select(key).distinct(), key, "left_anti")
    merged = first.unionByName(second).groupBy(key, "doc").agg(F.min(F.struct("part", "rank")).alias("at"))
    placed = merged.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at", "doc")))
    if mode == "union_cap":
        sizes = first.unionByName(second).groupBy(key).agg(F.greatest(F.count_if(F.col("part") == 0), F.count_if(F.col("part") == 1)).alias("cap"))
        placed = placed.join(sizes, key).where(F.col("place") <= F.col("cap"))
    return placed.select(key, "doc", "place")


def logistic(features: Sequence[Column], means: Sequence[float], deviations: Sequence[float], weights: Sequence[float], bias: float) -> Column:
    """The probability of a standardized logistic model; 1 for a wrong number of features."""
    if not len(features) == len(means) == len(deviations) == len(weights):
        return F.lit(1.0)
    z = F.lit(bias)
    for x, m, d, w in zip(features, means, deviations, weights, strict=True):
        z = z + (x - m) / d * w
    z = F.least(F.greatest(z, F.lit(-60.0)), F.lit(60.0))
    return 1 / (1 + F.exp(-z))


def doc_gate(postings: DataFrame, asked: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """postings: doc, term, weight; asked: query, term, heat. Documents by the sum of heat * weight, then by name."""
    scored = postings.join(asked, "term").groupBy(query, "doc").agg(F.sum(F.col("heat") * F.col("weight")).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def round_robin(facts: DataFrame, doc: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first facts of each document in turn, k in all."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return facts.withColumn("turn", rank).orderBy("turn", doc).limit(k)
