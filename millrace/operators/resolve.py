"""Which node a question's words mean, whether a span of words names one, and which predicate a verb means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import strings
from millrace.operators.identity import common_prefix

#: What a term is worth by how closely it is met: the word itself, its stem, the stem without marks, the loose key.
TIERS = (0.8, 0.6, 0.4, 0.25)


def keys_of(word: Column) -> list[Column]:
    stem = strings.stem(word)
    return [F.lower(word).alias("low"), stem.alias("stem"), strings.fold_accents(stem).alias("plain"), strings.loose_key(word).alias("loose")]


def resolve(asked: DataFrame, nodes: DataFrame, aliases: DataFrame, affinity: DataFrame, skip: Sequence[str] = (), speech: str = "výrok") -> DataFrame:
    """question, node, quality, rivals: the node that a question's terms mean.

    More terms met go first, then terms met in their own spelling with capitals, as words, by stem, without marks, loosely;
    then nodes of which the question's predicate is told, nodes met whole, longer ones, heavier ones, and the first in order.
    rivals: other nodes with the same evidence from the names and another loose key (told of, if the winner is).

    asked: question, terms; nodes: id, type, weight; aliases: canonical, alias; affinity: question, id. Terms meet nodes by
    their loose keys, which words that agree in any closer way share."""
    terms = asked.select("question", F.posexplode(F.filter("terms", lambda t: (F.length(t) > 1) & ~strings.fold_accents(t).isin(*skip) if skip else F.length(t) > 1)).alias("at", "term"))
    said = terms.select("question", "at", "term", *keys_of(F.col("term")))
    words = nodes.where(F.col("type") != speech).select("id", F.explode(F.array_distinct(strings.words(F.lower("id")))).alias("word"))
    held = words.select("id", *keys_of(F.col("word"))).select("id", *(F.col(x).alias(f"n_{x}") for x in ("low", "stem", "plain")), "loose")
    met = said.join(held, "loose").select("question", "id", "at", "term", (F.col("low") == F.col("n_low")).alias("ins"), (F.col("stem") == F.col("n_stem")).alias("st"), (F.col("plain") == F.col("n_plain")).alias("da"), F.lit(True).alias("lo"))
    other = aliases.select(F.col("canonical").alias("id"), F.lower("alias").alias("low")).distinct()
    by_alias = said.join(other, "low").join(nodes.where(F.col("type") != speech).select("id"), "id").select("question", "id", "at", "term", F.lit(True).alias("ins"), F.lit(False).alias("st"), F.lit(False).alias("da"), F.lit(False).alias("lo"))
    flags = met.unionByName(by_alias).groupBy("question", "id", "at", "term").agg(*(F.bool_or(x).alias(x) for x in ("ins", "st", "da", "lo")))
    own = F.col("term").rlike(r"\p{Lu}") & ((F.col("term") == F.col("id")) | F.array_contains(strings.words(F.col("id")), F.col("term")))
    worth = F.when(F.col("ins"), TIERS[0]).when(F.col("st"), TIERS[1]).when(F.col("da"), TIERS[2]).otherwise(TIERS[3])
    number = lambda x, name: F.sum(x.cast("int")).alias(name)
    scored = flags.groupBy("question", "id").agg(F.count("*").alias("cover"), number(own, "exact"), *(number(F.col(x), f"{x}_hits") for x in ("ins", "st", "da", "lo")), F.sum(worth).alias("worth"))
    rows = scored.join(nodes.select("id", "weight"), "id").join(affinity.select("question", "id", F.lit(1).alias("told")).distinct(), ["question", "id"], "left").withColumn("told", F.coalesce("told", F.lit(0)))
    size = F.size(strings.words(F.col("id")))
    names = ["cover", "exact", "ins_hits", "st_hits", "da_hits", "lo_hits"]
    order = [*(F.desc(x) for x in names), F.desc("told"), (F.col("cover") == size).desc(), size.desc(), F.desc("weight"), F.col("id")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(*order)))
    counts = terms.groupBy("question").agg(F.count("*").alias("n_terms"))
    best = ranked.where("rank = 1").join(counts, "question")
    quality = F.least(F.lit(1.0), (F.col("worth") + 0.2 * F.col("exact")) / F.col("n_terms"))
    loose = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(strings.words(x), strings.loose_key))), " ")
    winner = best.select("question", F.col("id").alias("node"), quality.alias("quality"), F.struct(*names).alias("evidence"), F.col("told").alias("won_told"), loose(F.col("id")).alias("key"))
    others = ranked.where("rank > 1").select("question", F.col("id").alias("rival"), F.struct(*names).alias("evidence"), "told", loose(F.col("id")).alias("other_key"))
    close = winner.select("question", "evidence", "won_told", "key").join(others, ["question", "evidence"]).where("key <> other_key AND (won_told = 0 OR told = 1)")
    rivals = close.groupBy("question").agg(F.array_sort(F.collect_set("rival")).alias("rivals"))
    return winner.join(rivals, "question", "left").select("question", "node", "quality", F.coalesce("rivals", F.array().cast("array<string>")).alias("rivals"))


def strict_spans(resolved: DataFrame, asked: DataFrame) -> DataFrame:
    """question, node: the resolved questions of which every term is a word of the node, by their loose keys."""
    rows = resolved.select("question", "node").join(asked, "question")
    keys = F.transform(strings.words(F.col("node")), strings.loose_key)
    told = F.transform(F.filter("terms", lambda t: F.length(t) > 1), strings.loose_key)
    return rows.where((F.size(told) > 0) & (F.size(F.array_except(told, keys)) == 0)).select("question", "node")


def left_over(terms: DataFrame, captured: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """question, term: words of content that no part of the pattern has taken; a question with any is not answered from
    context. terms: question, term; captured: question, span."""
    taken = captured.select("question", F.explode(strings.words(F.lower("span"))).alias("low"))
    rows = terms.withColumn("low", F.lower("term")).where(F.length("term") > 1)
    if skip:
        rows = rows.where(~strings.fold_accents(F.col("term")).isin(*skip))
    return rows.join(taken.distinct(), ["question", "low"], "left_anti").select("question", "term")


def match_predicates(words: DataFrame, predicates: DataFrame, negation: str = "ne") -> DataFrame:
    """word, predicate, tier: the predicate that a verb's form means: itself (0), its negation's other half (1), one that
    begins with its l-participle (2), or the one with the longest common prefix, four letters at least and all but two of the
    shorter word (3); small letters first, then in order.

    words: word; predicates: predicate. Forms meet by their first three letters in tiers 2 and 3, so no other pair is made."""
    asked = words.select("word").distinct().withColumn("low", F.lower("word"))
    known = predicates.select("predicate").distinct().withColumn("p_low", F.lower("predicate"))
    same = asked.join(known, F.col("low") == F.col("p_low")).withColumn("tier", F.lit(0)).withColumn("n", F.length("low"))
    other = F.when(F.col("low").startswith(negation), F.expr(f"substring(low, {len(negation) + 1})")).otherwise(F.concat(F.lit(negation), F.col("low")))
    negated = asked.withColumn("other", other).join(known, F.col("other") == F.col("p_low")).drop("other").withColumn("tier", F.lit(1)).withColumn("n", F.length("low"))
    near = asked.withColumn("key", F.substring("low", 1, 3)).join(known.withColumn("key", F.substring("p_low", 1, 3)), "key").drop("key").where("low <> p_low")
    past = F.coalesce(F.col("p_low").startswith(F.regexp_replace(strings.participle_stem(F.col("low")), "l$", "")), F.lit(False)) & (F.length("low") > 3)
    shared = near.withColumn("n", common_prefix(F.col("low"), F.col("p_low")))
    close = (F.col("n") >= 4) & (F.col("n") >= F.least(F.length("low"), F.length("p_low")) - 2)
    far = shared.withColumn("tier", F.when(past, 2).when(close, 3)).where("tier IS NOT NULL")
    columns = ["word", "predicate", "tier", "n"]
    every = same.select(*columns).unionByName(negated.select(*columns)).unionByName(far.select(*columns))
    order = [F.col("tier"), F.desc("n"), F.col("predicate").rlike(r"^\p{Lu}"), F.col("predicate")]
    rank = F.row_number().over(Window.partitionBy("word").orderBy(*order))
    return every.withColumn("rank", rank).where("rank = 1").select("word", "predicate", "tier")
