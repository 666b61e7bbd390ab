"""Votes of the whole corpus, and what they scrub from the graph.

tokens: doc_id, sent_idx, pos, form and, where an annotation gives them, lemma, upos, feats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.facts import explode_participants, keyed, upsert

MIN_VOTES, DOMINANCE = 3, 0.8
MIN_CASE_VOTES = 2


def votes(tokens: DataFrame, key: Column, value: Column) -> DataFrame:
    """key, value, n."""
    return tokens.select(key.alias("key"), value.alias("value")).where("key is not null and value is not null").groupBy("key", "value").agg(F.count("*").alias("n"))


def dominant(counted: DataFrame, least: int = MIN_VOTES, share: float = DOMINANCE) -> DataFrame:
    """key, value: the value that has at least `share` of a key's votes, where there are at least `least`."""
    total = counted.groupBy("key").agg(F.sum("n").alias("total"), F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("best"))
    return total.where((F.col("total") >= least) & (F.col("best") / F.col("total") >= share)).select("key", "value", "best", "total")


def dominated_by(counted: DataFrame, kinds: Sequence[str], least: int = MIN_VOTES, share: float = DOMINANCE) -> DataFrame:
    """key: those of which values of the kinds have the share of all votes."""
    total = counted.groupBy("key").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("value").isin(*kinds), F.col("n")).otherwise(0)).alias("held"))
    return total.where((F.col("total") >= least) & (F.col("held") / F.col("total") >= share)).select("key")


def case_votes(tokens: DataFrame) -> DataFrame:
    """word, lower, upper: how often a word is written small and with a capital."""
    forms = tokens.where(F.col("form").rlike(r"^\p{L}"))
    small = F.col("form").rlike(r"^\p{Ll}")
    return forms.groupBy(F.lower("form").alias("word")).agg(F.count_if(small).alias("lower"), F.count_if(~small).alias("upper"))


def mostly_lower(counted: DataFrame) -> DataFrame:
    total = F.col("lower") + F.col("upper")
    return counted.where((total >= MIN_VOTES) & (F.col("lower") / total >= DOMINANCE)).select("word")


def position_votes(tokens: DataFrame) -> DataFrame:
    """word, mid, lower: capitals after another word of the sentence, and small spellings."""
    before = F.lag("form").over(Window.partitionBy("doc_id", "sent_idx").orderBy("pos"))
    forms = tokens.withColumn("before", before).where(F.col("form").rlike(r"^\p{L}"))
    small = F.col("form").rlike(r"^\p{Ll}")
    mid = ~small & F.coalesce(F.col("before").rlike(r"^\p{L}"), F.lit(False))
    return forms.groupBy(F.lower("form").alias("word")).agg(F.count_if(mid).alias("mid"), F.count_if(small).alias("lower"))


def false_persons(persons: DataFrame, counted: DataFrame) -> DataFrame:
    """persons: node, name (a row for each of its names). Nodes never seen as a name and often enough as a word."""
    seen = persons.where(~F.col("node").contains(" ")).select("node", F.lower("name").alias("word")).distinct().join(counted, "word", "left")
    summed = seen.groupBy("node").agg(F.coalesce(F.sum("mid"), F.lit(0)).alias("mid"), F.coalesce(F.sum("lower"), F.lit(0)).alias("lower"))
    return summed.where((F.col("mid") == 0) & (F.col("lower") >= MIN_CASE_VOTES)).select("node")


def drop_participants(facts: DataFrame, doomed: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """Facts without the doomed nodes (in the roles); those with fewer than two participants left go, equal ones add
    up. doomed: node."""
    rows = explode_participants(keyed(facts)).join(doomed.select(F.col("node"), F.lit(True).alias("doomed")).distinct(), "node", "left")
    gone = F.coalesce("doomed", F.lit(False)) & (F.col("role").isin(*roles) if roles else F.lit(True))
    left = rows.where(~gone).groupBy("fact_id", "predicate", "weight", "seq").agg(F.array_sort(F.collect_list(F.struct("role", "node", "type"))).alias("participants"))
    return upsert(left.where(F.size("participants") >= 2))


def drop_predicates(facts: DataFrame, nominal: DataFrame, structural: Sequence[str] = ()) -> DataFrame:
    """Facts whose predicate is mostly a name or noun go, structural predicates aside. nominal: key."""
    doomed = nominal.where(~F.col("key").isin(*structural)) if structural else nominal
    return facts.join(doomed.select(F.col("key").alias("predicate")), "predicate", "left_anti")


def drop_spans(entities: DataFrame, lower: DataFrame, text: str = "text") -> DataFrame:
    """Person entities that hold a word which is mostly written small go."""
    keyed = entities.withColumn("entity__id", F.xxhash64(*entities.columns))
    bad = keyed.where("type like 'p%' or type like 'P%'").select("entity__id", F.explode(F.split(F.lower(F.col(text)), r"\s+")).alias("word")).join(lower, "word", "left_semi")
    return keyed.join(bad.select("entity__id").distinct(), "entity__id", "left_anti").drop("entity__id")


def rename_words(nodes: DataFrame, lemma: DataFrame, least_chars: int = 3) -> DataFrame:
    """node -> node, target: each word replaced by its dominant lemma. lemma: key (lower-cased form), value."""
    placed = nodes.select("node", F.posexplode(F.split("node", " ")).alias("at", "word"))
    joined = placed.join(lemma.select(F.col("key"), "value"), (F.lower("word") == F.col("key")) & (F.length("word") >= least_chars), "left")
    whole = joined.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", "word").alias("w")))).alias("parts"))
    return whole.select("node", F.array_join(F.transform("parts", lambda x: x["w"]), " ").alias("target")).where("node <> target")
