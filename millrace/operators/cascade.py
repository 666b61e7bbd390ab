"""The answer cascade over many questions at once: tiers of evidence, the first with values holds.

asked: question, predicate, known (array of nodes), hole (a role), date_part, and hints. Tables of facts are
`participants` (fact_id, predicate, role, node, type, weight, seq). Facts that hold all known nodes of a question are found
by one join on nodes and a count, so the work follows the facts of the known nodes, not the graph.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fixed


def facts_holding(asked: DataFrame, participants: DataFrame) -> DataFrame:
    """question, fact_id: the facts in which all known nodes of a question take part."""
    wanted = asked.select("question", F.explode(F.array_distinct("known")).alias("node"))
    need = asked.select("question", F.size(F.array_distinct("known")).alias("need"))
    held = wanted.join(participants.select("fact_id", "node").distinct(), "node").groupBy("question", "fact_id").agg(F.count("*").alias("n"))
    return held.join(need, "question").where("n = need").select("question", "fact_id")


def hole_values(asked: DataFrame, participants: DataFrame, holding: DataFrame, predicate: Column, hole: Column, tier: int) -> DataFrame:
    """question, tier, value, weight, seq: what fills the hole in facts of a predicate that hold the known nodes."""
    wanted = asked.select("question", "known", predicate.alias("predicate"), hole.alias("role")).where("predicate IS NOT NULL")
    found = holding.join(wanted, "question").join(participants, ["fact_id", "predicate", "role"]).where(~F.array_contains("known", F.col("node")))
    return found.groupBy("question", F.col("node").alias("value")).agg(F.sum("weight").alias("weight"), F.min("seq").alias("seq")).withColumn("tier", F.lit(tier))


def numeric_situation(asked: DataFrame, participants: DataFrame, holding: DataFrame, tier: int) -> DataFrame:
    """question, tier, value, weight, seq: the number in the first fact, whatever its predicate, that holds at least two
    known nodes of a question that asks how many."""
    counts = asked.where("hole = 'num' AND size(array_distinct(known)) > 1").select("question")
    nums = participants.where("role = 'num'").select("fact_id", F.col("node").alias("value"), "weight", "seq")
    rows = holding.join(counts, "question", "left_semi").join(nums, "fact_id")
    first = F.rank().over(Window.partitionBy("question").orderBy("seq", "fact_id"))
    return rows.withColumn("rank", first).where("rank = 1").select("question", "value", "weight", "seq").withColumn("tier", F.lit(tier))


def date_drill(asked: DataFrame, participants: DataFrame, holding: DataFrame, tier: int) -> DataFrame:
    """question, tier, value, weight, seq: a part of the date at which something happened, by way of the date's own fact."""
    parts = asked.where("date_part IS NOT NULL")
    dates = hole_values(parts, participants, holding, F.col("predicate"), F.lit("time"), tier)
    best = dates.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("weight"), "seq", "value"))).where("rank = 1")
    subjects = participants.where("role = 'subj'").select("fact_id", "predicate", F.col("node").alias("date"))
    values = subjects.join(participants.where("role = 'val'").select("fact_id", F.col("node").alias("value"), "weight", "seq"), "fact_id")
    wanted = best.select("question", F.col("value").alias("date")).join(parts.select("question", F.col("date_part").alias("predicate")), "question")
    return wanted.join(values, ["date", "predicate"]).select("question", "value", "weight", "seq").withColumn("tier", F.lit(tier))


def context_values(asked: DataFrame, participants: DataFrame, holding: DataFrame, roles: DataFrame, tier: int, hub_limit: int = 50, association: str = fixed.ASSOCIATION) -> DataFrame:
    """Associations of the known nodes, where they may answer: the predicate is unknown, or carries the role and the topic has
    at most hub_limit of them."""
    open_ = asked.where("hole IN ('subj', 'obj')")
    known = roles.select("predicate", F.col("roles").alias("carried"))
    verdict = open_.join(known, "predicate", "left").select("question", F.array_contains("carried", F.col("hole")).alias("lit"), F.array_min("known").alias("topic"))
    own = participants.where(F.col("predicate") == association)
    fan = own.select("fact_id", F.col("node").alias("topic")).join(own.select("fact_id", "node"), "fact_id").where("topic <> node").groupBy("topic").agg(F.count("*").alias("fan"))
    allowed = verdict.join(fan, "topic", "left").where((F.col("lit").isNull()) | (F.col("lit") & (F.coalesce("fan", F.lit(0)) <= hub_limit))).select("question")
    return hole_values(open_.join(allowed, "question", "left_semi"), participants, holding, F.lit(association), F.col("hole"), tier)


def answer(asked: DataFrame, participants: DataFrame, roles: DataFrame, weaker: Sequence[str] = ("druh", fixed.NAMING), hub_limit: int = 50, limit: int = 5) -> DataFrame:
    """question, tier, value, rank: the values of the first tier that has any, heaviest first.

    Tiers: 0 parts of dates, 1 the predicate itself, 2 and on weaker identities, then numbers of situations, then
    associations. All tiers are one plan; which holds is a minimum, so questions never wait for one another."""
    holding = facts_holding(asked, participants)
    plain = asked.where("date_part IS NULL")
    tiers = [date_drill(asked, participants, holding, 0), hole_values(plain, participants, holding, F.col("predicate"), F.col("hole"), 1)]
    identity = plain.where("hole IN ('pred', 'attr')")
    tiers += [hole_values(identity, participants, holding, F.lit(name), F.col("hole"), 2 + i) for i, name in enumerate(weaker)]
    after = 2 + len(weaker)
    tiers.append(numeric_situation(plain, participants, holding, after))
    tiers.append(context_values(plain, participants, holding, roles, after + 1, hub_limit))
    every = tiers[0]
    for part in tiers[1:]:
        every = every.unionByName(part)
    ranked = every.withColumn("least", F.min("tier").over(Window.partitionBy("question"))).where("tier = least")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("weight"), "seq", "value"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= limit).select("question", "tier", "value", "rank")


def fill_subjects(asked: DataFrame, heat: DataFrame, copula: str = "být") -> DataFrame:
    """asked with `filled`: the hottest person of the conversation that agrees in gender, where a question has no subject and
    doesn't ask for one. asked: question, conv, predicate, hole, roles (of its known nodes), gender; heat: conv, node,
    gender, heat."""
    needs = asked.where((F.col("hole") != "subj") & (F.col("predicate") != copula) & ~F.array_contains("roles", "subj"))
    people = heat.withColumnRenamed("gender", "own")
    fit = needs.join(people, "conv").where("gender IS NULL OR gender = own")
    best = fit.groupBy("question").agg(F.max_by("node", F.struct("heat", "node")).alias("filled"))
    return asked.join(best, "question", "left")


def novel(values: DataFrame, said: DataFrame) -> DataFrame:
    """question, value rows without those that the conversation was told before (question, value)."""
    return values.join(said.select("question", "value").distinct(), ["question", "value"], "left_anti")


def source_bonus(provenance: DataFrame, doc_heat: DataFrame, factor: float = 2.0, by: Sequence[str] = ("fact_id",)) -> DataFrame:
    """fact_id (or what else tells facts apart), bonus: factor times the heat of all documents that a fact comes from."""
    return provenance.join(doc_heat, provenance["source"] == doc_heat["doc"]).groupBy(*by).agg((factor * F.sum("heat")).alias("bonus"))


def warm_sources(used: DataFrame, links: DataFrame, amount: float = 3.0, falloff: float = 0.35, fanout: int = 8) -> DataFrame:
    """doc, heat: documents of used facts get amount for each, and the heaviest linked documents a part of it.

    used: doc; links: a, b, weight."""
    direct = used.groupBy("doc").agg((F.count("*") * amount).alias("heat"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("weight"), "b"))
    top = links.withColumn("rank", rank).where(F.col("rank") <= fanout)
    passed = used.join(top, used["doc"] == top["a"]).groupBy(F.col("b").alias("doc")).agg((F.count("*") * amount * falloff).alias("heat"))
    return direct.unionByName(passed).groupBy("doc").agg(F.sum("heat").alias("heat"))
