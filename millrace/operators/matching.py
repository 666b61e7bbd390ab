"""Answers over facts beyond the one-hop match: votes, types, existence, places, neighbourhoods, relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.facts import explode_participants, node_of
from millrace.runtime import settle


def identity_vote(layers: DataFrame, least: int = 2) -> DataFrame:
    """layers: node, value, layer. Values of a node that at least `least` layers support."""
    return layers.groupBy("node", "value").agg(F.count_distinct("layer").alias("layers")).where(F.col("layers") >= least)


def typed_match(participants: DataFrame, role: str, identity: DataFrame) -> DataFrame:
    """Participants in a role whose node is of a kind; identity: node."""
    return participants.where(F.col("role") == role).join(identity.select("node").distinct(), "node", "left_semi")


def existence_latest(evidence: DataFrame, key: str) -> DataFrame:
    """evidence: key, positive (boolean), at, seq. Yes or No by the newest row of each key; no row, no answer."""
    newest = evidence.groupBy(key).agg(F.max_by("positive", F.struct("at", "seq")).alias("positive"), F.max("at").alias("since"))
    return newest.select(key, F.when(F.col("positive"), "yes").otherwise("no").alias("answer"), "since")


def keep_by_time(facts: DataFrame, day: Column, start: Column, end: Column) -> DataFrame:
    """Facts without a date stay."""
    return facts.where(day.isNull() | ((start <= day) & (day < end)))


def keep_by_place(facts: DataFrame, place: Column, inside: DataFrame) -> DataFrame:
    """Facts without a place go. inside: node."""
    held = inside.select(F.col("node").alias("inside__node")).distinct()
    return facts.join(held, place == F.col("inside__node"), "left_semi")


def containment(edges: DataFrame, depth: int = 12) -> DataFrame:
    """child, parent edges -> child, ancestor, hops for up to depth hops; a place contains itself at 0.

    The gazetteer is small beside the facts; each hop is one join of the frontier with it, and it ends when no row is
    new."""
    every = edges.select(F.col("child").alias("n")).unionByName(edges.select(F.col("parent").alias("n"))).distinct()
    closure = every.select(F.col("n").alias("child"), F.col("n").alias("ancestor"), F.lit(0).alias("hops"))
    frontier = closure
    for hop in range(1, depth + 1):
        frontier = frontier.join(edges.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(hop).alias("hops"))
        if frontier.limit(1).count() == 0:
            break
        closure = closure.unionByName(frontier)
    return closure.groupBy("child", "ancestor").agg(F.min("hops").alias("hops"))


def place_anchored(facts: DataFrame, role: str, inside: DataFrame, limit: int = 5) -> DataFrame:
    """Values of a role among the facts in an area, by their heaviest fact."""
    found = keep_by_place(facts, node_of(F.col("participants"), "loc"), inside)
    values = explode_participants(found).where(F.col("role") == role)
    return values.groupBy("node").agg(F.max("weight").alias("weight"), F.min("seq").alias("seq")).orderBy(F.desc("weight"), "seq", "node").limit(limit)


def event_neighbourhood(participants: DataFrame, start: str, depth: int = 2, damping: float = 0.4, skip: Sequence[str] = ("být", "druh", "kontext")) -> DataFrame:
    """fact_id, dist, score: facts within depth steps over persons; near ones first, then weight * damping ^ dist."""
    usable = participants.where(~F.col("predicate").isin(*skip)).select("fact_id", "node", "type", "weight")
    usable = settle(usable, "neighbourhood-parts")  # each step reads them, and they may be dear to make
    # what is reached is written too, so that its size is known: a small step is sent to the participants, and none of them moves
    reached = settle(usable.sparkSession.createDataFrame([(start, 0)], "node string, dist int"), "neighbourhood-nodes")
    found = None
    for dist in range(depth + 1):
        frontier = reached.where(F.col("dist") == dist)
        facts = usable.join(frontier.select("node"), "node", "left_semi").select("fact_id", "weight").distinct()
        facts = settle(facts, "neighbourhood-facts").withColumn("dist", F.lit(dist))
        found = facts if found is None else found.unionByName(facts)
        if dist < depth:
            near = usable.where("type = 'person'").join(facts.select("fact_id"), "fact_id", "left_semi").select("node").distinct()
            fresh = settle(near.join(reached.select("node").distinct(), "node", "left_anti").withColumn("dist", F.lit(dist + 1)), "neighbourhood-nodes")
            reached = reached.unionByName(fresh)
    nearest = found.groupBy("fact_id", "weight").agg(F.min("dist").alias("dist"))
    return nearest.select("fact_id", "dist", (F.col("weight") * F.pow(F.lit(damping), F.col("dist"))).alias("score"))


def shared_facts(facts: DataFrame, a: str, b: str, structural: Sequence[str] = ("kontext", "být", "druh"), limit: int = 3) -> DataFrame:
    """Facts that hold both nodes: what happened before what they are; mirrored ones once; the heaviest first."""
    held = F.transform("participants", lambda p: p["node"])
    found = facts.where(F.array_contains(held, a) & F.array_contains(held, b)).withColumn("nodes", F.array_sort(F.array_distinct(held)))
    found = found.withColumn("structural", F.col("predicate").isin(*structural))
    least = found.agg(F.min("structural").alias("least"))
    once = found.join(F.broadcast(least), F.col("structural") == F.col("least")).groupBy("predicate", "nodes").agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"))
    return once.orderBy(F.desc("weight"), "seq").limit(limit)


def class_values(facts: DataFrame, classes: DataFrame, key: str, value: str, limit: int = 4) -> DataFrame:
    """facts: key, predicate, value, seq. Per key and predicate of a class up to `limit` values in order."""
    held = facts.join(F.broadcast(classes.select("predicate", "class")), "predicate")
    first = held.groupBy(key, "class", "predicate", value).agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy(key, "class", "predicate").orderBy("seq", value))
    kept = first.withColumn("rank", rank).where(F.col("rank") <= limit)
    return kept.groupBy(key, "class", "predicate").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))).alias("x")).select(key, "class", "predicate", F.array_join(F.transform("x", lambda x: x["v"].cast("string")), ", ").alias("values"))


def carriers(participants: DataFrame, predicate: str, role: str = "subj", limit: int = 5) -> DataFrame:
    """Who carries a predicate most: sums of weights."""
    held = participants.where((F.col("predicate") == predicate) & (F.col("role") == role))
    return held.groupBy("node").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "node").limit(limit)


def partial_roles(participants: DataFrame, predicate: str, node: str) -> DataFrame:
    """What is known of a node's facts of a predicate: per role its values' weights."""
    mine = participants.where((F.col("predicate") == predicate) & (F.col("node") == node)).select("fact_id")
    others = participants.where(F.col("node") != node).join(mine, "fact_id", "left_semi")
    return others.groupBy("role", "node").agg(F.sum("weight").alias("weight"))


def by_temperature(values: DataFrame, temperature: float) -> DataFrame:
    """node, weight (a row per fact): the maximum per value, kept from top * (1 - temperature) on."""
    best = values.groupBy("node").agg(F.max("weight").alias("weight"))
    top = best.agg(F.max("weight").alias("top"))
    return best.crossJoin(F.broadcast(top)).where(F.col("weight") >= F.col("top") * (1 - temperature)).drop("top")


def neighbour_context(participants: DataFrame, node: str, limit: int = 10) -> DataFrame:
    """Who takes part in the facts of which a node is the subject: the heaviest of each."""
    mine = participants.where((F.col("node") == node) & (F.col("role") == "subj")).select("fact_id")
    near = participants.where(F.col("node") != node).join(mine, "fact_id", "left_semi")
    return near.groupBy("node").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "node").limit(limit)


def reverse_date(times: DataFrame, year: int | None, month: int | None, day: int | None) -> DataFrame:
    """times: at, ... The rows whose date has all the parts that are given."""
    out = times
    for part, value in (("year", year), ("month", month), ("day", day)):
        if value is not None:
            out = out.where(F.extract(F.lit(part), F.col("at")) == value)
    return out
