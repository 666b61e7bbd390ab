"""Activation: warmth that fades with each step, and spreads over the graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.runtime import settle


def fold(amounts: Column, decay: float, floor: float) -> Column:
    """The warmth after all steps: amounts has what each step adds, in order; after each the rest fades, and what falls
    to the floor is forgotten."""

    def step(acc: Column, x: Column) -> Column:
        faded = (acc + x) * decay
        return F.when(faded > floor, faded).otherwise(F.lit(0.0))

    return F.aggregate(amounts, F.lit(0.0), step)


def decayed(events: DataFrame, group: str, key: str, step: str, amount: str, decay: float = 0.55, floor: float = 1e-3) -> DataFrame:
    """(group, key, score) after each group's last step, which fades like all others; exact, floor included.

    Only steps that warm a key are kept, with the number of steps to the next one: the fold runs over warmings, not over
    all steps of the group."""
    summed = events.groupBy(group, key, step).agg(F.sum(amount).alias("amount"))
    last = events.groupBy(group).agg(F.max(step).alias("last"))
    nexts = F.lead(step).over(Window.partitionBy(group, key).orderBy(step))
    gaps = summed.withColumn("next", nexts).join(last, group).withColumn("gap", F.coalesce(F.col("next"), F.col("last") + 1) - F.col(step))
    listed = gaps.groupBy(group, key).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("at"), F.col("amount"), F.col("gap")))).alias("steps"))

    def run(acc: Column, x: Column) -> Column:
        faded = (acc + x["amount"]) * F.pow(F.lit(decay), x["gap"])
        return F.when(faded > floor, faded).otherwise(F.lit(0.0))

    return listed.select(group, key, F.aggregate("steps", F.lit(0.0), run).alias("score")).where("score > 0")


def ranked(field: DataFrame, group: str, key: str, limit: int = 12) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), F.col(key).cast("string")))
    return field.withColumn("rank", rank).where(F.col("rank") <= limit)


def edges_of(participants: DataFrame, speech: str = "výrok") -> DataFrame:
    """node, near, weight: who shares a fact with whom, by the heaviest one."""
    near = participants.where(F.col("type") != speech).select("fact_id", F.col("node").alias("near"))
    return participants.select("fact_id", "node", "weight").join(near, "fact_id").where("node <> near").groupBy("node", "near").agg(F.max("weight").alias("weight"))


def edges_near(participants: DataFrame, frontier: DataFrame, speech: str = "výrok") -> DataFrame:
    """The edges of edges_of that leave the frontier's nodes: only their facts are opened."""
    held = participants.join(frontier.select("node"), "node").select("fact_id", "node", "weight")
    near = participants.where(F.col("type") != speech).select("fact_id", F.col("node").alias("near"))
    return held.join(near, "fact_id").where("node <> near").groupBy("node", "near").agg(F.max("weight").alias("weight"))


def spread(edges: DataFrame, sources: Sequence[str], base: float = 0.6, falloff: float = 0.35, depth: int = 2, fanout: int = 8) -> DataFrame:
    """node, heat: warmth from the sources over their heaviest edges; visited nodes get warmth but pass none on."""
    return spread_by(lambda frontier: edges.join(frontier.select("node"), "node"), edges.sparkSession, sources, base, falloff, depth, fanout)


def spread_facts(participants: DataFrame, sources: Sequence[str], base: float = 0.6, falloff: float = 0.35, depth: int = 2, fanout: int = 8) -> DataFrame:
    """The same over the facts themselves: each hop opens the facts of the nodes that it has reached, and no others."""
    return spread_by(lambda frontier: edges_near(participants, frontier), participants.sparkSession, sources, base, falloff, depth, fanout)


def edges_within(facts: DataFrame, frontier: DataFrame, speech: str = "výrok") -> DataFrame:
    """The edges of edges_near, of facts that hold their participants: each opens them by itself, and none meets another."""
    held = facts.select("participants", "weight", F.explode(F.array_distinct(F.transform("participants", lambda p: p["node"]))).alias("node"))
    held = held.join(F.broadcast(frontier.select("node")), "node", "left_semi")
    near = F.explode(F.filter("participants", lambda p: (p["type"] != speech) & (p["node"] != F.col("node")))).alias("p")
    return held.select("node", "weight", near).groupBy("node", F.col("p.node").alias("near")).agg(F.max("weight").alias("weight"))


def spread_held(facts: DataFrame, sources: Sequence[str], base: float = 0.6, falloff: float = 0.35, depth: int = 2, fanout: int = 8) -> DataFrame:
    """spread_facts over facts that hold their participants; what a hop reaches, at most fanout nodes for each before, is broadcast."""
    return spread_by(lambda frontier: edges_within(facts, frontier), facts.sparkSession, sources, base, falloff, depth, fanout)


def spread_by(edges_from: Callable[[DataFrame], DataFrame], spark: SparkSession, sources: Sequence[str], base: float, falloff: float, depth: int, fanout: int) -> DataFrame:
    """A hop's heat is settled, so that the next starts from a table of at most fanout rows per node that was reached."""
    frontier = spark.createDataFrame([(x, base) for x in sources], "node string, energy double")
    visited, heat = frontier.select("node"), None
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "near"))
    for _ in range(depth):
        top = edges_from(frontier).withColumn("rank", best).where(F.col("rank") <= fanout).join(frontier, "node")
        given = top.select("near", (F.col("energy") * falloff).alias("give"))
        part = settle(given.groupBy(F.col("near").alias("node")).agg(F.sum("give").alias("heat"), F.max("give").alias("most")), "heat")
        heat = part.select("node", "heat") if heat is None else heat.unionByName(part.select("node", "heat"))
        frontier = part.join(visited, "node", "left_anti").select("node", F.col("most").alias("energy"))
        visited = visited.unionByName(frontier.select("node")).distinct()
    return heat.groupBy("node").agg(F.sum("heat").alias("heat"))


def conductance(tokens: DataFrame, idf: DataFrame, window: int = 5, tau: float = 2.0) -> DataFrame:
    """a, b, weight: words at most window places apart in a sentence, by idf * idf * exp(-(distance - 1) / tau); both
    ways. tokens: sent (key of a sentence), pos, word."""
    weighted = tokens.join(idf.select("word", "idf"), "word").select("sent", "pos", "word", "idf")
    ahead = Window.partitionBy("sent").orderBy("pos")
    pairs = None
    for d in range(1, window + 1):
        part = weighted.select(F.col("word").alias("a"), F.lead("word", d).over(ahead).alias("b"), (F.col("idf") * F.lead("idf", d).over(ahead) * F.exp(F.lit(-(d - 1) / tau))).alias("w")).where("b is not null")
        pairs = part if pairs is None else pairs.unionByName(part)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("weight"))


def flow(heat: DataFrame, edges: DataFrame, hops: int = 2, share: float = 0.5) -> DataFrame:
    """node, heat after hops in which each node gives share of its warmth to its neighbours in proportion to the edges.
    edges: a, b, weight."""
    total = edges.groupBy("a").agg(F.sum("weight").alias("total"))
    normal = edges.join(total, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("part"))
    for _ in range(hops):
        given = heat.join(normal, heat.node == normal.a).select(F.col("b").alias("node"), (F.col("heat") * share * F.col("part")).alias("heat"))
        heat = heat.unionByName(given).groupBy("node").agg(F.sum("heat").alias("heat"))
    return heat


def interval_warmth(times: DataFrame, intervals: DataFrame, amount: float = 0.5) -> DataFrame:
    """turn, node, amount: what a turn's interval adds to every node of time that overlaps it. times: node, lo, hi; intervals:
    turn, start, end (half open). A turn has one interval; the few of a batch are broadcast up to Spark's own limit."""
    hit = times.join(intervals, (F.col("lo") < F.col("end")) & (F.col("start") < F.col("hi")))
    return hit.select("turn", "node", F.lit(amount).alias("amount"))


def turn_memory(turns: DataFrame, value: float = 2.0, topic: float = 1.0, other: float = 2.0) -> DataFrame:
    """conv, turn, node, amount: what a turn warms: the value and the topic of an answer to who or what, else the topic alone.
    turns: conv, turn, kind (who, what or other), topic, value."""
    asks = F.col("kind").isin("who", "what")
    pairs = F.array(F.struct(F.when(asks, F.col("value")).alias("node"), F.lit(value).alias("amount")), F.struct(F.col("topic").alias("node"), F.when(asks, topic).otherwise(other).alias("amount")))
    return turns.select("conv", "turn", F.explode(pairs).alias("p")).select("conv", "turn", "p.node", "p.amount").where("node IS NOT NULL")
