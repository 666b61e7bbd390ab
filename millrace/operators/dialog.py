"""Choices of a dialog as joins: cards by how tightly they fit, assurance, triage of misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

CARD = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("requires", T.ArrayType(T.StringType())),
        T.StructField("forbids", T.ArrayType(T.StringType())),
        T.StructField("assurance_below", T.DoubleType()),
        T.StructField("min_candidates", T.IntegerType()),
    ]
)


def assurance(quality: Column, rivals: Column, heat: Column) -> Column:
    """quality / (1 + rivals) + 0.3 * heat, each within 0 and 1."""
    warm = F.least(F.greatest(heat, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(quality / (rivals + 1) + 0.3 * warm, F.lit(0.0)), F.lit(1.0))


def lint(cards: DataFrame, events: list[str]) -> DataFrame:
    """Cards with an unknown event or without a name."""
    return cards.where(~F.col("event").isin(*events) | F.col("name").isNull() | (F.col("name") == ""))


def best_card(cards: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """turns: key, event, features, assurance, candidates. The card that fits each turn most tightly, then by priority,
    then by name. A deck is small and written by hand; it is broadcast up to Spark's own size limit."""
    fits = (
        (F.size(F.array_except(F.coalesce("requires", F.array().cast("array<string>")), "features")) == 0)
        & ~F.arrays_overlap(F.coalesce("forbids", F.array().cast("array<string>")), "features")
        & (F.col("assurance_below").isNull() | (F.col("assurance") < F.col("assurance_below")))
        & (F.col("min_candidates").isNull() | (F.col("candidates") >= F.col("min_candidates")))
    )
    tight = (
        F.greatest(F.size("requires"), F.lit(0)) + F.greatest(F.size("forbids"), F.lit(0)) + F.col("assurance_below").isNotNull().cast("int") + F.col("min_candidates").isNotNull().cast("int")
    )
    scored = turns.join(cards, "event").where(fits).withColumn("specificity", tight)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("specificity"), F.desc("priority"), "name"))
    return scored.withColumn("rank", rank).where("rank = 1").select(key, "name", "specificity")


def is_miss(kind: Column, sure: Column, threshold: float = 0.5) -> Column:
    return (kind != "answer") | (F.coalesce(sure, F.lit(1.0)) < threshold)


def triage(rows: DataFrame, threshold: float = 0.5, examples: int = 3) -> DataFrame:
    """Misses by kind and cards, most first; each with a few first examples. rows: seq, kind, patterns, assurance, q."""
    missed = rows.where(is_miss(F.col("kind"), F.col("assurance"), threshold))
    rank = F.row_number().over(Window.partitionBy("kind", "patterns").orderBy("seq"))
    first = missed.withColumn("rank", rank).where(F.col("rank") <= examples).groupBy("kind", "patterns").agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("x"))
    counts = missed.groupBy("kind", "patterns").agg(F.count("*").alias("count"))
    return counts.join(first, ["kind", "patterns"]).select("kind", "patterns", "count", F.transform("x", lambda x: x["q"]).alias("examples"))


def card_gain(used: DataFrame) -> DataFrame:
    return used.groupBy("name").agg(F.count("*").alias("used"), F.round(F.sum("gain"), 4).alias("gain"))


def role_offer(fact: DataFrame, asked: DataFrame, told: DataFrame) -> DataFrame:
    """Roles of the answering fact that were neither asked for nor told."""
    return fact.select("role", "node").join(asked.select("role"), "role", "left_anti").join(told.select("node"), "node", "left_anti")


CLARIFY = ("query.ambiguous", "data.overflow", "statement.identity")


def dispatch_nodes(cards: DataFrame, telemetry: DataFrame, claims: DataFrame) -> DataFrame:
    """name, kind, worker, priority, weight: cards as nodes by the event that they wait for, and the experts that claim a
    line; weight: how often telemetry names a card. cards: name, event, priority; telemetry: patterns; claims: name, worker,
    priority."""
    event = F.col("event")
    kind = F.when(event == "utterance.query", "otazka").when(event == "utterance.statement", "vyrok").when(event == "utterance.command", "prikaz").when(event.isin(*CLARIFY), "clarify")
    worker = F.when(event == "utterance.query", "graf").when(event == "utterance.statement", "brana-e").when(event == "utterance.command", "iris").otherwise("dialog")
    rows = cards.select("name", kind.alias("kind"), worker.alias("worker"), "priority").where("kind IS NOT NULL")
    every = rows.unionByName(claims.select("name", F.lit("worker").alias("kind"), "worker", "priority"))
    used = telemetry.select(F.explode("patterns").alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("weight"))
    return every.join(used, "name", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def dispatch_edges(cards: DataFrame) -> DataFrame:
    """source, kind, target: from questions to the cards that ask back (about an overflow only where the question has a hole),
    from statements to those about statements, and from each of these back. cards: name, event, has_hole.

    Cards meet by the family of event that they belong to; a deck is written by hand."""
    about = F.when(F.col("event").startswith("statement."), "vyrok").otherwise("otazka")
    asks = cards.where(F.col("event").isin(*CLARIFY)).select(F.col("name").alias("target"), F.col("event").alias("asked"), about.alias("family"))
    family = F.when(F.col("event") == "utterance.query", "otazka").when(F.col("event") == "utterance.statement", "vyrok")
    from_ = cards.select(F.col("name").alias("source"), family.alias("family"), "has_hole").where("family IS NOT NULL")
    sharpen = from_.join(asks, "family").where("asked <> 'data.overflow' OR has_hole").select("source", F.lit("zpresneni").alias("kind"), "target")
    return sharpen.unionByName(asks.select(F.col("target").alias("source"), F.lit("navrat").alias("kind"), F.lit("*").alias("target")))


def illuminate(lit: DataFrame, use_weights: bool = False) -> DataFrame:
    """turn, name, place: the nodes that a turn lights, strongest first: experts before cards, then by priority, by the length
    of the pattern with the tightness of the trigger, and (if asked for) by weight; the later one in order of equal ones.

    lit: turn, name, kind, priority, length, weight."""
    tier = F.when(F.col("kind") == "worker", 3).otherwise(2)
    weight = F.col("weight") if use_weights else F.lit(0.0)
    rank = F.row_number().over(Window.partitionBy("turn").orderBy(tier.desc(), F.desc("priority"), F.desc("length"), weight.desc(), "name"))
    return lit.select("turn", "name", rank.alias("place"))


def claims_of(turns: DataFrame, key: str, recognisers: dict[str, tuple[int, Column]]) -> DataFrame:
    """key, name, priority: the expert that claims a turn, the one of highest priority. recognisers: name -> (priority, test over
    the turn's columns)."""
    claims = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("name"))) for name, (priority, test) in recognisers.items())))
    best = F.try_element_at(F.array_sort(claims, lambda a, b: F.when(a["priority"] != b["priority"], b["priority"] - a["priority"]).when(a["name"] < b["name"], -1).otherwise(1)), F.lit(1))
    return turns.select(key, best.alias("c")).where("c IS NOT NULL").select(key, "c.name", "c.priority")


def decorations(turns: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """key, decorations: the names of the constraints that a turn carries, sorted. tests: name -> test over its columns."""
    held = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in sorted(tests.items()))))
    return turns.select(key, held.alias("decorations"))


def positions(turns: DataFrame, edges: DataFrame, key: str = "conv") -> DataFrame:
    """key, turn, node, move: where a dialog stands: `sharpen` along an edge from the node before, `resume` back from a card that
    asked, else `enter`. turns: key, turn, node; edges: source, kind, target."""
    before = F.lag("node").over(Window.partitionBy(key).orderBy("turn"))
    rows = turns.withColumn("source", before)
    along = edges.where("kind = 'zpresneni'").select("source", F.col("target").alias("node"), F.lit(True).alias("sharp")).distinct()
    asked = edges.where("kind = 'navrat'").select("source", F.lit(True).alias("back")).distinct()
    joined = rows.join(along, ["source", "node"], "left").join(asked, "source", "left")
    move = F.when(F.col("sharp"), "sharpen").when(F.col("back"), "resume").otherwise("enter")
    return joined.select(key, "turn", "node", move.alias("move"))


def picked(answers: DataFrame, offered: DataFrame) -> DataFrame:
    """turn, value: what an answer picks of the values that were offered: by its number, else the only one that begins with it or
    has it as a word. answers: turn, text; offered: turn, place (from 1), value."""
    low = F.lower(F.btrim("text"))
    rows = answers.select("turn", low.alias("low")).join(offered, "turn").withColumn("n", F.when(F.col("low").rlike("^[0-9]{1,4}$"), F.col("low").try_cast("int")))
    named = F.lower("value").startswith(F.col("low")) | F.array_contains(F.split(F.lower("value"), r"\s+"), F.col("low"))
    hits = rows.where(F.when(F.col("n").isNotNull(), F.col("n") == F.col("place")).otherwise(named & (F.col("low") != "")))
    return hits.groupBy("turn").agg(F.count("*").alias("hits"), F.min("value").alias("value")).where("hits = 1").select("turn", "value")
