"""Evaluations: expected and rejected texts, expected nodes, statements by field, golds by mode, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EMPTY = "array<string>"


def texts(x: Column) -> Column:
    return F.coalesce(x, F.array().cast(EMPTY))


def holds_any(answer: Column, expect: Column, reject: Column) -> Column:
    """Whether an expected text is in the answer and no rejected one, capitals aside."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(texts(expect), lambda x: F.contains(low, F.lower(x))) & ~F.exists(texts(reject), lambda x: F.contains(low, F.lower(x)))


def holds_all(answer: Column, expect: Column, reject: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.forall(texts(expect), lambda x: F.contains(low, F.lower(x))) & ~F.exists(texts(reject), lambda x: F.contains(low, F.lower(x)))


def answer_etalon(items: DataFrame, answers: DataFrame) -> DataFrame:
    """item, status: pass or fail, gap-fixed or gap for items with a gap. items: item, expect, reject, gap; answers: item,
    answer."""
    ok = holds_any(F.col("answer"), F.col("expect"), F.col("reject"))
    status = F.when(F.col("gap").isNull(), F.when(ok, "pass").otherwise("fail")).otherwise(F.when(ok, "gap-fixed").otherwise("gap"))
    return items.join(answers, "item", "left").select("item", status.alias("status"))


def scores(judged: DataFrame) -> DataFrame:
    """status, n."""
    return judged.groupBy("status").agg(F.count("*").alias("n"))


def focus_etalon(items: DataFrame, field: DataFrame) -> DataFrame:
    """item, missing, status: whether the expected nodes are among the k hottest. items: item, expect_nodes, k; field: item,
    node, heat."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("heat"), "node"))
    top = field.withColumn("rank", rank).join(items.select("item", "k"), "item").where("rank <= k").groupBy("item").agg(F.collect_set("node").alias("nodes"))
    missing = F.array_sort(F.array_except("expect_nodes", texts(F.col("nodes"))))
    return items.join(top, "item", "left").select("item", missing.alias("missing")).withColumn("status", F.when(F.size("missing") == 0, "pass").otherwise("fail"))


def dialog_etalon(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """scenario, turns, failed, status: a scenario passes if all of its turns do: all expected texts, no rejected one, and the
    kind where one is expected. turns: scenario, turn, expect, reject, kind, gap; answers: scenario, turn, answer, got."""
    ok = holds_all(F.col("answer"), F.col("expect"), F.col("reject")) & (F.col("kind").isNull() | F.coalesce(F.col("kind") == F.col("got"), F.lit(False)))
    judged = turns.join(answers, ["scenario", "turn"], "left").withColumn("ok", ok)
    by = judged.groupBy("scenario").agg(F.count("*").alias("turns"), F.count_if(~F.col("ok")).alias("failed"), F.max("gap").alias("gap"))
    passed = F.col("failed") == 0
    status = F.when(F.col("gap").isNull(), F.when(passed, "pass").otherwise("fail")).otherwise(F.when(passed, "gap-fixed").otherwise("gap"))
    return by.select("scenario", "turns", "failed", status.alias("status"))


def write_etalon(items: DataFrame, parsed: DataFrame, fields: Sequence[str] = ("kind", "predicate", "subject", "time"), lists: Sequence[str] = ("objects", "places")) -> DataFrame:
    """item, wrong (names of fields that differ), status: only fields that an item names are held against the statement."""
    joined = items.alias("want").join(parsed.alias("got"), "item", "left")
    faults = [F.when(F.col(f"want.{x}").isNotNull() & ~F.col(f"want.{x}").eqNullSafe(F.col(f"got.{x}")), F.lit(x)) for x in fields]
    faults += [F.when(F.col(f"want.{x}").isNotNull() & (F.size(F.array_except(F.col(f"want.{x}"), texts(F.col(f"got.{x}")))) > 0), F.lit(x)) for x in lists]
    return joined.select("item", F.array_compact(F.array(*faults)).alias("wrong")).withColumn("status", F.when(F.size("wrong") == 0, "pass").otherwise("fail"))


def shadow_parity(live: DataFrame, shadow: DataFrame) -> DataFrame:
    """plane, turns, agreed: how often two dispatchers choose alike. live, shadow: plane, turn, choice."""
    both = live.join(shadow.withColumnRenamed("choice", "other"), ["plane", "turn"], "left")
    return both.groupBy("plane").agg(F.count("*").alias("turns"), F.count_if(F.col("choice").eqNullSafe(F.col("other"))).alias("agreed"))


def gold_verdicts(items: DataFrame, answers: DataFrame) -> DataFrame:
    """item, verdict: hit, wrong, clarify (a question back), or none. items: item, expect, mode (any or all); answers: item,
    answer, asked (boolean)."""
    hit = F.when(F.col("mode") == "all", holds_all(F.col("answer"), F.col("expect"), F.lit(None).cast(EMPTY))).otherwise(holds_any(F.col("answer"), F.col("expect"), F.lit(None).cast(EMPTY)))
    verdict = F.when(F.col("answer").isNull() & ~F.coalesce("asked", F.lit(False)), "none").when(F.coalesce("asked", F.lit(False)), "clarify").when(hit, "hit").otherwise("wrong")
    return items.join(answers, "item", "left").select("item", verdict.alias("verdict"))


def stage_ceiling(stages: DataFrame, order: Sequence[str]) -> DataFrame:
    """stage, place, reached, share: how many items still have their right answer after each stage. stages: item, stage,
    present (boolean); an item that a stage lost counts as lost from there on."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(order):
        place = F.when(F.col("stage") == name, i).otherwise(place)
    placed = stages.withColumn("place", place).where("place IS NOT NULL")
    so_far = F.min(F.col("present").cast("int")).over(Window.partitionBy("item").orderBy("place"))
    return placed.withColumn("held", so_far).groupBy("stage", "place").agg(F.sum("held").alias("reached"), F.avg("held").alias("share"))


def coverage(documents: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """key, n, covered: how many rows of each group have a hit. documents: doc_id, key; hits: doc_id."""
    seen = hits.select("doc_id").distinct().withColumn("seen", F.lit(1))
    return documents.join(seen, "doc_id", "left").groupBy(key).agg(F.count("*").alias("n"), F.count("seen").alias("covered"))
