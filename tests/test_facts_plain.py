"""Facts of the star schema are counted by plain columns, made once and opened where they lie."""

import re

from millrace import catalogue, catalogue_annotated  # noqa: F401  the second adds its queries
from millrace.operators import activation, facts
from millrace.plans import star


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_counted_before_they_are_nested(spark, sf_dir):
    made = star.facts(spark, sf_dir)
    keys = re.findall(r"Aggregate \[([^\]]*)\]", optimized(made))
    assert len(keys) == 1 and "participants" not in keys[0] and "subj#" in keys[0]
    want = facts.upsert(star.mentions(spark, sf_dir)).select(*made.columns)
    assert made.count() == want.count() and made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()


def test_a_source_bonus_needs_no_digest(spark, sf_dir):
    plan = optimized(catalogue.QUERIES["source_bonus"](spark, sf_dir))
    assert "sha2(" not in plan and plan.count("lineitem") <= 1


def test_the_cascade_makes_facts_once(spark, sf_dir):
    assert "l_orderkey" not in optimized(catalogue.QUERIES["answer_cascade"](spark, sf_dir))


def test_heat_spreads_within_facts(spark, sf_dir):
    part = lambda role, node, kind="concept": (role, node, kind)
    rows = [("1", "mít", [part("obj", "b"), part("subj", "a")], 2, 1), ("2", "mít", [part("obj", "c"), part("subj", "b")], 3, 2), ("3", "říci", [part("obj", "v", "výrok"), part("subj", "a")], 4, 3), ("4", "být", [part("obj", "a"), part("subj", "a")], 1, 4)]
    held = spark.createDataFrame(rows, f"fact_id string, predicate string, participants {facts.PARTICIPANTS}, weight long, seq long")
    want = activation.spread_facts(facts.explode_participants(held), ["a", "v"]).collect()
    assert len(want) > 2 and sorted(activation.spread_held(held, ["a", "v"]).collect()) == sorted(want)
    plan = optimized(activation.edges_within(held, spark.createDataFrame([("a",)], "node string")))
    assert "Join LeftSemi" in plan and "Join Inner" not in plan
