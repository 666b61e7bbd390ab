"""Pairs are made within groups, not before them."""

from millrace import catalogue
from millrace.operators import facts


def test_overlap_meets_by_group_and_neighbour(spark):
    rows = [("g", a, n) for a in "xyz" for n in range(3)] + [("h", "w", n) for n in range(3)] + [("g", "v", 7)]
    prints = spark.createDataFrame(rows, "g string, node string, neighbour long")
    assert sorted(facts.overlap(prints, 3, within=["g"]).collect()) == [("x", "y", 3), ("x", "z", 3), ("y", "z", 3)]


def test_fingerprints_make_no_pairs_of_suppliers(spark, sf_dir):
    plan = catalogue.QUERIES["fingerprint_overlap"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert len(joins) == 3 and sum("s_nationkey" in x for x in joins) == sum("s_nationkey" in x and "neighbour" in x for x in joins) == 1
