"""Steps around an event."""

from millrace.operators import matching


def test_a_small_step_moves_no_participants(spark):
    held = [(f"f{i}", "dát", n, kind, 1) for i in range(4) for n, kind in ((f"p{i // 2}", "person"), (f"x{i}", "concept"))]
    parts = spark.createDataFrame(held, "fact_id string, predicate string, node string, type string, weight long")
    found = matching.event_neighbourhood(parts, "x0", 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "neighbourhood-parts" not in plan
    assert sorted((r["fact_id"], r["dist"]) for r in found.collect()) == [("f0", 0), ("f1", 1)]
