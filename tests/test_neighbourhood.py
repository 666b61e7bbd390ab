"""Facts around an event."""

from millrace.operators import matching


def test_steps_read_participants_that_are_made_once(spark):
    made = spark.range(2).selectExpr("explode(array(named_struct('f', 2 * id, 'n', 'p'), named_struct('f', 2 * id, 'n', concat('x', id)), named_struct('f', 2 * id + 1, 'n', concat('y', id)))) AS x")
    parts = made.selectExpr("x.f AS fact_id", "'dát' AS predicate", "x.n AS node", "IF(x.n = 'p', 'person', 'concept') AS type", "10L AS weight")
    found = matching.event_neighbourhood(parts, "x0", 1)
    assert "Range" not in found._jdf.queryExecution().toString()
    assert sorted((r["fact_id"], r["dist"], r["score"]) for r in found.collect()) == [(0, 0, 10.0), (2, 1, 4.0)]
