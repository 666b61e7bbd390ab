"""Facts that are taken apart and put together again meet by a short key."""

from millrace.operators import evidence, facts, identity


def test_participants_move_no_letters_of_a_digest(spark):
    part = lambda role, node, kind: (role, node, kind)
    rows = [("a" * 64, "mít", [part("obj", "b", "concept"), part("subj", "a", "person")], 2, 1), ("b" * 64, "mít", [part("obj", "c", "concept"), part("subj", "a", "person")], 3, 2)]
    held = spark.createDataFrame(rows, f"fact_id string, predicate string, participants {facts.PARTICIPANTS}, weight long, seq long")
    renamed = facts.remap(held, spark.createDataFrame([("c", "b")], "node string, target string"))
    assert [(x.predicate, len(x.participants), x.weight, x.seq, len(x.fact_id)) for x in renamed.collect()] == [("mít", 2, 5, 1, 64)]
    word, node = spark.createDataFrame([("x",)], "word string"), spark.createDataFrame([("x",)], "node string")
    for found in (renamed, identity.scrub_clauses(held, word), evidence.drop_participants(held, node)):
        assert "md5(" in found._jdf.queryExecution().optimizedPlan().toString()
