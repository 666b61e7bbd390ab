"""Heat of persons over a document's sentences."""

import random

from millrace import catalogue, catalogue_annotated  # noqa: F401
from millrace.operators import extraction

WARMTH = "doc_id string, sent int, node string, amount double"


def by_hand(rows, reach=20, floor=1e-3):
    out = {}
    for doc, sent in {x[:2] for x in rows}:
        heat = {}
        for d, s, node, amount in rows:
            if d == doc and 0 < sent - s <= reach:
                heat[node] = heat.get(node, 0.0) + amount * 0.55 ** (sent - s)
        warm = sorted((-round(h, 9), n) for n, h in heat.items() if h >= floor)
        if warm:
            out[doc, sent] = warm[0][1]
    return out


def test_heat_over_the_ends_of_blocks(spark):
    random.seed(3)
    rows = [("a", s, random.choice(("Jan", "Eva", "Šimon", "Ž")), random.choice((1.0, 2.0))) for s in sorted(random.choices(range(450), k=300))] + [("b", 7, "Jan", 1.0), ("b", 8, "Eva", 1.0), ("b", 30, "Jan", 1.0)]
    found = extraction.hottest_persons(spark.createDataFrame(rows, WARMTH)).collect()
    assert len(found) > 150 and {(r["doc_id"], r["sent"]): r["subject"] for r in found} == by_hand(rows)


def test_a_mention_is_not_moved_for_each_sentence_that_it_warms(spark):
    rows = [("a", 0, "Jan", 1.0), ("a", 1, "Eva", 1.0)]
    plan = extraction.hottest_persons(spark.createDataFrame(rows, WARMTH))._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.splitlines() if "Exchange hashpartitioning" in x]) == 1 and "0.55" not in plan


def test_context_facts_move_no_tokens(spark, sf_dir):
    plan = catalogue.QUERIES["context_facts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "documents.parquet" not in plan and "0.55" not in plan
