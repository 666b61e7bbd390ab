"""Turns as a stream: clarify and resume across a restart, tasks that fire by the watermark."""

import datetime

import pytest
from millrace.streaming import turns

LINE = "conv_id string, at timestamp, text string, answer string, quality double, node string, rivals array<string>, task string, due timestamp"
T0 = datetime.datetime(2024, 1, 1, 12)


def line(conv, minute, text, answer=None, quality=None, node=None, rivals=None, task=None, due=None):
    at = lambda m: None if m is None else T0 + datetime.timedelta(minutes=m)
    return (conv, at(minute), text, answer, quality, node, rivals, task, at(due))


@pytest.fixture
def run(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    turns.stateful(spark)

    def batch(*lines):
        """A query of its own for each batch, from the same checkpoint."""
        spark.createDataFrame(list(lines), LINE).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = turns.turns(turns.prepared(spark.readStream.schema(LINE).json(f"{tmp_path}/in")))
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
        return sorted((r["conv_id"], r["kind"], r["text"], r["node"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    yield batch
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_turns(run):
    first = run(
        line("a", 0, "Kdo je Čapek?", "spisovatel", 0.8, "Karel Čapek", ["Josef Čapek"]),
        line("b", 0, "Připomeň mi léky", task="léky"),
        line("c", 0, "Kde je Praha?", "v Čechách", 0.9, "Praha", []),
        line("c", 1, "Kdo je nikdo?", None, 0.0),
        line("d", 0, "Připomeň mi schůzku", task="schůzka", due=30),
        line(None, 0, "x"),
    )
    assert first == [("a", "clarify", "Karel Čapek, Josef Čapek", "Karel Čapek"), ("b", "when", "léky", None), ("c", "answer", "v Čechách", "Praha"), ("c", "miss", "Kdo je nikdo?", None), ("d", "set", "schůzka", None)]
    # after a restart: the choice resumes the question, the time finds its task, another conversation's lines let time pass
    second = run(line("a", 2, "Josef"), line("b", 2, "v půl jedné", due=20), line("d", 2, "Přesuň schůzku", task="schůzka", due=25))
    assert [x for x in second if x not in first] == [("a", "resume", "Kdo je Čapek?", "Josef Čapek"), ("b", "set", "léky", None)]
    third = run(line("c", 40, "Dobře."), line("a", 3, "Kdo je Čapek?", "malíř", 0.8, "Josef Čapek", ["Karel Čapek"]))
    fresh = [x for x in third if x not in second]
    assert ("a", "answer", "malíř", "Josef Čapek") in fresh  # warm by the choice, so it is sure now
    fourth = run(line("c", 41, "Ano."))
    due = [x for x in fourth if x[1] == "due"]
    assert due == [("b", "due", "léky", None), ("d", "due", "schůzka", None)]
