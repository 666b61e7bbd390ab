"""Operators that SQL doesn't reach, against the plain way to compute them."""

import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import fixed, strings
from millrace.operators import activation, facts, matching, memory, retrieval
from millrace.operators import text as texts
from millrace.plans import pattern
from millrace.plans.pattern import Graph, Pattern, SubQuery
from millrace.sources import readers


def sentences(text):
    out, start, text = [], 0, text.strip()
    for m in re.finditer(r"[.!?…]\s+", text):
        word = re.search(r"[^\W_]*$", text[start : m.start()])[0]
        after = text[m.end()] if m.end() < len(text) else ""
        if word.lower() in fixed.ABBREVIATIONS or (word.isdigit() and after.islower()):
            continue
        out.append(text[start : m.start() + 1].strip())
        start = m.end()
    return [x for x in [*out, text[start:].strip()] if x]


@pytest.mark.parametrize("text", ["Přišel MUDr. Novák. Bylo to 9. ledna. Číslo 0. Konec!  Ano?", "tzv. věc je zde… A dál.", "", "   ", "Jedna. dvě. Tři", "Str. 5. A 12. B", "a.b c. d"])
def test_sentences(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(texts.sentences(F.col("text"))).first()[0]
    assert got == sentences(text)


def test_clean_text(spark):
    raw = "junk\n*** START OF THE BOOK ***\r\nProse (12. ledna 1890 – 25. 12. 1938) here.\n\n\n\n== Dílo ==\nmore   text \n== Literatura ==\nISBN\n*** END OF THE BOOK ***\ntail"
    got = spark.createDataFrame([(raw,)], "t string").select(texts.clean_text(F.col("t"))).first()[0]
    assert got == "Prose here.\n\nmore text"


def test_chunk_has_no_window_that_adds_nothing(spark):
    docs = spark.createDataFrame([(n, list("abcdefgh")[:n]) for n in range(9)], "doc_id int, u array<string>")
    got = {}
    for r in texts.chunk(docs, F.col("u"), 3, 1).orderBy("doc_id", "idx").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert got == {1: [(0, 1)], 2: [(0, 2)], 3: [(0, 3)], 4: [(0, 3), (2, 4)], 5: [(0, 3), (2, 5)], 6: [(0, 3), (2, 5), (4, 6)], 7: [(0, 3), (2, 5), (4, 7)], 8: [(0, 3), (2, 5), (4, 7), (6, 8)]}


def test_stems_and_dates(spark):
    rows = spark.createDataFrame([("Karel",), ("Karla",), ("Němcové",), ("Čapek",)], "w string").select("w", strings.stem(F.col("w")).alias("s"))
    assert dict(map(tuple, rows.collect())) == {"Karel": "karl", "Karla": "karl", "Němcové": "nemc", "Čapek": "čapk"}
    d = spark.createDataFrame([("13. ledna 1890",), ("21.1.1900",), ("roku 1890",), ("nic",)], "t string").select("t", strings.date_parts(F.col("t")).alias("p"))
    assert {r["t"]: tuple(r["p"]) for r in d.collect()} == {"13. ledna 1890": ("1890", "leden", "13"), "21.1.1900": ("1900", "leden", "21"), "roku 1890": ("1890", None, None), "nic": (None, None, None)}


def test_decay_with_floor(spark):
    events = [(1, "a", 0, 1.0), (1, "a", 3, 0.01), (1, "b", 1, 0.002), (1, "c", 9, 1.0), (1, "a", 3, 0.5)]
    scores, last = {}, 9
    for step in range(last + 1):
        for _, key, at, amount in events:
            if at == step:
                scores[key] = scores.get(key, 0.0) + amount
        scores = {k: v * 0.55 for k, v in scores.items() if v * 0.55 > 1e-3}
    got = activation.decayed(spark.createDataFrame(events, "g int, key string, step int, amount double"), "g", "key", "step", "amount").collect()
    assert {r["key"]: pytest.approx(r["score"]) for r in got} == scores


def test_distance_activation(spark):
    base = [0.0, 2.0, 0.0, 0.0, 1.0]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(base)], "doc string, i int, score double")
    got = {r["i"]: r["activation"] for r in retrieval.distance_activation(rows, "doc", "i", 1.6).collect()}
    for i in range(5):
        assert got[i] == pytest.approx(sum(x * math.exp(-abs(i - j) / 1.6) for j, x in enumerate(base)))


def small_graph(spark):
    make = lambda predicate, seq, *who: (predicate, [tuple(x) for x in who], seq, "doc")
    rows = [
        make("Write", 1, ("subj", "Ann", "person"), ("obj", "Tales", "work")), make("Write", 2, ("subj", "Ann", "person"), ("obj", "Songs", "work")),
        make("write", 3, ("subj", "Bob", "person"), ("obj", "Notes", "work")), make("born", 4, ("subj", "Ann", "person"), ("loc", "Brno", "geo"), ("time", "1890", "time")),
        make("write", 5, ("subj", "Ann", "person"), ("obj", "Tales", "work")), make("live", 6, ("subj", "Ann", "person"), ("loc", "Praha", "geo")),
    ]
    frame = spark.createDataFrame(rows, "predicate string, who array<struct<role:string,node:string,type:string>>, seq long, source string")
    return facts.upsert(facts.make_facts(frame.withColumn("a", F.col("who")[0]).withColumn("b", F.col("who")[1]).withColumn("c", F.get("who", F.lit(2))), F.col("predicate"), [F.col("a"), F.col("b"), F.coalesce("c", F.struct(F.lit("x").alias("role"), F.lit(None).cast("string").alias("node"), F.lit("x").alias("type")))], "source", "seq"))


def test_patterns(spark):
    graph = Graph(small_graph(spark), rings={"dwell": ["live"]})
    values = lambda p: [r["node"] for r in pattern.run(graph, p).collect()]
    assert graph.facts.where("weight = 2").count() == 1
    assert values(Pattern("write", (("subj", "Ann"),), "obj")) == ["Tales"]
    assert values(Pattern("write", (("obj", "Notes"),), "subj", "person")) == ["Bob"]
    assert values(Pattern("born", (("subj", "Ann"),), "time")) == ["1890"]
    assert values(Pattern("dwell", (("subj", "Ann"),), "loc")) == ["Praha"]
    assert values(Pattern("born", (("subj", SubQuery("write", (("obj", "Songs"),), "subj")),), "loc")) == ["Brno"]
    assert values(Pattern("write", (("subj", "Nobody"),), "obj")) == []
    asked = Pattern("born", (("subj", SubQuery("write", (("obj", "Songs"),), "subj")),), "loc")
    assert pattern.from_json(pattern.to_json(asked)) == asked


def test_remap_drops_collapsed_facts(spark):
    mapping = spark.createDataFrame([("Tales", "Ann"), ("Songs", "Notes")], "node string, target string")
    got = {(r["predicate"], tuple(p["node"] for p in r["participants"]), r["weight"]) for r in facts.remap(small_graph(spark), mapping).collect()}
    assert ("write", ("Notes", "Ann"), 1) in got and not any(nodes == ("Ann", "Ann") for _, nodes, _ in got)


def test_positional_merge(spark):
    names = spark.createDataFrame([(x,) for x in ("Karel Čapek", "Karel Antonín Čapek", "Antonín Čapek", "Karel")], "node string")
    got = facts.positional_mapping(facts.canonical_by_cluster(names)).collect()
    assert [tuple(r) for r in got] == [("Karel Čapek", "Karel Antonín Čapek")]


def test_containment_is_transitive(spark):
    edges = spark.createDataFrame([("street", "town"), ("town", "land"), ("land", "world")], "child string, parent string")
    got = {tuple(r) for r in matching.containment(edges).collect()}
    assert ("street", "world", 3) in got and ("land", "land", 0) in got and len(got) == 10


def test_memory(spark):
    log = spark.createDataFrame([(1, "met", ["Eva", "Jan"]), (2, "met", ["Eva"]), (3, "saw", ["Eva"])], "id int, predicate string, objects array<string>")
    assert [r["id"] for r in memory.forget_pattern(log, "met", ["Jan"]).orderBy("id").collect()] == [2, 3]
    emails = spark.createDataFrame([("Jindra", "j@x.cz"), ("Pavel", "p@x.cz"), ("Pavla", "pa@x.cz")], "name string, email string")
    asked = spark.createDataFrame([("Jindrovi",), ("Pavlovi",), ("Pav",)], "name string")
    assert {r["name"]: r["email"] for r in memory.contact(emails, asked).collect()} == {"Jindrovi": "j@x.cz", "Pavlovi": "pa@x.cz", "Pav": None}


def test_conllu(spark):
    text = "# c\n1\tPes\tpes\tNOUN\t_\tCase=Nom|Number=Sing\t2\tnsubj\t_\tTokenRange=0:3\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\tjí\tjíst\tVERB\t_\t_\t0\troot\t_\tTokenRange=4:6\n\n1\tAno\tano\tPART\t_\t_\t0\troot\t_\t_"
    got = readers.conllu(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("sent_idx", "pos").collect()
    assert [(r["sent_idx"], r["pos"], r["form"], r["head"], r["start"]) for r in got] == [(0, 1, "Pes", 2, 0), (0, 2, "jí", 0, 4), (1, 1, "Ano", 0, None)]
    assert got[0]["feats"] == {"Case": "Nom", "Number": "Sing"}


def test_missing_log_is_empty(spark, tmp_path):
    from millrace.schema import TELEMETRY

    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), TELEMETRY).count() == 0


def test_streams(spark, tmp_path):
    from millrace.streaming.state import activation_stream, warm_and_step

    turns = [(1, 0, "a", 1.0), (1, 1, "b", 2.0), (1, 1, "a", 1.0), (2, 0, "c", 1.0)]
    spark.createDataFrame(turns, "conv_id long, turn long, key string, amount double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, key string, amount double").parquet(str(tmp_path / "in"))
    query = activation_stream(stream).writeStream.format("memory").queryName("field").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["conv_id"], r["turn"], r["key"]): r["score"] for r in spark.sql("select * from field").collect()}
    first = warm_and_step({}, {"a": 1.0}, 0.8, 1e-3)
    second = warm_and_step(first, {"b": 2.0, "a": 1.0}, 0.8, 1e-3)
    assert got == pytest.approx({(1, 0, "a"): first["a"], (1, 1, "a"): second["a"], (1, 1, "b"): second["b"], (2, 0, "c"): 0.8})
