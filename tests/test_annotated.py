"""Operators over annotations and the ones that stand on them, on hand-made rows."""

import dataclasses
import json
import threading
import urllib.error
import urllib.request

import pytest
from millrace.functions import arithmetic
from millrace.operators import annotations, cascade, dialog, evaluation, extraction, facts, frames, identity, learning, lexer, memory, places, questions, resolve, retrieval
from millrace.plans import build, sequence
from millrace.sources import service, stores
from pyspark.sql import functions as F

TOKEN = "doc_id long, sent int, pos int, form string, lemma string, upos string, kase string, head int, deprel string, start int, end int"
ENTITY = "doc_id long, sent int, text string, type string, start int, end int"
PART = "fact_id string, predicate string, role string, node string, type string, weight long, seq long"


def sentence(spark, *rows, doc=1, sent=0):
    """rows: form, lemma, upos, head, deprel (and case)."""
    out, at = [], 0
    for pos, (form, lemma, upos, head, deprel, *case) in enumerate(rows, 1):
        out.append((doc, sent, pos, form, lemma, upos, case[0] if case else None, head, deprel, at, at + len(form)))
        at += len(form) + 1
    return spark.createDataFrame(out, TOKEN)


def parts_of(rows):
    return {(r["predicate"], tuple((p["role"], p["node"]) for p in r["participants"])) for r in rows.collect()}


def test_abbreviations(spark):
    forms = [("hra", 0, 3), ("R", 4, 5), (".", 5, 6), ("U", 6, 7), (".", 7, 8), ("R", 8, 9), (".", 9, 10), ("K", 11, 12), (".", 12, 13), ("je", 14, 16)]
    rows = spark.createDataFrame([(1, 0, i, f, f, "X", None, 2 if i > 2 else 10, "dep", a, b) for i, (f, a, b) in enumerate(forms, 1)], TOKEN)
    got = [(r["pos"], r["form"], r["upos"], r["head"], r["end"]) for r in annotations.merge_abbreviations(rows).orderBy("pos").collect()]
    assert got == [(1, "hra", "X", 5, 3), (2, "R.U.R.", "PROPN", 5, 10), (3, "K", "X", 2, 12), (4, ".", "X", 2, 13), (5, "je", "X", 2, 16)]


def test_entities_grow_to_abbreviations(spark):
    said = spark.createDataFrame([(1, 0, "hra R.U.R. je")], "doc_id long, sent int, line string")
    rows = spark.createDataFrame([(1, 0, 0, "R.U", "o", 4, 7), (1, 0, 1, "U.R", "o", 6, 9), (1, 0, 2, "hra", "o", 0, 3)], "doc_id long, sent int, seq int, text string, type string, start int, end int")
    got = sorted((r["text"], r["start"], r["end"]) for r in annotations.expand_to_abbreviations(rows, said).collect())
    assert got == [("R.U.R.", 4, 10), ("hra", 0, 3)]


def test_annotate_by_client(spark):
    texts = spark.createDataFrame([(1, "a bb"), (2, None)], "key long, text string")
    found = annotations.annotate(texts, lambda: lambda text: [{"word": w, "size": len(w)} for w in text.split()], "word string, size int")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1), (1, "bb", 2)]


def test_copula_genitive_and_alias(spark):
    rows = sentence(spark, ("Karel", "Karel", "PROPN", 4, "nsubj"), ("je", "být", "AUX", 4, "cop"), ("je", "x", "X", 4, "dep"), ("bratr", "bratr", "NOUN", 0, "root"), ("Josefa", "Josef", "PROPN", 4, "nmod"))
    named = spark.createDataFrame([(1, 0, "Karel", "P", 0, 5), (1, 0, "Josefa", "P", 18, 24)], ENTITY)
    nodes = extraction.token_nodes(rows, named, extraction.canonical_persons(named))
    assert parts_of(extraction.copula_facts(nodes)) == {("bratr", (("obj", "Josefa"), ("subj", "Karel")))}
    alias = sentence(spark, ("Šimon", "Šimon", "PROPN", 0, "root"), ("řečený", "řečený", "ADJ", 1, "amod"), ("Petr", "Petr", "PROPN", 2, "obj"))
    assert parts_of(extraction.alias_facts(extraction.token_nodes(alias, named.where("false")), build.ALIAS_MARKS)) == {("jmenovat", (("pred", "Petr"), ("subj", "Šimon")))}


def test_verb_facts_with_coordination_and_negation(spark):
    rows = sentence(spark, ("Marie", "Marie", "PROPN", 4, "nsubj"), ("Marta", "Marta", "PROPN", 1, "conj"), ("ne", "ne", "PART", 4, "advmod"), ("vidět", "vidět", "VERB", 0, "root"), ("dům", "dům", "NOUN", 4, "obj"))
    nodes = extraction.token_nodes(rows, spark.createDataFrame([], ENTITY))
    assert parts_of(extraction.verb_facts(nodes)) == {("nevidět", (("obj", "dům"), ("subj", x))) for x in ("Marie", "Marta")}
    assert {r["pos"]: r["verb"] for r in extraction.governing_verbs(rows).collect()} == {1: 4, 2: 4, 3: 4, 4: None, 5: 4}
    content = {r["pos"]: r["content"] for r in extraction.clause_content(rows, 3).collect()}
    assert content[1] == "Marie Marta" and content[4] == "Marie Marta ne"


def test_canon_and_context(spark):
    named = spark.createDataFrame([(1, 0, "Karel", "p", 0, 5), (1, 1, "Karel Antonín Čapek", "p", 0, 19), (1, 1, "Čapek", "p", 14, 19), (1, 1, "Praha", "g", 30, 35), (1, 1, "1921", "t", 40, 44)], ENTITY)
    canon = extraction.canonical_persons(named)
    assert {r["name"]: r["canon"] for r in canon.collect()} == dict.fromkeys(("Karel", "Karel Antonín Čapek", "Čapek"), "Karel Antonín Čapek")
    hot = spark.createDataFrame([(1, 1, "Josef")], "doc_id long, sent int, subject string")
    assert parts_of(extraction.context_facts(named, hot, canon)) == {("kontext", (("obj", x), ("subj", "Josef"))) for x in ("Karel Antonín Čapek", "Praha")}


def test_titles(spark):
    rows = sentence(spark, ("Čapek", "Čapek", "PROPN", 2, "nsubj"), ("napsal", "napsat", "VERB", 0, "root"), ("Krakatit", "Krakatit", "PROPN", 2, "obj"))
    hot = extraction.token_heat(rows, back=2.0, forward=0.5)
    none = spark.createDataFrame([], "node string")
    assert [r["form"] for r in extraction.title_candidates(hot, none, ["napsat"], threshold=0.5).collect()] == ["Krakatit"]
    assert extraction.title_candidates(hot, spark.createDataFrame([("Krakatit",)], "node string"), ["napsat"], 0.5).count() == 0


def test_identity(spark):
    names = spark.createDataFrame([("vydaný",), ("vydat",), ("vydávat",), ("psaný",)], "predicate string")
    assert [tuple(r) for r in identity.participle_mapping(names).collect()] == [("vydaný", "vydat")]
    rows, n = [], 0
    for a, b, w in (("Áron", "Mojžíš", 5), *((x, f"m{i}", 1) for x in ("Áron", "Mojžíš", "Áronovi Mojžíš") for i in range(3))):
        n += 1
        rows += [(f"f{n}", "jít", "subj", a, "person", w, n), (f"f{n}", "jít", "obj", b, "person" if b == "Mojžíš" else "concept", w, n)]
    found = identity.glued_mapping(spark.createDataFrame(rows, PART))
    assert [(r["node"], r["target"]) for r in found.collect()] in ([("Áronovi Mojžíš", "Áron")], [("Áronovi Mojžíš", "Mojžíš")])
    said = [("g", "jmenovat", "subj", "Ježíš", "person", 1, 1), ("g", "jmenovat", "pred", "Kristus", "person", 1, 1)]
    for i in range(3):
        said += [(f"a{i}", "jít", "subj", "Ježíš", "person", 1, 2), (f"a{i}", "jít", "obj", f"m{i}", "concept", 1, 2), (f"b{i}", "jít", "subj", "Ježíši Kristu", "person", 1, 3), (f"b{i}", "jít", "obj", f"m{i}", "concept", 1, 3)]
    assert [tuple(r) for r in identity.alias_mapping(spark.createDataFrame(said, PART)).collect()] == [("Ježíši Kristu", "Ježíš")]


@pytest.mark.parametrize(("text", "want"), [("kolik je 2 + 3 * 4", ("2 + 3 * 4", "14")), ("10 / 4 - 1,5", ("10 / 4 - 1,5", "1")), ("pět plus dvacet", ("5 + 20", "25")), ("1 / 0", None), ("chléb 20 mléko 15,5 celkem", ("20 + 15,5", "35,5")), ("v 18:30 a 2", None), ("dvěstě krát tři", ("200 * 3", "600")), ("jen 5", None), ("2 3", None)])
def test_sums(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(arithmetic.compute(F.col("t")).alias("x")).first()["x"]
    assert (tuple(got) if got else None) == want


def test_place_keys_and_learning(spark):
    keys = spark.createDataFrame([("Praze",), ("Plzni",)], "n string").select(places.key_variants(F.col("n")).alias("k")).collect()
    assert "prah" in keys[0]["k"] and all(keys[1]["k"])
    known = spark.createDataFrame([("a", "b")], "child string, parent string")
    said = spark.createDataFrame([("b", "a", 1), ("c", "a", 2), ("c", "b", 3), ("d", "d", 4)], "inner string, outer string, seq int")
    assert [tuple(r) for r in places.learn(known, said).collect()] == [("c", "a")]


def test_sequences(spark):
    assert sequence.expand(["?%{A}", "x"], {"A": ["b", "%{C}"], "C": "c!d"}) == ["?b", "?c!d", "x"]
    for bad in ({"A": "%{A}"}, {}):
        with pytest.raises(ValueError):
            sequence.expand(["%{A}"], bad)
    cases = [(["a", "*", "b"], "axxb", True), (["a", "*", "b"], "axx", False), (["?a", "!a"], "x", True), (["?a", "!a"], "a", False), (["*"], "", True), (["a", "?b", "?c"], "ac", True), (["a:a|b"], "a", True), (["a:b"], "a", False)]
    for pattern, text, want in cases:
        frame = spark.createDataFrame([([{"norm": c, "classes": [c]} for c in text],)], "t array<struct<norm:string,classes:array<string>>>")
        assert frame.select(sequence.fits(pattern, F.col("t")), sequence.captures(pattern, F.col("t")).isNotNull()).first() == (want, want)


def test_cascade(spark):
    rows = [("f1", "napsat", "subj", "Čapek"), ("f1", "napsat", "obj", "RUR"), ("f2", "druh", "subj", "RUR"), ("f2", "druh", "pred", "drama"), ("f3", "stěhovat", "subj", "BN"), ("f3", "stěhovat", "num", "čtyři"), ("f3", "stěhovat", "theme", "dítě"),
            ("f4", "kontext", "subj", "RUR"), ("f4", "kontext", "obj", "robot"), ("f5", "narodit", "subj", "BN"), ("f5", "narodit", "time", "1. 2. 1820"), ("f6", "rok", "subj", "1. 2. 1820"), ("f6", "rok", "val", "1820")]
    parts = spark.createDataFrame([(f, p, r, n, "x", 1, i) for i, (f, p, r, n) in enumerate(rows)], PART)
    asked = [("who", "napsat", ["RUR"], "subj", None), ("what", "být", ["RUR"], "pred", None), ("many", "mít", ["BN", "dítě"], "num", None), ("link", "zabít", ["RUR"], "obj", None), ("year", "narodit", ["BN"], "val", "rok"), ("none", "napsat", ["robot"], "pred", None)]
    found = cascade.answer(spark.createDataFrame(asked, "question string, predicate string, known array<string>, hole string, date_part string"), parts, facts.predicate_roles(parts))
    assert {r["question"]: (r["tier"], r["value"]) for r in found.collect()} == {"who": (1, "Čapek"), "what": (2, "drama"), "many": (4, "čtyři"), "link": (5, "robot"), "year": (0, "1820")}


def test_resolution(spark):
    nodes = spark.createDataFrame([("Karel Čapek", "person", 9), ("Josef Čapek", "person", 5), ("čapka", "concept", 1), ("Praha", "geo", 2)], "id string, type string, weight long")
    asked = spark.createDataFrame([("q1", ["Čapek"]), ("q2", ["Karla", "Čapka"]), ("q3", ["Praha"]), ("q4", ["nic"])], "question string, terms array<string>")
    told = spark.createDataFrame([], "question string, id string")
    alias = spark.createDataFrame([], "canonical string, alias string")
    got = {r["question"]: r for r in resolve.resolve(asked, nodes, alias, told).collect()}
    assert got["q1"]["node"] == "Karel Čapek" and got["q1"]["rivals"] == ["Josef Čapek"] and got["q3"]["quality"] == 1.0 and "q4" not in got
    assert got["q2"]["node"] == "Karel Čapek"


def test_lexer(spark):
    texts = spark.createDataFrame([(1, "Jan Novák psal na jan@x.cz, R.U.R. dnes."), (2, "jan@x.cz email psal"), (3, "Pršelo")], "key long, text string")
    rows = lexer.tagged(texts, "key", {"cas": ["dnes"], "prvni_osoba": ["jsem"]}, {"sloveso_fin": (3, ["í"])})
    got = {r["form"]: r["classes"] for r in rows.where("key = 1").collect()}
    assert got["Jan"] == ["jmeno"] and got["psal"] == ["l_tvar"] and got["jan@x.cz"] == ["email"] and got["dnes"] == ["cas"] and "R.U.R." in got
    assert {r["key"]: r["features"] for r in lexer.features(rows, "key").collect()} == {1: ["email"], 2: ["email"], 3: ["l_verb"]}


def test_clauses(spark):
    parsed = spark.createDataFrame([(1, 0, "jíst", ["Roník", "strava"], False), (1, 1, "mít", ["maso"], False), (2, 0, "potkat", ["Karel"], False), (2, 1, None, [], None)], "seq int, clause int, predicate string, objects array<string>, needs_subject boolean")
    whole = spark.createDataFrame([(1, "jíst", ["x"]), (2, "potkat", ["Karel", "Pavla"])], "seq int, predicate string, objects array<string>")
    got = sorted((r["seq"], r["clause"], r["objects"]) for r in memory.split_clauses(parsed, whole).collect())
    assert got == [(1, 0, ["Roník", "strava"]), (1, 1, ["Roník", "maso"]), (2, 0, ["Karel", "Pavla"])]


def test_template_answers(spark):
    rows = sentence(spark, ("Babičku", "babička", "NOUN", 2, "obj"), ("napsala", "napsat", "VERB", 0, "root"), ("Němcová", "Němcová", "PROPN", 2, "nsubj")).withColumn("idx", F.lit(0))
    named = spark.createDataFrame([(1, 0, "Němcová", "p", 16, 23)], ENTITY).withColumn("idx", F.lit(0))
    ask = lambda qtype, verb: spark.createDataFrame([(1, 0, qtype, verb, False, [])], "doc_id long, idx int, qtype string, verb string, copula boolean, topic array<string>")
    picked = {q: questions.select_answers(rows, named, ask(q, "napsat")) for q in ("Kdo", "Co", "Kde")}
    assert picked["Kdo"].first()["answer"] == "Němcová" and picked["Co"].first()["answer"] == "Babičku" and picked["Kde"].count() == 0
    said = questions.nominative(spark.createDataFrame([("Babičku", "Babičku")], "key string, phrase string"), spark.createDataFrame([("Babičku", "Babička")], "form string, nominative string"))
    ranked = spark.createDataFrame([("q", 1, 0, 1)], "question string, doc_id long, idx int, rank int")
    fallback = spark.createDataFrame([("q", "nevím"), ("r", "nevím")], "question string, answer string")
    got = {r["question"]: r["answer"] for r in questions.template_answers(ranked, picked["Co"], said, fallback).collect()}
    assert got == {"q": "Babička", "r": "nevím"}


def test_frames(spark):
    rows = sentence(spark, ("Jan", "Jan", "PROPN", 0, "root"), ("(", "(", "PUNCT", 1, "punct"), ("1890", "1890", "NUM", 1, "nummod"), ("–", "–", "PUNCT", 1, "punct"), ("1938", "1938", "NUM", 1, "nummod"), (")", ")", "PUNCT", 1, "punct"))
    assert {(r["predicate"], r["who"], r["year"]) for r in frames.lives(rows).collect()} == {("narodit", "Jan", 1890), ("zemřít", "Jan", 1938)}
    one = spark.createDataFrame([("Čapkův", "ADJ", True, "a·b·PIVOT·c·."), ("Karlův", "ADJ", False, "x")], "l string, u string, p boolean, s string")
    got = one.select(frames.possessive_base(F.col("l"), F.col("u"), F.col("p"), ["ův", "ova"]).alias("b"), frames.question_signature(F.col("s"), F.lit("who"), {"who": "WHO"}).alias("q")).collect()
    assert [tuple(r) for r in got] == [("Čapek", "a·b·WHO·c·?"), ("Karlův", None)]
    kin = frames.kinship(spark.createDataFrame([("a", "bratr", "b"), ("a", "otec", "c")], "a string, relation string, b string"), ["bratr"])
    assert {tuple(r) for r in kin.collect()} == {("a", "bratr", "b"), ("b", "bratr", "a"), ("a", "otec", "c")}
    parts = frames.remerge(spark.createDataFrame([(1, 0, "a b"), (1, 1, "cd"), (1, 2, "e")], "doc_id int, sent int, line string"), spark.createDataFrame([(1, 0, 4), (1, 1, 1)], "doc_id int, part int, n int"))
    assert {r["part"]: r["text"] for r in parts.collect()} == {0: "a b cd", 1: "e"}


def test_etalons(spark):
    turns = spark.createDataFrame([("s", 0, ["ano"], None, "answer", None), ("s", 1, ["x", "y"], ["z"], None, None), ("g", 0, ["q"], None, None, "open")], "scenario string, turn int, expect array<string>, reject array<string>, kind string, gap string")
    said = spark.createDataFrame([("s", 0, "Ano.", "answer"), ("s", 1, "X a y", "answer")], "scenario string, turn int, answer string, got string")
    assert {r["scenario"]: r["status"] for r in evaluation.dialog_etalon(turns, said).collect()} == {"s": "pass", "g": "gap"}
    want = spark.createDataFrame([(1, "event", None, None, None, ["a"], None), (2, "note", "p", None, None, None, ["b"])], "item int, kind string, predicate string, subject string, time string, objects array<string>, places array<string>")
    got = spark.createDataFrame([(1, "event", "x", None, None, ["a", "c"], None), (2, "note", "q", None, None, None, [])], want.schema)
    assert {r["item"]: r["wrong"] for r in evaluation.write_etalon(want, got).collect()} == {1: [], 2: ["predicate", "places"]}
    gold = spark.createDataFrame([(1, ["a"], "any"), (2, ["a", "b"], "all"), (3, ["a"], "any"), (4, ["a"], "any")], "item int, expect array<string>, mode string")
    told = spark.createDataFrame([(1, "A!", False), (2, "a", False), (3, None, True)], "item int, answer string, asked boolean")
    assert {r["item"]: r["verdict"] for r in evaluation.gold_verdicts(gold, told).collect()} == {1: "hit", 2: "wrong", 3: "clarify", 4: "none"}


def test_learning(spark):
    import random

    rnd = random.Random(3)
    rows = spark.createDataFrame([(i, (x := rnd.gauss(0, 1)), rnd.gauss(0, 1), int(x > 0), 0 if x < -0.5 else 1 if x < 0.5 else 2) for i in range(300)], "id long, x double, y double, good int, kind int")
    gate = learning.train_gate(rows, ["x", "y"], "good", threshold=0.5)
    assert rows.where(gate.opens([F.col("x"), F.col("y")]) == (F.col("good") == 1)).count() > 280
    folds = learning.held_out_accuracy(rows, "id", ["x", "y"], "kind", folds=2).agg(F.sum("right")).first()[0]
    assert folds > 240


def test_claims(spark):
    turns = spark.createDataFrame([(1, "2 + 2"), (2, "hello"), (3, "what time is 2 + 2")], "turn int, text string")
    found = dialog.claims_of(turns, "turn", {"sum": (1, F.col("text").rlike("[0-9]")), "clock": (5, F.col("text").contains("time"))})
    assert {r["turn"]: r["name"] for r in found.collect()} == {1: "sum", 3: "clock"}


@dataclasses.dataclass
class Block:
    a: int = 1
    b: str = "x"


@dataclasses.dataclass
class Settings:
    block: Block = dataclasses.field(default_factory=Block)
    c: float = 0.5


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "first words here"), (2, "other words")], "doc_id long, text string")
    index = retrieval.Index(docs, "doc_id", F.split("text", " "))
    stores.save_index(index, str(tmp_path / "index"))
    back = stores.load_index(spark, str(tmp_path / "index"), "doc_id")
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, index.postings.collect())) and back.corpus.first()["n"] == 2
    held = stores.SentenceIndex(spark.createDataFrame([(1, "One here. Two there.")], "doc_id long, text string"))
    held.save(str(tmp_path / "sentences"))
    assert stores.SentenceIndex.load(spark, str(tmp_path / "sentences")).bounds.first()["n"] == 2
    rows = sentence(spark, ("a", "a", "X", 0, "root")).unionByName(sentence(spark, ("b", "b", "X", 0, "root"), doc=2))
    stores.save_annotations(rows, spark.createDataFrame([], ENTITY), str(tmp_path / "notes"))
    assert [r["form"] for r in stores.load_annotations(spark, str(tmp_path / "notes"), [2])["tokens"].collect()] == ["b"]
    for seq in (1, 2):
        stores.save_session(spark, str(tmp_path / "sessions"), "s", seq, {"a": seq / 2}, [{"question": "q", "gravity": ["n"]}])
    assert stores.load_sessions(spark, str(tmp_path / "sessions")).first()["weights"] == {"a": 1.0}
    stores.save_settings(spark, Settings(Block(a=5)), str(tmp_path / "settings"))
    assert stores.load_settings(spark, Settings, str(tmp_path / "settings")) == Settings(Block(a=5)) and stores.settings_from(Settings, {"block": {"a": 2, "z": 1}, "q": 3}) == Settings(Block(a=2))
    with pytest.raises(ValueError):
        stores.save_graph({"rows": rows}, str(tmp_path / "graph"))


def test_server_and_fetching(spark):
    served = service.server("127.0.0.1", 0, {"/double": lambda body: {"x": 2 * body["x"]}}, {"/version": lambda: {"version": "1"}})
    thread = threading.Thread(target=served.serve_forever, daemon=True)
    thread.start()
    try:
        at = f"http://127.0.0.1:{served.server_port}"
        assert json.load(urllib.request.urlopen(f"{at}/version")) == {"version": "1"}
        assert json.load(urllib.request.urlopen(f"{at}/double", data=b'{"x": 4}')) == {"x": 8}
        for body in (b"{}", b"no"):
            with pytest.raises(urllib.error.HTTPError):
                urllib.request.urlopen(f"{at}/double", data=body)
    finally:
        served.shutdown()
    pages = {"u1": "text", "u2": ""}
    rows = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3")], "name string, url string")
    assert sorted(map(tuple, service.fetched(rows, lambda: lambda url: pages[url]).collect())) == [("a", "text", True), ("b", None, False), ("c", None, False)]
