"""Questions as a table: what lines ask, names in lines, captures; the latter two against plain loops."""

import random

import pytest
from millrace.plans import questions, sequence
from pyspark.sql import functions as F

PREDICATES = ("napsat", "narodit", "být", "bratr", "zemřít", "měl", "udělat", "Udělat", "bydlet", "ležet")
#: question, names, areas, what is asked: predicate, hole, known (role and text, or role, inner predicate and object), and more
CASES = [
    ("Kdo napsal Babičku?", ["Babičku"], [], ("napsat", "subj", [("obj", "Babičku")]), {"qtype": "Kdo", "gender": "Masc", "is_copula": False, "topic": []}),
    ("Kde se narodil Jezis?", ["Jezis"], [], ("narodit", "loc", [("subj", "Jezis")]), {"hole_type": "geo"}),
    ("Kdo je Karel Capek?", ["Karel Capek"], [], ("být", "pred", [("subj", "Karel Capek")]), {"is_copula": True}),
    ("Kdo byl bratr Karla Capka?", ["Karla Capka"], [], ("bratr", "subj", [("obj", "Karla Capka")]), {"hole_type": "person"}),
    ("Kdo byl bratr autora ktery napsal RUR?", ["autora"], [], ("bratr", "subj", [("obj", "napsat", "RUR")]), {}),
    ("Kdo byl bratr autora, ktery napsal R.U.R.?", ["autora", "R.U.R."], [], ("bratr", "subj", [("obj", "napsat", "R.U.R.")]), {}),
    ("Karel napsal Babičku.", ["Babičku"], [], None, {}),
    ("Co napsal Karel Čapek Válku s mloky?", ["Karel Čapek", "Válku s mloky"], [], ("napsat", "obj", [("subj", "Karel Čapek"), ("subj", "Válku s mloky")]), {}),
    ("Kdo napsal Válku s mloky?", ["Válku s mloky"], [], ("napsat", "subj", [("obj", "Válku s mloky")]), {}),
    ("Kdo napsal Válku s mloky dnes?", ["Válku", "mloky"], [], ("napsat", "subj", [("obj", "Válku")]), {}),
    ("Jaký měl vztah k Martě?", ["vztah", "Martě"], [], (None, "relation", [("obj", "Martě")]), {}),
    ("Kdo je Ludvík Němec?", ["Němec"], [], None, {}),
    ("Napsal Karel Čapek Válku s mloky?", ["Karel Čapek", "Válku s mloky"], [], ("napsat", None, [("subj", "Karel Čapek"), ("obj", "Válku s mloky")]), {"qtype": None}),
    ("Karel Čapek napsal?", ["Karel Čapek"], [], None, {}),
    ("Jakou hru napsal Karel Čapek?", ["hru", "Karel Čapek"], [], ("napsat", "attr", [("obj", "hru"), ("subj", "Karel Čapek")]), {}),
    ("Jakou hru napsal?", ["hru"], [], ("napsat", "attr", [("obj", "hru")]), {"gender": "Masc"}),
    ("Kde se narodil bratr Karla Čapka?", ["Karla Čapka"], [], ("narodit", "loc", [("subj", "bratr", "Karla Čapka")]), {}),
    ("V kterém roce se narodila Božena Němcová?", ["Božena Němcová"], [], ("narodit", "time", [("subj", "Božena Němcová")]), {"date_part": "rok", "gender": "Fem"}),
    ("Co se stalo s rodinou?", ["rodinou"], [], ("stát", "obj", [("subj", "rodinou")]), {}),
    ("Co se stalo v listopadu 1848?", [], [], None, {}),
    ("Kde žili Čapkovi?", ["Čapkovi"], [], ("žít", "loc", [("subj", "Čapkovi")]), {}),
    ("Kdo je jezis?", ["jezis"], [], ("být", "pred", [("subj", "jezis")]), {}),
    ("Proč přišel Ježíš?", ["Ježíš"], [], None, {}),
    ("Kdy jsem měl psa?", ["psa"], [], ("měl", "time", [("obj", "psa"), ("subj", "uživatel")]), {}),
    ("Co udělal Ježíš v Kafarnaum?", ["Ježíš"], ["Kafarnaum"], ("udělat", "obj", [("subj", "Ježíš")]), {"place": "Kafarnaum"}),
    ("Kde ležel Kafarnaum?", ["Kafarnaum"], ["Kafarnaum"], ("ležet", "loc", [("subj", "Kafarnaum")]), {"place": None}),
    ("Kdo se narodil v Betlémě?", [], ["Betlémě"], ("narodit", "subj", []), {"place": "Betlémě"}),
    ("Zpíval dnes Karel Čapek?", ["Karel Čapek"], [], ("zpíval", None, [("subj", "Karel Čapek")]), {}),
    ("", [], [], None, {}),
    ("?", [], [], None, {}),
    (None, [], [], None, {}),
]


def asked(row):
    return row["predicate"], row["hole"], [(k["role"], k["text"]) if k["predicate"] is None else (k["role"], k["predicate"], k["object"]) for k in row["known"]]


def lone(word):
    return word


def test_what_lines_ask(spark):
    """Every line with its own names: they are marked with the line's number, as all lines go through together."""
    predicates = spark.createDataFrame([(p,) for p in PREDICATES], "predicate string")
    groups = {}
    for case in CASES:  # lines whose names don't disturb each other go together
        held = next((g for g in groups.values() if not any(set(n.split()) & set((c[0] or "").replace("?", "").split()) for n in case[1] for c in g) and not any(set(n.split()) & set((case[0] or "").replace("?", "").split()) for c in g for n in c[1])), None)
        (held if held is not None else groups.setdefault(len(groups), [])).append(case)
    for group in groups.values():
        lines = spark.createDataFrame([(i, c[0]) for i, c in enumerate(group)], "question int, text string")
        names = spark.createDataFrame([(n,) for c in group for n in c[1]], "name string")
        areas = spark.createDataFrame([(n,) for c in group for n in c[2]], "name string")
        found = {r["question"]: r for r in questions.question_patterns(lines, predicates, names, word=lone, areas=areas).collect()}
        for i, (text, _, _, want, more) in enumerate(group):
            assert (asked(found[i]) if i in found else None) == want, text
            assert {k: found[i][k] for k in more} == more, text


def test_cards_go_first(spark):
    deck = [
        sequence.Card("who", ("otaz:kdo", "l_tvar", "uzel+"), 1, hole=1, predicate=2, known=(("", 3),)),
        sequence.Card("more", ("otaz:kdo", ":dalsi", "l_tvar", "uzel+"), 2, hole=1, predicate=3, known=(("obj", 4),), novelty=2),
        sequence.Card("why", ("otaz", "*"), 0, hole=1, predicate="být"),
    ]
    tables = {"otaz": ["kdo", "proc"]}
    from millrace.operators import lexer

    lines = spark.createDataFrame([(1, "Kdo napsal RUR?"), (2, "Kdo další napsal RUR?"), (3, "Proč napsal RUR?"), (4, "Kdo je RUR?")], "question int, text string")
    found = questions.question_patterns(lines, spark.createDataFrame([("napsat",)], "predicate string"), spark.createDataFrame([("RUR",)], "name string"), cards=deck, classes=lambda form: lexer.classes(form, tables, {}), word=lone)
    rows = {r["question"]: r for r in found.collect()}
    assert {i: (r["card"], *asked(r), r["novelty"]) for i, r in rows.items()} == {1: ("who", "napsat", "subj", [("obj", "RUR")], False), 2: ("more", "napsat", "subj", [("obj", "RUR")], True), 4: ("why", "být", "subj", [], False)}


def test_verb_forms(spark):
    forms = ("napsal", "nenapsal", "mel", "meli", "stalo", "byla", "udelal", "bydlelo", "pes", "narodily")
    found = questions.verb_matches(spark.createDataFrame([(f,) for f in forms], "norm string"), spark.createDataFrame([(p,) for p in (*PREDICATES, "nebydlet")], "predicate string"))
    assert {r["norm"]: (r["verb"], r["exact"]) for r in found.collect()} == {
        "napsal": ("napsat", False), "nenapsal": (None, False), "mel": ("měl", True), "meli": ("měl", True), "stalo": ("stát", False), "byla": (None, False), "udelal": ("udělat", False), "bydlelo": ("bydlet", False), "pes": (None, False), "narodily": ("narodit", False),
    }


def plain_match(elements, tokens, spans, at=0):
    """Bounds by trying ends from the farthest."""
    if not elements:
        return [at] if at == len(tokens) else None
    x = elements[0]
    if x.any:
        ends = range(len(tokens), at - 1, -1)
    elif x.span:
        ends = [e for e in range(len(tokens), at, -1) if (at, e) in spans]
    else:
        fits = at < len(tokens) and (not x.kind or x.kind in tokens[at]) and not set(x.without) & set(tokens[at])
        ends = [at + 1] if fits else []
    for end in [*ends, *([at] if x.optional and not x.any else [])]:
        rest = plain_match(elements[1:], tokens, spans, end)
        if rest is not None:
            return [at, *rest]
    return None


@pytest.mark.parametrize("pattern", [["a", "*", "b"], ["?a", "?b", "*", "?a"], ["*", "uzel+", "*", "b"], ["?uzel+", "uzel+", "?a!b"], ["*", "*", "!a"], ["a"], ["*"], ["?a!b", "uzel+", "b"]])
def test_captures_are_those_of_trying_all_ends(spark, pattern):
    rnd = random.Random(7)
    rows = []
    for i in range(120):
        tokens = [rnd.choice([["a"], ["b"], ["a", "b"], []]) for _ in range(rnd.randrange(7))]
        spans = sorted({(a, rnd.randrange(a + 1, len(tokens) + 1)) for a in range(len(tokens)) for _ in range(2) if rnd.random() < 0.6})
        rows.append((i, [{"norm": "", "classes": t} for t in tokens], [{"start": a, "end": b} for a, b in spans]))
    frame = spark.createDataFrame(rows, "i int, t array<struct<norm: string, classes: array<string>>>, s array<struct<start: int, end: int>>")
    elements = [sequence.Element.of(x) for x in pattern]
    found = frame.select("i", sequence.captures(pattern, F.col("t"), F.col("s")).alias("b")).collect()
    want = [plain_match(elements, [t["classes"] for t in r[1]], {(s["start"], s["end"]) for s in r[2]}) for r in rows]
    assert [r["b"] for r in sorted(found)] == want and any(want)


def plain_names(tokens, spans):
    """The names of one run, by the rules in words."""
    out, at, rel, titled, content = [], 0, None, False, False
    while at < len(tokens):
        t = tokens[at]
        if t["skip"]:
            if out and titled:
                break
            at += 1
            continue
        if not content and t["relational"]:
            rel, content, at = t["form"], True, at + 1
            continue
        content = True
        ends = [b for a, b in spans if a == at and not tokens[b - 1]["skip"]]
        if ends:
            out.append(" ".join(x["form"] for x in tokens[at : max(ends)]))
            titled, at = out[-1][0].isupper(), max(ends)
        elif out:
            at += 1
        else:
            return None
    return [f"{rel} {out[0]}", *out[1:]] if rel and out else [rel] if rel else out


def test_names_are_those_of_the_loop(spark):
    rnd = random.Random(3)
    shape = "form: string, norm: string, skip: boolean, relational: boolean, boundary: boolean, gone: boolean, relative: boolean, sub: struct<predicate: string, object: string>"
    rows = []
    for i in range(400):
        words = [rnd.choice(["Aa", "b", "Cc", "d", "s", "bratr"]) for _ in range(rnd.randrange(7))]
        tokens = [{"form": w, "norm": w.lower(), "skip": w == "s", "relational": w == "bratr", "boundary": False, "gone": False, "relative": False, "sub": None} for w in words]
        spans = sorted({(a, rnd.randrange(a + 1, len(words) + 1)) for a in range(len(words)) for _ in range(2) if rnd.random() < 0.6})
        rows.append((i, tokens, [{"start": a, "end": b} for a, b in spans]))
    frame = spark.createDataFrame(rows, f"i int, t array<struct<{shape}>>, s array<struct<start: int, end: int>>")
    found = {r["i"]: r["n"] and [x["text"] for x in r["n"]] for r in frame.select("i", questions.split_names(F.col("t"), F.col("s")).alias("n")).collect()}
    want = {i: plain_names(t, [(s["start"], s["end"]) for s in s_]) for i, t, s_ in rows}
    assert found == want and sum(x is None for x in want.values()) > 20


def test_names_of_a_vocabulary(spark):
    """Runs of words that are names, against all runs of all lines."""
    rnd = random.Random(9)
    names = {" ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4))) for _ in range(12)}
    lines = [(i, " ".join(rnd.choice("abcd") for _ in range(rnd.randrange(6)))) for i in range(60)]
    tokens = questions.question_tokens(spark.createDataFrame(lines, "line int, text string"), "line")
    found = {r["line"]: [(s["start"], s["end"]) for s in r["spans"]] for r in questions.name_spans(tokens, spark.createDataFrame([(n,) for n in names], "name string"), "line", lone).collect()}
    want = {i: [(a, b) for a in range(len(w)) for b in range(a + 1, len(w) + 1) if " ".join(w[a:b]) in names] for i, w in ((i, t.split()) for i, t in lines)}
    assert found == {i: s for i, s in want.items() if s}
    assert {r[0] for r in questions.span_names(spark.createDataFrame([("x y z",)], "name string"), lone).collect()} == {"x", "y", "z", "x y", "y z", "x y z"}
