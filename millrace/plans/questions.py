"""Questions as a table: a column of lines becomes a column of patterns, by cards and by the order of a question's words.

`verb_matches` finds for each form which predicate it may mean, `name_spans` which runs of a line's words are names;
both are joins over distinct forms and word sequences. Everything else is one expression for a line: the names are taken
from the left, the longest first, and the rules that follow read the line's tokens and names. Nothing runs line by line
in Python, and nothing of the graph but its predicates and names is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fixed, strings
from millrace.operators.identity import common_prefix
from millrace.plans.sequence import Card, best_card, captures, let
from millrace.runtime import settle

KNOWN = "array<struct<role: string, text: string, predicate: string, object: string>>"
FORMS = r"[\p{L}\p{N}_.]+"


def folded(words: Sequence[str]) -> tuple[str, ...]:
    import unicodedata

    return tuple("".join(c for c in unicodedata.normalize("NFKD", w.lower()) if not unicodedata.combining(c)) for w in words)


@dataclass(frozen=True)
class QuestionWords:
    """A language's words, without marks."""

    interrogatives: Mapping[str, tuple[str, str | None, str]] = field(default_factory=lambda: dict(fixed.INTERROGATIVES))
    adverbs: tuple[str, ...] = folded(fixed.INTERROGATIVE_ADVERBS)
    copulas: tuple[str, ...] = fixed.COPULA_FORMS
    relatives: tuple[str, ...] = fixed.RELATIVE_PRONOUNS
    skip: tuple[str, ...] = fixed.QUERY_SKIP_WORDS
    date_parts: Mapping[str, str] = field(default_factory=lambda: dict(fixed.DATE_PART_FORMS))
    relational: tuple[str, ...] = fixed.RELATIONAL_NOUNS
    relation: tuple[str, ...] = fixed.RELATION_NOUNS
    first_person: tuple[str, ...] = fixed.FIRST_PERSON
    temporal: tuple[str, ...] = (*fixed.DAY_WORDS, *fixed.TIME_UNITS, *fixed.NOW_WORDS, *fixed.CURRENT_WORDS)
    current: tuple[str, ...] = fixed.CURRENT_WORDS
    event_verbs: Mapping[str, str] = field(default_factory=lambda: dict(fixed.EVENT_VERB_FORMS))
    event_classes: Mapping[str, str] = field(default_factory=lambda: dict(fixed.EVENT_CLASS_FORMS))
    synonyms: tuple[str, ...] = ()
    negation: str = fixed.NEGATION
    user: str = fixed.USER
    copula: str = "být"
    place_words: tuple[str, ...] = ("v", "ve", "na")


def mapping(values: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair)) if values else F.lit(None).cast("map<string,string>")


def question_tokens(lines: DataFrame, key: str) -> DataFrame:
    """key, at (from 0), form, norm. lines: key, text."""
    rows = lines.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(FORMS), F.lit(0))).alias("at", "form"))
    return rows.select(key, "at", "form", strings.fold_accents(F.col("form")).alias("norm"))


def verb_matches(forms: DataFrame, predicates: DataFrame, words: QuestionWords | None = None) -> DataFrame:
    """norm, verb, exact: the predicate that each form may mean, null if none; exact: the form is a predicate, or its
    l-participle is. forms: norm; predicates: predicate.

    In this order: the predicate itself; its negation's or affirmation's counterpart; its l-participle; a form listed with its
    verb; the predicate with the longest common beginning (four letters and all but two of the shorter word; for participles
    also all but the last letter, of short predicates or of those of which three letters are shared). Of predicates that are
    alike in this, those in small letters go first, then in order."""
    words = words or QuestionWords()
    asked = forms.select("norm").distinct()
    known = predicates.select("predicate").distinct().withColumn("p", strings.fold_accents(F.col("predicate")))
    order = [F.col("predicate").rlike(r"^\p{Lu}"), F.col("predicate")]
    by_norm = known.withColumn("rank", F.row_number().over(Window.partitionBy("p").orderBy(*order))).where("rank = 1").select("p", "predicate")
    met = lambda column, name: asked.withColumn("p", column).join(by_norm, "p").select("norm", F.col("predicate").alias(name))
    low, no, size = F.col("norm"), words.negation, F.length("norm")
    cut = F.regexp_replace(low, "[aioy]+$", "")
    # the prefix is put to or taken from the predicate as it is written
    parts = [
        met(low, "same"),
        met(F.when(size >= 3, F.concat(F.lit(no), low)), "denied").select("norm", F.expr(f"substring(denied, {len(no) + 1})").alias("denied")),
        met(F.when(low.startswith(no) & (size - len(no) >= 3), F.expr(f"substring(norm, {len(no) + 1})")), "affirmed").select("norm", F.concat(F.lit(no), "affirmed").alias("affirmed")),
        met(F.when(cut.endswith("l"), cut), "past"),
    ]
    more = known.unionByName(predicates.sparkSession.createDataFrame([(x, y) for x, y in zip(words.synonyms, folded(words.synonyms), strict=True)], "predicate string, p string")).distinct() if words.synonyms else known
    plain = F.regexp_replace(low, "[aeiouy]+$", "")
    start = lambda column, n: F.concat(F.lit(f"{n}:"), F.substring(column, 1, n))
    p_size = F.length("p")
    said = asked.where(size >= 4).select("norm", F.explode(F.array_compact(F.array(start(low, 3), F.when(plain.endswith("l"), start(low, 2)), F.when(plain.endswith("l"), start(low, 1))))).alias("k"))
    held = more.select("predicate", "p", F.explode(F.array_compact(F.array(F.when(p_size >= 3, start(F.col("p"), 3)), F.when(p_size == 3, start(F.col("p"), 2)), F.when(p_size == 2, start(F.col("p"), 1))))).alias("k"))
    near = said.join(held, "k").select("norm", "predicate", "p", common_prefix(low, F.col("p")).alias("n"))
    participle = F.regexp_replace(low, "[aeiouy]+$", "").endswith("l")
    good = ((F.col("n") >= 4) & (F.col("n") >= F.least(size, p_size) - 2)) | ((p_size <= 3) & (F.col("n") >= p_size - 1) & participle) | (participle & (F.col("n") >= F.greatest(F.lit(3), p_size - 1)))
    best = near.where(good).groupBy("norm").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("predicate").rlike(r"^\p{Lu}").alias("large"), "predicate")).alias("best"))
    out = asked
    for part in parts:
        out = out.join(part, "norm", "left")
    out = out.join(best, "norm", "left")
    verb = F.coalesce("same", "denied", "affirmed", "past", F.try_element_at(mapping(words.event_verbs), low), "best.predicate")
    return out.select("norm", F.when(~low.isin(*words.copulas), verb).alias("verb"), (F.col("same").isNotNull() | F.col("past").isNotNull()).alias("exact"))


def span_names(names: DataFrame, key: Callable[[Column], Column] = strings.loose_key) -> DataFrame:
    """name: every run of words within a name, by the words' keys, so that a part of a name is met as well. names: name."""
    words = names.select(F.transform(strings.words(F.col("name")), key).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice("w", i, k), " "))))
    return words.select(F.explode(F.array_distinct(runs)).alias("name")).distinct()


def name_spans(tokens: DataFrame, names: DataFrame, key: str, word: Callable[[Column], Column] = strings.loose_key) -> DataFrame:
    """key, spans: the runs of a line's tokens that are names, as an array of (start, end). tokens: key, at, form; names:
    name, of words that `word` has been applied to. Lines without any are missing.

    A line's runs, no longer than the longest name, meet the names by equality, once for each distinct run."""
    longest = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 0
    lines = tokens.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "form"))), lambda x: word(x["form"])).alias("w"))
    n = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, F.least(n, i + longest)), lambda end: F.struct(i.alias("start"), end.alias("end"), F.array_join(F.slice("w", i + 1, end - i), " ").alias("name")))))
    met = lines.select(key, F.explode(runs).alias("r")).select(key, "r.*").join(names.select("name").distinct(), "name")
    return met.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


PART = "struct<start: int, end: int, text: string, role: string, predicate: string, object: string>"
STATE = f"struct<parts: array<{PART}>, first: int, rel: string, matched: boolean, titled: boolean, stopped: boolean, next: int, failed: boolean, ended: boolean>"


def text_of(tokens: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.transform(F.slice(tokens, start + 1, end - start), lambda t: t["form"]), " ")


def split_names(tokens: Column, spans: Column) -> Column:
    """The names of a line: array of structs, or null if a run of words begins with one that is no name.

    tokens: array of struct(form, norm, skip, relational, boundary, gone, relative, sub): boundary tokens end a run, gone ones
    are not there at all, at a relative one the line ends, and the name before it gives way to sub, a question within
    (struct of predicate and object, may be null). Within a run the longest name from the left is taken; a function word after
    a capitalised name, or a word after a name that is none itself, is part of its title. A relational noun at a run's
    beginning goes with its first name, and is a name where nothing follows.

    Tokens and spans are worked out once for a line, not anew for each of its words."""
    return let(tokens, lambda t: let(spans, lambda s: names_from_left(t, s)))


def names_from_left(tokens: Column, spans: Column) -> Column:
    """What split_names gives, of tokens and spans that are values."""
    nothing = F.lit(None).cast("string")
    none = F.array().cast(f"array<{PART}>")
    part = lambda start, end, text, predicate=nothing, thing=nothing: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"), nothing.alias("role"), predicate.alias("predicate"), thing.alias("object"))

    def state(s: Column, **change: Column) -> Column:
        names = ("parts", "first", "rel", "matched", "titled", "stopped", "next", "failed", "ended")
        return F.struct(*(change.get(x, s[x]).alias(x) for x in names)).cast(STATE)

    start = F.struct(none.alias("parts"), F.lit(0).alias("first"), nothing.alias("rel"), F.lit(False).alias("matched"), F.lit(False).alias("titled"), F.lit(False).alias("stopped"), F.lit(0).alias("next"), F.lit(False).alias("failed"), F.lit(False).alias("ended")).cast(STATE)

    def flushed(s: Column) -> Column:
        alone = s["rel"].isNotNull() & (F.size(s["parts"]) == s["first"])
        parts = F.when(alone, F.concat(s["parts"], F.array(part(F.lit(0), F.lit(0), s["rel"])))).otherwise(
            F.when(s["rel"].isNotNull(), F.transform(s["parts"], lambda x, i: F.when(i == s["first"], part(x["start"], x["end"], F.concat(s["rel"], F.lit(" "), x["text"]))).otherwise(x))).otherwise(s["parts"])
        )
        return state(s, parts=parts, first=F.size(parts), rel=nothing, matched=F.lit(False), titled=F.lit(False), stopped=F.lit(False))

    def word(s: Column, i: Column, t: Column) -> Column:
        fresh = ~s["matched"] & s["rel"].isNull()
        ends = F.filter(spans, lambda x: (x["start"] == i) & ~F.get(tokens, x["end"] - 1)["skip"])
        end = F.array_max(F.transform(ends, lambda x: x["end"]))
        named = text_of(tokens, i, end)
        hit = state(s, parts=F.concat(s["parts"], F.array(part(i, end, named))), matched=F.lit(True), titled=named.rlike(r"^\p{Lu}"), next=end)
        return (
            F.when(s["stopped"], s)
            .when(t["skip"], F.when(s["matched"] & s["titled"], state(s, stopped=F.lit(True))).otherwise(s))
            .when(fresh & t["relational"], state(s, rel=t["form"]))
            .when(end.isNotNull(), hit)
            .when(~s["matched"], state(s, failed=F.lit(True)))
            .otherwise(s)
        )

    def subquestion(s: Column, t: Column) -> Column:
        last = part(F.lit(0), F.lit(0), nothing, t["sub"]["predicate"], t["sub"]["object"])
        told = F.concat(F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0))), F.array(last))
        return state(s, parts=F.when(t["sub"].isNotNull(), told).otherwise(s["parts"]), ended=F.lit(True))

    def step(s: Column, i: Column) -> Column:
        t = F.get(tokens, i)
        return let(
            t,
            lambda t: F.when(s["failed"] | s["ended"] | (i < s["next"]) | t["gone"], s)
            .when(t["relative"], let(flushed(s), lambda f: subquestion(f, t)))
            .when(t["boundary"], flushed(s))
            .otherwise(word(s, i, t)),
        )

    n = F.size(tokens)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: F.when(~s["failed"], flushed(s)["parts"]))


def known_of(parts: Column, role: Callable[[Column, Column], Column]) -> Column:
    """Parts as known participants; role(i, part)."""
    return F.transform(parts, lambda x, i: F.struct(role(i, x).alias("role"), x["text"].alias("text"), x["predicate"].alias("predicate"), x["object"].alias("object")))


def question_patterns(lines: DataFrame, predicates: DataFrame, names: DataFrame, key: str = "question", cards: Sequence[Card] = (), classes: Callable[[Column], Column] | None = None, words: QuestionWords | None = None, word: Callable[[Column], Column] = strings.loose_key, areas: DataFrame | None = None) -> DataFrame:
    """key, card, predicate, known, hole, hole_type, date_part, qtype, gender, is_copula, novelty, predicate_class, place,
    topic: what each line asks, as a fact with a hole; lines that are no questions, or of which no pattern can safely be
    made, are missing.

    lines: key, text; predicates: predicate; names: name, as span_names makes them with the same `word`; areas: name, of one
    word that `word` has been applied to: one behind a preposition limits the place and is no participant. classes: the
    classes of a form, for the cards. Cards go first: the one with the highest priority, then with the longest pattern. Otherwise the
    question word gives the hole, the first word before a relative pronoun that means a predicate and isn't a name the
    predicate, and the names are known. A question within, behind a relative pronoun, stands for the name before it."""
    words = words or QuestionWords()
    asked = lines.where(F.col("text").contains("?")).select(key, "text")
    tokens = question_tokens(asked, key)
    matches = verb_matches(tokens, predicates, words)
    told = F.array().cast("array<string>") if classes is None else classes(F.col("form"))
    rich = tokens.join(matches, "norm", "left")
    area = F.lit(False)
    if areas is not None:
        rich = rich.withColumn("area_key", word(F.col("form"))).join(areas.select(F.col("name").alias("area_key"), F.lit(True).alias("is_area")).distinct(), "area_key", "left")
        area = F.coalesce("is_area", F.lit(False))
    rich = rich.select(key, "at", "form", "norm", "verb", F.coalesce("exact", F.lit(False)).alias("exact"), told.alias("classes"), area.alias("area"))
    rows = rich.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "form", "norm", "verb", "exact", "classes", "area"))).alias("raw"))
    rows = rows.join(name_spans(tokens, names, key, word), key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")))
    return cascade_of(rows, key, cards, words)


def cascade_of(rows: DataFrame, key: str, cards: Sequence[Card], words: QuestionWords) -> DataFrame:
    one = lambda x, held: x.isin(*held) if held else F.lit(False)
    questions = F.create_map(*(y for w, (role, kind, name) in words.interrogatives.items() for y in (F.lit(w), F.struct(F.lit(role).alias("role"), F.lit(kind).cast("string").alias("type"), F.lit(name).alias("name")))))
    parts = mapping(words.date_parts)
    is_node = lambda i: F.exists("spans", lambda s: (s["start"] == i) & (s["end"] == i + 1))

    def enriched(t: Column, i: Column) -> Column:
        verb = F.when(~t["form"].rlike(r"^\p{Lu}"), t["verb"])
        node = is_node(i)
        relational = one(t["norm"], words.relational)
        stops = F.try_element_at(questions, t["norm"]).isNotNull() | one(t["norm"], words.copulas) | F.try_element_at(parts, t["norm"]).isNotNull() | (verb.isNotNull() & (t["exact"] | ~node))
        return F.struct(
            t["form"].alias("form"), t["norm"].alias("norm"), t["classes"].alias("classes"), t["verb"].alias("any_verb"), verb.alias("verb"), t["exact"].alias("exact"), node.alias("node"), one(t["norm"], words.skip).alias("skip"),
            relational.alias("relational"), (stops & ~relational).alias("stops"), one(t["norm"], words.copulas).alias("copula"), one(t["norm"], words.relatives).alias("relative"), F.try_element_at(questions, t["norm"]).alias("asks"), t["area"].alias("area"),
        )

    q = rows.withColumn("t", F.transform("raw", enriched))
    t = F.col("t")
    first = lambda test: F.get(F.filter(F.transform(t, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: test(p["x"], p["i"])), F.lit(0))
    q = q.withColumn("asks", F.get(F.filter(F.transform(t, lambda x: x["asks"]), lambda a: a.isNotNull()), F.lit(0)))
    q = q.withColumn("rel_at", F.coalesce(first(lambda x, i: (i > 0) & x["relative"])["i"], F.size(t)))
    q = q.withColumn("main", first(lambda x, i: (i < F.col("rel_at")) & ~x["relational"] & (x["exact"] | ~x["node"]) & x["verb"].isNotNull())["x"])
    q = q.withColumn("cop", first(lambda x, i: x["copula"])["x"])
    part = F.get(F.filter(F.transform(t, lambda x, i: F.when(~((i > 0) & one(F.get(t, i - 1)["norm"], words.current)), F.try_element_at(parts, x["norm"]))), lambda p: p.isNotNull()), F.lit(0))
    q = q.withColumn("date_part", part)

    head = F.get(t, F.lit(0))
    l_stem = F.regexp_replace(F.lower(head["form"]), "[aioy]+$", "")
    unknown = F.when(l_stem.endswith("l") & (F.length(l_stem) >= 3) & ~head["node"], l_stem)
    q = q.withColumn("mode", F.when(F.col("asks").isNotNull(), "hole").when(F.exists(t, lambda x: one(x["norm"], words.adverbs)), "adverb").otherwise("exists"))
    q = q.withColumn("exists_verb", F.when(head["any_verb"].isNotNull(), F.when(~head["node"] | head["exact"], head["any_verb"])).when(~head["copula"], unknown))
    q = q.withColumn("related", (F.col("mode") == "hole") & F.exists(t, lambda x: one(x["norm"], words.relation)))

    limits = first(lambda x, i: x["area"] & F.when(F.col("mode") == "exists", i > 0).otherwise((i > 0) & one(F.get(t, i - 1)["norm"], words.place_words)))
    q = q.withColumn("place_at", F.coalesce(limits["i"], F.lit(-1))).withColumn("place", limits["x"]["form"])

    after = lambda i: F.slice(t, i + 2, F.size(t))

    def sub_of(rest: Column) -> Column:
        """The first verb of what follows, and the words behind it."""
        marked = F.aggregate(
            rest,
            F.struct(F.lit(None).cast("string").alias("predicate"), F.array().cast("array<string>").alias("said")),
            lambda s, x: F.when(s["predicate"].isNull(), F.struct(x["verb"].alias("predicate"), s["said"].alias("said"))).when(x["copula"] | x["skip"], s).otherwise(F.struct(s["predicate"].alias("predicate"), F.concat(s["said"], F.array(x["form"])).alias("said"))),
        )
        return let(marked, lambda m: F.when(m["predicate"].isNotNull() & (F.size(m["said"]) > 0), F.struct(m["predicate"].alias("predicate"), F.array_join(m["said"], " ").alias("object"))))

    def tokens(gone: Callable[[Column, Column], Column], begin: Column) -> Column:
        return F.transform(
            t,
            lambda x, i: F.struct(
                x["form"].alias("form"), x["norm"].alias("norm"), x["skip"].alias("skip"), x["relational"].alias("relational"), x["stops"].alias("boundary"), gone(x, i).alias("gone"), (x["relative"] & (i > begin)).alias("relative"),
                F.when(x["relative"] & (i > begin), sub_of(after(i))).alias("sub"),
            ),
        )

    past = lambda x: x["form"].rlike(r"^\p{Ll}") & F.regexp_replace(x["form"], "[aioy]+$", "").endswith("l")
    begin = F.when(F.col("mode") == "exists", 1).otherwise(0)
    yes_no = lambda x, i: F.when(F.col("mode") == "exists", (i == 0) | one(x["norm"], words.temporal) | F.coalesce(x["form"] == F.col("place"), F.lit(False))).otherwise((F.col("place_at") > 0) & ((i == F.col("place_at")) | (i == F.col("place_at") - 1)))
    q = q.withColumn("tokens", tokens(yes_no, begin))
    between = lambda x, i: one(x["norm"], words.relation) | x["skip"] | (past(x) & ~x["node"])
    q = q.withColumn("between", F.when(F.col("related"), tokens(between, F.lit(0))))
    # written, as the optimiser would copy what the names and the rules share into each of their many places
    q = settle(q.drop("raw"), "question-tokens")
    q = q.withColumn("names", split_names(F.col("tokens"), F.col("spans"))).withColumn("linked", F.when(F.col("related"), split_names(F.col("between"), F.col("spans"))))
    q = settle(q.drop("tokens", "between"), "question-names")
    t, head = F.col("t"), F.get(F.col("t"), F.lit(0))

    rank = lambda i, x: F.when(i == 0, "subj").otherwise("obj")
    literal = lambda x: F.lit(x).cast("string")

    def pattern(kind: str, predicate: Column, known: Column, hole: Column, hole_type: Column, date: Column | None = None, verb: Column | None = None) -> Column:
        verb = literal(None) if verb is None else verb
        return F.struct(
            literal(kind).alias("rule"), literal(None).alias("card"), predicate.cast("string").alias("predicate"), known.cast(KNOWN).alias("known"), hole.cast("string").alias("hole"), hole_type.cast("string").alias("hole_type"),
            (literal(None) if date is None else date).alias("date_part"), F.col("asks.name").alias("qtype"), verb.alias("spoken"), F.lit(False).alias("novelty"), literal(None).alias("predicate_class"),
        )

    role = F.when(F.col("date_part").isNotNull() & (F.col("asks.role") == "attr"), "time").otherwise(F.col("asks.role"))
    kind = F.when(F.col("date_part").isNotNull() & (F.col("asks.role") == "attr"), "time").otherwise(F.col("asks.type"))
    names, has = F.col("names"), F.size("names") > 0
    word_list = lambda x: strings.words(x["text"])
    heads = lambda x: strings.fold_accents(F.get(word_list(x), F.lit(0)))
    rest_of = lambda x: F.array_join(F.slice(word_list(x), F.lit(2), F.size(word_list(x))), " ")
    kin = lambda x: x["text"].isNotNull() & one(heads(x), words.relational) & (F.size(word_list(x)) > 1)
    only = lambda predicate, thing, sub, obj: F.array(F.struct(literal(predicate).alias("role"), thing.alias("text"), sub.alias("predicate"), obj.alias("object")))
    relative = F.get(F.filter(names, kin), F.lit(0))
    inner = F.get(F.filter(names, lambda x: x["predicate"].isNotNull()), F.lit(0))
    kin_word = first(lambda x, i: x["relational"])["x"]["norm"]
    verb = F.col("main.verb")
    nested = F.transform(names, lambda x: F.when(kin(x), F.struct(x["start"], x["end"], literal(None).alias("text"), literal("subj").alias("role"), heads(x).alias("predicate"), rest_of(x).alias("object")).cast(PART)).otherwise(x))
    mine = F.exists(t, lambda x: one(x["norm"], words.first_person))
    fixed_role = lambda x: F.coalesce(x["role"], F.lit("obj"))
    as_main = (
        F.when(mine, F.concat(known_of(nested, lambda i, x: F.when(x["predicate"].isNull(), "obj").otherwise(fixed_role(x))), only("subj", literal(words.user), literal(None), literal(None)).cast(KNOWN)))
        .when(F.col("asks.role") == "attr", F.when(role == "time", known_of(nested, lambda i, x: F.when(x["predicate"].isNull(), "subj").otherwise(fixed_role(x)))).otherwise(known_of(nested, lambda i, x: F.when(i == 0, "obj").otherwise("subj"))))
        .otherwise(known_of(nested, lambda i, x: F.when(x["predicate"].isNull(), F.when(role == "subj", "obj").otherwise("subj")).otherwise(fixed_role(x))))
    )
    spoken = F.coalesce(F.col("main.form"), F.col("cop.form"))
    plain = (
        F.when(F.col("related") & (F.size("linked") > 0), pattern("relation", literal(None), known_of(F.col("linked"), lambda i, x: F.lit("obj")), F.lit("relation"), literal(None)))
        .when(F.col("mode") == "adverb", F.lit(None))
        .when(F.col("mode") == "exists", F.when(F.col("exists_verb").isNotNull() & names.isNotNull() & (has | head["any_verb"].isNotNull()), pattern("exists", F.col("exists_verb"), known_of(names, rank), literal(None), literal(None), verb=head["form"])))
        .when(names.isNull(), F.lit(None))
        .when(relative.isNotNull() & verb.isNull(), pattern("kin", heads(relative), only("obj", rest_of(relative), literal(None), literal(None)), F.lit("subj"), F.lit("person"), verb=spoken))
        .when(inner.isNotNull() & verb.isNull() & kin_word.isNotNull(), pattern("kin", kin_word, only("obj", literal(None), inner["predicate"], inner["object"]), F.lit("subj"), F.lit("person"), verb=spoken))
        .when(verb.isNotNull() & (has | F.col("place").isNotNull()), pattern("verb", verb, as_main, role, kind, F.col("date_part"), spoken))
        .when(F.col("cop").isNotNull() & has, pattern("copula", F.lit(words.copula), known_of(F.slice(names, 1, 1), lambda i, x: F.lit("subj")), F.when(role == "attr", "attr").otherwise("pred"), kind, verb=spoken))
    )
    if cards:
        q = settle(q.withColumn("card", best_card(cards, t, F.col("spans"))), "question-cards")
    q = q.withColumn("p", F.coalesce(*(F.when(F.col("card") == c.name, asked_by(c, t, questions, parts, words)) for c in cards), plain))
    q = settle(q.select(key, "t", "cop", "place", "p"), "question-asked").where("p IS NOT NULL")
    used = F.flatten(F.transform("p.known", lambda k: F.concat(strings.words(F.coalesce(k["text"], k["object"])))))
    topic = F.transform(F.filter(t, lambda x: x["asks"].isNull() & ~x["copula"] & ~x["skip"] & ~x["relative"] & F.try_element_at(parts, x["norm"]).isNull() & x["verb"].isNull() & ~F.array_contains(F.concat(used, F.array(F.coalesce("p.predicate", F.lit("")))), x["form"])), lambda x: x["form"])
    return q.select(
        key, F.col("p.card").alias("card"), F.col("p.predicate").alias("predicate"), F.col("p.known").alias("known"), F.col("p.hole").alias("hole"), F.col("p.hole_type").alias("hole_type"), F.col("p.date_part").alias("date_part"),
        F.col("p.qtype").alias("qtype"), strings.verb_gender(F.col("p.spoken")).alias("gender"), (F.col("cop").isNotNull() & F.col("p.rule").isin("kin", "verb", "copula", "card-copula")).alias("is_copula"), F.col("p.novelty").alias("novelty"),
        F.col("p.predicate_class").alias("predicate_class"), F.when(F.col("p.rule").isin("exists", "verb", "kin", "copula"), F.col("place")).alias("place"), F.when(F.col("p.rule").isin("kin", "verb", "copula"), topic).otherwise(F.array().cast("array<string>")).alias("topic"),
    )


def asked_by(card: Card, t: Column, questions: Column, parts: Column, words: QuestionWords) -> Column:
    """What a line asks that the card fits, null if something that the card wants isn't there."""
    literal = lambda x: F.lit(x).cast("string")

    def told(bounds: Column) -> Column:
        start = lambda n: F.get(bounds, F.lit(n - 1))
        end = lambda n: F.get(bounds, F.lit(n))
        taken = lambda n: end(n) > start(n)
        token = lambda n: F.when(taken(n), F.get(t, start(n)))
        surface = lambda n: F.when(taken(n), text_of(t, start(n), end(n)))
        speaks = F.lit(True)
        role, kind, name = literal(None), literal(None), literal(None)
        if card.hole:
            entry = F.try_element_at(questions, token(card.hole)["norm"])
            role, kind, name = entry["role"], entry["type"], entry["name"]
            speaks = speaks & (~taken(card.hole) | entry.isNotNull())
        date = F.try_element_at(parts, token(card.date_part)["norm"]) if card.date_part else literal(None)
        by_date = date.isNotNull() & (role == "attr")
        role, kind = F.when(by_date, "time").otherwise(role), F.when(by_date, "time").otherwise(kind)
        of_class = F.try_element_at(mapping(words.event_classes), token(card.of_class)["norm"]) if card.of_class else literal(None)
        if card.of_class:
            speaks = speaks & (~taken(card.of_class) | of_class.isNotNull())
        if card.copula:
            role = F.when(taken(card.copula) & ~F.coalesce(role == "attr", F.lit(False)), "pred").otherwise(role)
        if card.role:
            role, kind = literal(card.role), literal(card.type)
        if isinstance(card.predicate, int):
            predicate = token(card.predicate)["any_verb"]
            speaks = speaks & predicate.isNotNull()
        else:
            predicate = literal(card.predicate)
            if card.predicate is None:
                speaks = speaks & (role.isNotNull() | of_class.isNotNull())
        default = F.when(role == "subj", "obj").otherwise("subj")
        known = [F.when(taken(n), F.struct((literal(r) if r else default).alias("role"), surface(n).alias("text"), literal(None).alias("predicate"), literal(None).alias("object"))) for r, n in card.known]
        if card.user_subject:
            known.append(F.struct(literal("subj").alias("role"), literal(words.user).alias("text"), literal(None).alias("predicate"), literal(None).alias("object")))
        spoken = F.coalesce(*([surface(card.copula)] if card.copula else []), *([surface(card.predicate)] if isinstance(card.predicate, int) else []), literal(None))
        return F.when(
            speaks,
            F.struct(
                literal("card-copula" if card.copula else "card").alias("rule"), literal(card.name).alias("card"), predicate.alias("predicate"), F.array_compact(F.array(*known)).cast(KNOWN).alias("known"), role.alias("hole"), kind.alias("hole_type"), date.alias("date_part"),
                name.alias("qtype"), spoken.alias("spoken"), (taken(card.novelty) if card.novelty else F.lit(False)).alias("novelty"), of_class.alias("predicate_class"),
            ),
        )

    return let(captures(card.pattern, t, F.col("spans")), told)
