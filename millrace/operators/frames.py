"""Frames of the second engine: role keys, factuality, question templates, matches by role, biographies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.annotations import KEY


def possessive_base(lemma: Column, upos: Column, possessive: Column, suffixes: Sequence[str], vowels: str = "aeiouyáéíóúýěů") -> Column:
    """A possessive adjective's name: without its suffix, an e before the last of two consonants. Others as they are."""
    out = lemma
    letter = r"[\p{L}&&[^" + vowels + "]]"
    for suffix in reversed(suffixes):
        cut = F.substring(lemma, F.lit(1), F.length(lemma) - len(suffix))
        stem = F.when((F.length(cut) >= 3) & F.lower(cut).rlike(f"{letter}{letter}$"), F.regexp_replace(cut, "(.)$", "e$1")).otherwise(cut)
        out = F.when(lemma.endswith(suffix) & (F.length(lemma) > len(suffix) + 1), stem).otherwise(out)
    return F.when((upos == "ADJ") & F.coalesce(possessive, F.lit(False)), out).otherwise(lemma)


def role_keys(tokens: DataFrame, by_relation: Mapping[str, Mapping[str, str]], by_preposition: Mapping[str, str]) -> DataFrame:
    """tokens with role: state for what a copula says; by the preposition if it decides; else by the relation, where a
    subject's role depends on whether it lives (proper nouns do) and others' on the case.

    by_relation: relation -> case (or anim, inanim) -> role, with default; by_preposition: preposition -> role."""
    cop = tokens.where("deprel = 'cop'").select(*KEY, F.col("head").alias("pos")).distinct().withColumn("said", F.lit(True))
    led = tokens.where("deprel = 'case'").groupBy(*KEY, F.col("head").alias("at")).agg(F.min_by("lemma", "pos").alias("prep")).withColumnRenamed("at", "pos")
    rows = tokens.join(cop, [*KEY, "pos"], "left").join(led, [*KEY, "pos"], "left")
    table = F.lit(None).cast("string")
    for relation, cases in by_relation.items():
        if "anim" in cases:
            value = F.when(F.col("upos") == "PROPN", cases["anim"]).otherwise(cases["inanim"])
        else:
            value = F.lit(cases["default"])
            for case, role in cases.items():
                if case != "default":
                    value = F.when(F.col("kase") == case, role).otherwise(value)
        table = F.when(F.col("deprel") == relation, value).otherwise(table)
    over = F.lit(None).cast("string")
    for word, role in by_preposition.items():
        over = F.when(F.col("prep") == word, role).otherwise(over)
    return rows.withColumn("role", F.when(F.col("said"), "state").otherwise(F.coalesce(over, table))).drop("said", "prep")


def factual(tokens: DataFrame, hedges: Sequence[str], conditionals: Sequence[str]) -> DataFrame:
    """doc_id, sent: sentences that are no questions and hold no hedge and no conditional."""
    bad = (F.col("form") == "?") | F.lower("lemma").isin(*hedges) | F.lower("form").isin(*conditionals)
    return tokens.groupBy(*KEY).agg(F.bool_or(bad).alias("bad")).where("NOT bad").select(*KEY)


def question_signature(signature: Column, role: Column, slots: Mapping[str, str], radius: int = 2, joiner: str = "·") -> Column:
    """A fact's frame as that of its question: the pivot becomes the question word's slot, the end mark a question mark; null
    for roles without a question word and for frames that are too short."""
    parts = F.split(signature, joiner, -1)
    slot = F.lit(None).cast("string")
    for name, value in slots.items():
        slot = F.when(role == name, value).otherwise(slot)
    turned = F.transform(parts, lambda x, i: F.when(i == radius, slot).when(i == F.size(parts) - 1, F.lit("?")).otherwise(x))
    return F.when(slot.isNotNull() & (F.size(parts) >= radius + 2), F.array_join(turned, joiner))


def completeness(essential: DataFrame, asked: DataFrame) -> DataFrame:
    """fact, covered, missing, complete. essential, asked: fact, role."""
    must = essential.groupBy("fact").agg(F.array_sort(F.collect_set("role")).alias("must"))
    got = asked.where("role IS NOT NULL").groupBy("fact").agg(F.collect_set("role").alias("got"))
    held = must.join(got, "fact", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    return held.select("fact", F.array_sort(F.array_intersect("must", "got")).alias("covered"), F.array_sort(F.array_except("must", "got")).alias("missing")).withColumn("complete", F.size("missing") == 0)


def match_role(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """question, lemma, doc, sent: what stands in the asked role of facts with the asked predicate. facts: predicate, roles
    (map of arrays), doc, sent; asked: question, predicate, hole."""
    rows = facts.select("predicate", "doc", "sent", F.explode("roles").alias("hole", "lemmas"))
    return rows.join(asked, ["predicate", "hole"]).select("question", F.explode("lemmas").alias("lemma"), "doc", "sent")


def lives(tokens: DataFrame, born: str = "narodit", died: str = "zemřít", start: int = 6) -> DataFrame:
    """doc_id, sent, predicate, who, year: from the first brackets after a person's name near the sentence's beginning; what
    stands before a dash is the birth, what stands after it the death."""
    person = tokens.where(f"upos = 'PROPN' AND pos <= {start}").groupBy(*KEY).agg(F.min_by("lemma", "pos").alias("who"))
    opens = tokens.where("form = '('").groupBy(*KEY).agg(F.min("pos").alias("a"))
    closes = tokens.where("form = ')'").select(*KEY, "pos").join(opens, KEY).where("pos > a").groupBy(*KEY).agg(F.min("pos").alias("b"))
    inner = tokens.join(opens, KEY).join(closes, KEY).where("pos > a AND pos < b")
    dash = F.min(F.when(F.col("form").isin("–", "—"), F.col("pos"))).over(Window.partitionBy(*KEY))
    half = F.when(dash.isNotNull() & (F.col("pos") > dash), died).otherwise(born)
    years = inner.withColumn("predicate", half).where(F.col("form").rlike("^[0-9]{4}$")).groupBy(*KEY, "predicate").agg(F.min_by("form", "pos").alias("year"))
    return years.join(person, KEY).select(*KEY, "predicate", "who", F.col("year").cast("int").alias("year"))


def kinship(rows: DataFrame, symmetric: Sequence[str]) -> DataFrame:
    """a, relation, b: what was read, and the other way round for relations that hold both ways."""
    back = rows.where(F.col("relation").isin(*symmetric)).select(F.col("b").alias("a"), "relation", F.col("a").alias("b"))
    return rows.select("a", "relation", "b").unionByName(back).distinct()


def training_pairs(templates: DataFrame, candidates: DataFrame) -> DataFrame:
    """question, value, label: each candidate of a question, 1 where it is the template's answer. templates: question, answer;
    candidates: question, value."""
    return candidates.join(templates, "question").select("question", "value", (F.col("value") == F.col("answer")).cast("int").alias("label"))


def remerge(sentences: DataFrame, lengths: DataFrame) -> DataFrame:
    """doc_id, part, text: annotated sentences joined back to the parts that they were cut from; lengths: doc_id, part, n
    (characters without blanks). A part takes sentences until its own length is reached."""
    size = F.length(F.regexp_replace("line", r"\s", ""))
    order = Window.partitionBy("doc_id").orderBy("sent")
    placed = sentences.withColumn("n", size).withColumn("upto", F.sum("n").over(order))
    ends = lengths.withColumn("stop", F.sum("n").over(Window.partitionBy("doc_id").orderBy("part"))).withColumn("start", F.col("stop") - F.col("n")).select("doc_id", "part", "start", "stop")
    joined = placed.join(ends, "doc_id").where("upto > start AND upto <= stop")
    held = F.array_sort(F.collect_list(F.struct("sent", "line")))
    return joined.groupBy("doc_id", "part").agg(F.array_join(F.transform(held, lambda x: x["line"]), " ").alias("text"))


def inherited_roles(tokens: DataFrame) -> DataFrame:
    """tokens (with role) in which what is coordinated takes the role of the word it is coordinated with, that of its own
    head's chain; words that lead to no role have none. The chain is followed on the sentence's array of heads."""
    held = F.array_sort(F.collect_list(F.struct("pos", "head", (F.col("deprel") == "conj").alias("conj"), "role")))
    trees = tokens.groupBy(*KEY).agg(held.alias("tree"))
    at = lambda xs, j: F.get(xs, j - 1)
    trees = trees.select(*KEY, F.transform("tree", lambda x: F.when(x["conj"] & (x["head"] > 0), x["head"]).otherwise(x["pos"])).alias("up"), F.transform("tree", lambda x: F.when(~x["conj"], x["role"])).alias("roles"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("up"))).cast("int"))
    ends = F.aggregate(rounds, F.col("up"), lambda up, _: F.transform(up, lambda j: at(up, j)))
    found = trees.withColumn("ends", ends).select(*KEY, "roles", F.posexplode("ends").alias("place", "end")).select(*KEY, (F.col("place") + 1).alias("pos"), at(F.col("roles"), F.col("end")).alias("role"))
    return tokens.drop("role").join(found, [*KEY, "pos"])


def registry(tokens: DataFrame) -> DataFrame:
    """doc_id, sent, predicate, answers (array of role, lemma), context (lemmas of other words of content): a sentence's root
    verb with what can be asked about it. tokens: with role."""
    roots = tokens.where("head = 0 AND upos = 'VERB'").select(*KEY, F.col("lemma").alias("predicate"))
    answers = F.array_sort(F.collect_set(F.when(F.col("role").isNotNull() & (F.col("head") > 0), F.struct("role", "lemma"))))
    other = F.array_sort(F.collect_set(F.when(F.col("role").isNull() & F.col("upos").isin("NOUN", "PROPN", "VERB", "ADJ"), F.col("lemma"))))
    return tokens.join(roots, KEY).groupBy(*KEY, "predicate").agg(answers.alias("answers"), other.alias("context")).where(F.size("answers") > 0)


def fact_store(slots: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """predicate, roles (map of arrays), doc, sent: slots (doc, sent, predicate, role, lemma) gathered into facts, with those of
    other readers (more) beside them."""
    every = slots if more is None else slots.unionByName(more)
    by_role = every.groupBy("doc", "sent", "predicate", "role").agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "lemmas"))))
    return by_role.groupBy("doc", "sent", "predicate").agg(held.alias("roles")).select("predicate", "roles", "doc", "sent")


def weighted_index(tokens: DataFrame, least: int = 2) -> DataFrame:
    """doc_id, lemma, weight: tf * (ln(documents / df) + 1) of lemmas of two letters or more that a document has `least` times,
    of unit length per document; marks are left out."""
    counted = tokens.where("upos <> 'PUNCT' AND length(lemma) > 1").groupBy("doc_id", "lemma").agg(F.count("*").alias("tf"))
    n = tokens.agg(F.count_distinct("doc_id").alias("n"))
    idf = counted.groupBy("lemma").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("lemma", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"))
    raw = counted.where(F.col("tf") >= least).join(idf, "lemma").select("doc_id", "lemma", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "lemma", (F.col("w") / F.col("norm")).alias("weight"))
