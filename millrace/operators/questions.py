"""Questions made from sentences, and answers picked from annotated passages by the kind of the question."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fixed, strings
from millrace.operators.annotations import KEY

SUBJECTS = ("nsubj", "nsubj:pass")
OBJECTS = ("obj", "iobj")
NO_OBJECT = ("PRON", "DET", "CCONJ", "SCONJ", "PART", "PUNCT", "ADP", "AUX")
MODIFIERS = ("amod", "nmod", "flat", "compound", "appos")


# Questions from sentences


def answer_spans(entities: DataFrame, tokens: DataFrame, most: int = 3, kinds: Mapping[str, str] = fixed.QUESTION_OF) -> DataFrame:
    """doc_id, sent, answer, qtype, start, end: entities by their kind, then numbers, in order; the first `most` of each
    sentence, each span once. A span that is the whole sentence has no question."""
    qtype = F.lit(None).cast("string")
    for letter, word in kinds.items():
        qtype = F.when(F.lower(F.substring("type", 1, 1)) == letter, word).otherwise(qtype)
    named = entities.select(*KEY, F.col("text").alias("answer"), qtype.alias("qtype"), "start", "end", F.lit(0).alias("part")).where("qtype IS NOT NULL")
    numbers = tokens.where("upos = 'NUM'").select(*KEY, F.col("form").alias("answer"), F.lit("Kolik").alias("qtype"), "start", "end", F.lit(1).alias("part"))
    every = named.unionByName(numbers)
    once = every.groupBy(*KEY, "answer", "start").agg(F.min_by(F.struct("part", "qtype", "end"), F.struct("part", "end")).alias("x"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("part", "start", "answer"))
    return once.select(*KEY, "answer", "start", "x.part", "x.qtype", "x.end").withColumn("rank", rank).where(F.col("rank") <= most).drop("rank", "part")


def built_question(sentence: Column, start: Column, end: Column, qtype: Column) -> Column:
    """The question word, then the sentence without its answer, in small letters at its beginning and without end marks."""
    rest = F.concat(F.substring(sentence, F.lit(1), start), F.lit(" "), F.substring(sentence, end + 1, F.length(sentence)))
    rest = F.btrim(F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"[ .!?,;:]+$", ""))
    rest = F.concat(F.lower(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))
    return F.btrim(F.regexp_replace(F.concat(qtype, F.lit(" "), rest, F.lit("?")), r"\s+", " "))


def acceptable(question: Column, answer: Column) -> Column:
    """Whether a pair is worth keeping: no fragment as answer, no mark after the question word, at least two words with
    letters, and at least half of them."""
    short = F.btrim(answer)
    body = F.btrim(F.regexp_replace(F.regexp_extract(question, r"^[^ ]* (.*)$", 1), r"\?+$", ""))
    words = strings.words(body)
    lettered = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    whole = (F.length(short) >= 2) | short.rlike("^[0-9]$")
    return whole & (body != "") & ~body.rlike(r"^[,.;:)–—…!?-]") & (lettered >= 2) & (2 * lettered >= F.size(words))


def question_pairs(sentences: DataFrame, spans: DataFrame, least: int = 4, most: int = 30) -> DataFrame:
    """doc_id, sent, question, answer, qtype, context: the acceptable pairs of sentences of `least` to `most` words, each
    once in a document (from its first sentence). sentences: doc_id, sent, line."""
    sized = sentences.withColumn("n", F.size(strings.words(F.col("line")))).where(F.col("n").between(least, most))
    made = spans.join(sized, KEY).where("btrim(answer) <> btrim(line)").withColumn("question", built_question(F.col("line"), F.col("start"), F.col("end"), F.col("qtype")))
    good = made.where(acceptable(F.col("question"), F.col("answer")))
    once = F.row_number().over(Window.partitionBy("doc_id", "question", "answer").orderBy("sent", "start"))
    return good.withColumn("rank", once).where("rank = 1").select(*KEY, "question", "answer", "qtype", F.col("line").alias("context"))


# Answers from passages


def first_of(rows: DataFrame, key: Sequence[str], order: Sequence[Column], *columns: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rank", rank).where("rank = 1").select(*key, *columns)


def subject_persons(tokens: DataFrame, entities: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, idx, answer: of a passage's persons the one that is subject of the question's verb, else any subject, else the
    first. tokens, entities: of passages (doc_id, idx, sent, ..); asked: doc_id, idx, verb."""
    key = ["doc_id", "idx"]
    persons = entities.where(F.lower("type").startswith("p")).select(*key, "sent", "text", F.col("start").alias("from"), F.col("end").alias("to"))
    subjects = tokens.where(F.col("deprel").isin(*SUBJECTS)).select(*key, "sent", "start", "end", "head")
    verbs = tokens.select(*key, "sent", F.col("pos").alias("head"), strings.clean_lemma(F.col("lemma")).alias("lemma"))
    lit = persons.join(subjects, [*key, "sent"]).where("`from` <= start AND end <= `to`").join(verbs, [*key, "sent", "head"], "left")
    rows = lit.select(*key, "sent", "text", "from", "lemma", F.lit(1).alias("tier")).unionByName(persons.select(*key, "sent", "text", "from", F.lit(None).cast("string").alias("lemma"), F.lit(2).alias("tier")))
    tiered = rows.join(asked.select(*key, "verb"), key).withColumn("tier", F.when(F.col("lemma") == F.col("verb"), 0).otherwise(F.col("tier")))
    return first_of(tiered, key, [F.col("tier"), F.col("sent"), F.col("from"), F.col("text")], "text").withColumnRenamed("text", "answer")


def objects(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, idx, answer: the object of the question's verb, else the first object; no pronouns or particles."""
    key = ["doc_id", "idx"]
    rows = tokens.where(F.col("deprel").isin(*OBJECTS) & ~F.col("upos").isin(*NO_OBJECT)).select(*key, "sent", "pos", "form", "head")
    verbs = tokens.select(*key, "sent", F.col("pos").alias("head"), strings.clean_lemma(F.col("lemma")).alias("lemma"))
    tiered = rows.join(verbs, [*key, "sent", "head"], "left").join(asked.select(*key, "verb"), key).withColumn("tier", F.when(F.col("lemma") == F.col("verb"), 0).otherwise(1))
    return first_of(tiered, key, [F.col("tier"), F.col("sent"), F.col("pos")], "form").withColumnRenamed("form", "answer")


def first_entities(entities: DataFrame, letter: str) -> DataFrame:
    rows = entities.where(F.lower("type").startswith(letter))
    return first_of(rows, ["doc_id", "idx"], [F.col("sent"), F.col("start"), F.col("text")], "text").withColumnRenamed("text", "answer")


def first_numbers(tokens: DataFrame) -> DataFrame:
    return first_of(tokens.where("upos = 'NUM'"), ["doc_id", "idx"], [F.col("sent"), F.col("pos")], "form").withColumnRenamed("form", "answer")


def predicates(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, idx, answer: what the first copula says of a subject that the question is about, with its modifiers.

    asked: doc_id, idx, topic (array of small letters; empty: any subject will do)."""
    key = ["doc_id", "idx"]
    at = [*key, "sent"]
    cop = tokens.where("deprel = 'cop'").select(*at, F.col("head").alias("pos")).distinct()
    who = tokens.where(F.col("deprel").isin(*SUBJECTS)).select(*at, F.col("head").alias("pos"), F.array(F.lower(strings.clean_lemma(F.col("lemma"))), F.lower("form")).alias("names"))
    rows = cop.join(tokens.select(*at, "pos", "form"), [*at, "pos"]).join(asked.select(*key, "topic"), key).join(who, [*at, "pos"], "left")
    fit = rows.where((F.size("topic") == 0) | F.coalesce(F.arrays_overlap("names", "topic"), F.lit(False))).select(*at, "pos", "form").distinct()
    more = tokens.where(F.col("deprel").isin(*MODIFIERS)).select(*at, F.col("head").alias("pos"), F.struct(F.col("pos").alias("place"), F.col("form").alias("word")).alias("part"))
    own = fit.select(*at, "pos", F.struct(F.col("pos").alias("place"), F.col("form").alias("word")).alias("part"))
    whole = own.unionByName(more.join(fit.select(*at, "pos"), [*at, "pos"], "left_semi")).groupBy(*at, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["word"]), " ").alias("answer"))
    return first_of(whole, key, [F.col("sent"), F.col("pos")], "answer")


def select_answers(tokens: DataFrame, entities: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, idx, qtype, answer: each passage's answer by the kind of its question; passages without one are missing.

    asked: doc_id, idx, qtype, verb, copula (boolean), topic. Kinds that nothing fits have no answer."""
    defines = F.col("copula") | F.col("qtype").isin("Jaký", "Který")
    by = {"Kdo": lambda a: subject_persons(tokens, entities, a), "Čí": lambda a: subject_persons(tokens, entities, a), "Co": lambda a: objects(tokens, a), "Kde": lambda _: first_entities(entities, "g"), "Kdy": lambda _: first_entities(entities, "t"), "Kolik": lambda _: first_numbers(tokens)}
    out = predicates(tokens, asked.where(defines)).join(asked.where(defines).select("doc_id", "idx", "qtype"), ["doc_id", "idx"])
    for qtype, pick in by.items():
        part = asked.where(~defines & (F.col("qtype") == qtype))
        out = out.unionByName(pick(part).join(part.select("doc_id", "idx", "qtype"), ["doc_id", "idx"]), allowMissingColumns=False)
    return out.select("doc_id", "idx", "qtype", "answer")


def nominative(phrases: DataFrame, morphology: DataFrame) -> DataFrame:
    """key, phrase -> key, said: each word by its form in the first case, words without one as they stand.

    morphology: form, nominative (one row per form)."""
    words = phrases.select("key", F.posexplode(strings.words(F.col("phrase"))).alias("at", "form"))
    turned = words.join(morphology.select("form", "nominative"), "form", "left").select("key", F.struct("at", F.coalesce("nominative", "form").alias("word")).alias("x"))
    return turned.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["word"]), " ").alias("said"))


def answer_case(qtype: Column, cases: Mapping[str, str | None] = fixed.ANSWER_CASE) -> Column:
    out = F.lit(None).cast("string")
    for word, case in cases.items():
        out = F.when(qtype == word, F.lit(case).cast("string")).otherwise(out)
    return out


def template_answers(ranked: DataFrame, picked: DataFrame, said: DataFrame, fallback: DataFrame) -> DataFrame:
    """question, answer, doc_id, idx: the first passage in rank with an answer that isn't blank; else the fallback.

    ranked: question, doc_id, idx, rank; picked: doc_id, idx, qtype, answer; said: key (the answer), said (in the first
    case); fallback: question, answer."""
    rows = ranked.join(picked, ["doc_id", "idx"]).join(said.withColumnRenamed("key", "answer"), "answer", "left")
    filled = rows.withColumn("text", F.when(answer_case(F.col("qtype")) == "1", F.coalesce("said", "answer")).otherwise(F.col("answer"))).where("btrim(text) <> ''")
    best = first_of(filled, ["question"], [F.col("rank"), F.col("doc_id"), F.col("idx")], "text", "doc_id", "idx")
    return fallback.join(best, "question", "left").select("question", F.coalesce("text", "answer").alias("answer"), "doc_id", "idx")
