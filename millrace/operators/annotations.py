"""Annotated sentences as tables: tokens (doc_id, sent, pos, form, lemma, upos, kase, head, deprel, start, end) and entities
(doc_id, sent, text, type, start, end). pos and head count from 1 within the sentence; head 0 is the root.

Everything is keyed by sentence, so work is spread by (doc_id, sent) and nothing larger than a sentence is gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["doc_id", "sent"]
#: At least two letters with a point after each.
DOTTED = r"(?:\p{L}\.){2,}"


def merge_abbreviations(tokens: DataFrame) -> DataFrame:
    """Runs of at least two adjoining pairs of a letter and a point become one proper noun.

    The new token keeps the first letter's head and relation and covers the whole run; places and heads of the sentence
    are numbered anew."""
    order = Window.partitionBy(*KEY).orderBy("pos")
    back = lambda x, n=1: F.lag(x, n).over(order)
    pair = F.col("form").rlike(r"^\p{L}$") & (F.lead("form").over(order) == ".") & (F.lead("start").over(order) == F.col("end"))
    rows = tokens.withColumn("pair", F.coalesce(pair, F.lit(False)))
    goes_on = F.coalesce(F.col("pair") & back("pair", 2) & (back("end") == F.col("start")), F.lit(False))
    rows = rows.withColumn("opens", F.col("pair") & ~goes_on).withColumn("held", F.col("pair") | F.coalesce(back("pair"), F.lit(False)))
    rows = rows.withColumn("run", F.when(F.col("held"), F.sum(F.col("opens").cast("int")).over(order)))
    run = Window.partitionBy(*KEY, "run")
    rows = rows.withColumn("long", F.col("held") & (F.sum(F.col("pair").cast("int")).over(run) >= 2))
    inside = run.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.array_join(F.collect_list("form").over(inside), "")
    rows = rows.withColumns({"whole": F.when(F.col("long"), whole), "last": F.max("end").over(run), "kept": ~F.col("long") | F.col("opens")})
    rows = rows.withColumn("place", F.sum(F.col("kept").cast("int")).over(order))
    heads = rows.select(*KEY, F.col("pos").alias("head"), F.col("place").alias("new_head"))
    merged = rows.where("kept").join(heads, [*KEY, "head"], "left")
    return merged.select(
        *KEY, F.col("place").cast("int").alias("pos"), F.coalesce("whole", "form").alias("form"), F.coalesce("whole", "lemma").alias("lemma"), F.when(F.col("long"), "PROPN").otherwise(F.col("upos")).alias("upos"),
        "kase", F.coalesce(F.col("new_head").cast("int"), "head").alias("head"), "deprel", "start", F.when(F.col("long"), F.col("last")).otherwise(F.col("end")).alias("end"),
    )


def dotted_spans(text: Column) -> Column:
    """array of (start, end, text): the dotted abbreviations of a text, in code points."""
    found = F.regexp_extract_all(text, F.lit(DOTTED), F.lit(0))
    between = F.slice(F.split(text, DOTTED, -1), 1, F.size(found))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end"), x["found"].alias("text"))).alias("spans"))

    pairs = F.zip_with(between, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("found")))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def expand_to_abbreviations(entities: DataFrame, sentences: DataFrame) -> DataFrame:
    """Entities that overlap a dotted abbreviation take the whole of it; of those that then cover the same span the first
    stays. entities: with seq, their order in the sentence; sentences: doc_id, sent, line."""
    spans = sentences.select(*KEY, dotted_spans(F.col("line")).alias("spans"))
    joined = entities.join(spans, KEY, "left")
    other = F.filter("spans", lambda s: (F.col("start") < s["end"]) & (F.col("end") > s["start"]) & ((F.col("start") != s["start"]) | (F.col("end") != s["end"])))
    first = F.try_element_at(F.coalesce(other, F.array().cast("array<struct<start:int,end:int,text:string>>")), F.lit(1))
    wide = joined.withColumn("span", first).select(*KEY, "seq", F.coalesce("span.text", "text").alias("text"), "type", F.coalesce("span.start", "start").alias("start"), F.coalesce("span.end", "end").alias("end"))
    once = F.row_number().over(Window.partitionBy(*KEY, "start", "end").orderBy("seq"))
    return wide.withColumn("n", once).where("n = 1").drop("n")


def sentence_bases(sentences: DataFrame) -> DataFrame:
    """doc_id, sent, base: where each sentence begins if a document's sentences are joined by one character."""
    before = Window.partitionBy("doc_id").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    return sentences.select(*KEY, F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("base"))


def shifted(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """Tokens or entities with offsets in the document instead of in the sentence; missing offsets stay missing."""
    return items.join(sentence_bases(sentences), KEY).withColumns({"start": F.col("start") + F.col("base"), "end": F.col("end") + F.col("base")}).drop("base")


def annotate(texts: DataFrame, client: Callable[[], Callable[[str], list[dict]]], schema: str) -> DataFrame:
    """texts: key columns and text. A row per item that the client finds in a text, with the key columns.

    client makes the function that annotates; it is called once in each worker's partition, where it may load a model."""
    keys = [x for x in texts.columns if x != "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = client()
        for frame in frames:
            rows = [{**dict(zip(keys, key, strict=True)), **item} for *key, text in frame[[*keys, "text"]].itertuples(index=False) for item in work(text or "")]
            yield pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name in keys)
    whole = f"{kinds}, {schema}"
    names = [*keys, *(x.strip().split()[0].strip("`") for x in schema.split(","))]
    return texts.mapInPandas(run, whole)


def trim_case_mismatch(entities: DataFrame, tokens: DataFrame) -> DataFrame:
    """Persons end before their first token whose case differs from that of their first token with one."""
    within = tokens.where("kase IS NOT NULL").select(*KEY, F.col("start").alias("from"), F.col("end").alias("to"), "kase")
    persons = entities.where(F.lower("type").startswith("p"))
    covered = persons.join(within, KEY).where("start <= `from` AND `to` <= `end`")
    span = [*KEY, "text", "type", "start", "end"]
    first = covered.groupBy(*span).agg(F.min_by("kase", "from").alias("first_case"))
    off = covered.join(first, span).groupBy(*span).agg(F.min(F.when(F.col("kase") != F.col("first_case"), F.col("from"))).alias("off"), F.sort_array(F.collect_list(F.struct("from", "to"))).alias("places"))
    last = F.aggregate("places", F.lit(None).cast("bigint"), lambda acc, x: F.when(x["from"] < F.col("off"), x["to"].cast("bigint")).otherwise(acc))
    cut = off.where("off IS NOT NULL").select(*span, last.alias("cut"))
    trimmed = entities.join(cut, span, "left")
    text = F.when(F.col("cut").isNotNull(), F.trim(F.expr("substring(text, 1, CAST(cut - start AS INT))"))).otherwise(F.col("text"))
    return trimmed.select(*KEY, text.alias("text"), "type", "start", F.coalesce("cut", "end").alias("end"))


def passage_items(passages: DataFrame, items: DataFrame) -> DataFrame:
    """The tokens or entities of each passage's sentences; passages: doc_id, idx, first and stop (the sentence after the
    last). Passages without any are missing."""
    held = passages.select("doc_id", "idx", F.explode(F.sequence("first", F.col("stop") - 1)).alias("sent"))
    return held.join(items, KEY)
