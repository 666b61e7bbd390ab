"""Cleaning, sentences and passages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import fixed

MARK = "\x01"


def once_each(rows: DataFrame, keys: Sequence[str], name: str, made: Column) -> DataFrame:
    """rows with made as a further column, worked out once for each different value of the keys, which are all that it reads."""
    told = rows.select(*keys).distinct().select(*(F.col(key).alias(f"{key}__of") for key in keys), made.alias(name))
    same = [F.col(key).eqNullSafe(F.col(f"{key}__of")) for key in keys]
    return rows.join(told, same, "left").drop(*(f"{key}__of" for key in keys))


def without_envelope(text: Column) -> Column:
    """What lies between the start and end marks of a licence envelope."""
    opened = F.regexp_replace(text, fixed.ENVELOPE_START, "")
    return F.regexp_replace(opened, fixed.ENVELOPE_END, "")


def without_apparatus(text: Column, headings: Sequence[str] = fixed.REFERENCE_HEADINGS) -> Column:
    """Without headings, and without all from the first heading of a reference section on."""
    lines = F.split(text, "\n", -1)
    title = lambda x: F.lower(F.trim(F.regexp_extract(x, fixed.HEADING, 1)))
    first = F.array_position(F.transform(lines, lambda x: x.rlike(fixed.HEADING) & title(x).isin(*headings)), True)
    kept = F.when(first > 0, F.slice(lines, F.lit(1), (first - 1).cast("int"))).otherwise(lines)
    return F.array_join(F.filter(kept, lambda x: ~x.rlike(fixed.HEADING)), "\n")


def clean_text(raw: Column) -> Column:
    text = F.replace(F.replace(without_envelope(raw), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(without_apparatus(text), fixed.DATE_RANGE, "")
    for pattern, by in ((r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def boundary() -> str:
    """The pattern of a sentence's end, its mark being the first group."""
    abbreviations = "|".join(fixed.ABBREVIATIONS)
    after_word = rf"(?<!(?<![\p{{L}}\p{{N}}])(?iu:{abbreviations})[.!?…])"
    after_number = r"(?<!(?<![\p{L}\p{N}])\p{Nd}{1,18}[.!?…])"
    return rf"([.!?…]){after_word}(?:{after_number}\s++|\s++(?!\p{{Ll}}))"


def sentences(text: Column) -> Column:
    """The sentences of a text: they end at . ! ? or … before white space, but not after an abbreviation, nor after a
    number that a small letter follows."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), boundary(), f"$1{MARK}"), MARK)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def explode_sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sent_idx, text."""
    return docs.select("doc_id", F.posexplode(sentences(F.col(text))).alias("sent_idx", "text"))


def with_offsets(sentence_rows: DataFrame) -> DataFrame:
    """Adds start: the place of a sentence in its document, sentences being joined by one character."""
    before = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    return sentence_rows.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def chunk(docs: DataFrame, units: Column, size: int = 3, overlap: int = 1, joiner: str = " ") -> DataFrame:
    """Windows of size units, each starting size - overlap after the one before; none that adds nothing.

    docs: doc_id. Returns doc_id, idx, text, start, end (exclusive)."""
    step = size - min(overlap, size - 1)
    cut = docs.select("doc_id", units.alias("units")).where(F.size("units") > 0)
    last = F.greatest(F.ceil((F.size("units") - size) / F.lit(step)).cast("int"), F.lit(0))
    placed = cut.select("doc_id", "units", F.explode(F.sequence(F.lit(0), last)).alias("idx")).withColumn("start", F.col("idx") * step)
    end = F.least(F.col("start") + size, F.size("units"))
    return placed.select("doc_id", "idx", F.array_join(F.slice("units", F.col("start") + 1, end - F.col("start")), joiner).alias("text"), "start", end.alias("end"))


def batch_paragraphs(text: Column, limit: int = 40_000) -> Column:
    """Paragraphs packed in order into parts of at most limit characters; a longer paragraph is a part of its own."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n\n")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + F.length(x) + 2 <= limit)
        return F.when(fits, F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.concat(last, F.lit("\n\n"), x))).otherwise(F.array_append(acc, x))

    return F.aggregate(parts, F.array().cast("array<string>"), add)
