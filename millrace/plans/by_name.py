"""The library's functions by name, for SQL: plain and table functions, whose bodies Catalyst inlines into the query."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.functions import fixed, strings
from millrace.operators import text


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """name: what follows it in CREATE FUNCTION."""
    marked, plain = strings.accent_table()
    endings, least = "|".join(fixed.SUFFIXES), fixed.MIN_STEM
    cut = f"regexp_replace(lower(word), {quoted(f'^(.{{{least},}}?)(?:{endings})$')}, '$1')"
    short = f"translate({cut}, {quoted(fixed.LONG_VOWELS)}, {quoted(fixed.SHORT_VOWELS)})"
    fleeting = quoted(f"^(.+){fixed.FLEETING_VOWEL}([^{fixed.VOWELS}])$")
    ends = f"split(regexp_replace(coalesce(body, ''), {quoted(text.boundary())}, {quoted('$1' + text.MARK)}), {quoted(text.MARK)})"
    trimmed = "regexp_replace(x, '^\\\\s+|\\\\s+$', '')"
    return {
        "fold_accents": f"(body STRING) RETURNS STRING RETURN regexp_replace(translate(lower(body), {quoted(marked)}, {quoted(plain)}), '\\\\p{{M}}+', '')",
        "stem": f"(word STRING) RETURNS STRING RETURN CASE WHEN length({short}) >= {max(least, 2)} THEN regexp_replace({short}, {fleeting}, '$1$2') ELSE {short} END",
        "sentences_of": f"(body STRING) RETURNS TABLE(sent_idx INT, sentence STRING) RETURN SELECT pos, col FROM (SELECT posexplode(filter(transform({ends}, x -> {trimmed}), x -> x <> '')))",
        "words_of": f"(body STRING) RETURNS TABLE(pos INT, word STRING) RETURN SELECT pos, col FROM (SELECT posexplode(regexp_extract_all(lower(coalesce(body, '')), {quoted(strings.WORD)}, 0)))",
        "passages_of": f"(body STRING, size INT, step INT) RETURNS TABLE(idx INT, passage STRING) RETURN SELECT CAST(i AS INT), array_join(slice(s, CAST(i * step + 1 AS INT), size), ' ') FROM (SELECT s, explode(sequence(0, greatest(CAST(ceil((size(s) - size) / step) AS INT), 0))) AS i FROM (SELECT filter(transform({ends}, x -> {trimmed}), x -> x <> '') AS s) WHERE size(s) > 0)",
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL, and returns their names."""
    found = definitions()
    for name, body in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(found)
