"""Places: the keys that a name's cases share, what lies in what, and what a statement teaches about it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fixed, strings
from millrace.operators.matching import containment


def place_key(name: Column) -> Column:
    return strings.fold_accents(strings.stem(F.trim(F.lower(name))))


def key_variants(name: Column, fold: Mapping[str, str] = fixed.PALATAL_FOLD) -> Column:
    """array of keys, sorted: the stem; without a locative -ich; with a fleeting e; each of these stemmed once more (four
    letters left at least); and with the last consonant unfolded."""
    base = place_key(name)
    none = F.lit(None).cast("string")
    short = F.when((F.length(base) > 5) & base.endswith("ich"), F.regexp_replace(base, "ich$", ""))
    fleeting = F.when(base.rlike("[^aeiouy][^aeiouy]$"), F.regexp_replace(base, "(.)$", "e$1"))
    firsts = F.array_compact(F.array(base, short, fleeting))

    def again(key: Column) -> Column:
        cut = strings.fold_accents(strings.stem(key))
        return F.when((cut != key) & (F.length(cut) >= 4), cut).otherwise(none)

    more = F.array_union(firsts, F.array_compact(F.transform(firsts, again)))

    def unfolded(key: Column) -> Column:
        out = none
        for letter, other in fold.items():
            out = F.when(key.endswith(letter), F.concat(F.regexp_replace(key, ".$", ""), F.lit(other))).otherwise(out)
        return out

    every = F.array_union(more, F.array_compact(F.transform(more, unfolded)))
    return F.array_sort(F.filter(every, lambda k: k != ""))


def parents_of(gazetteer: DataFrame) -> DataFrame:
    """child, parent as keys, from rows of names (child, parent, line); the last line of a child holds."""
    keyed = gazetteer.select(place_key(F.col("child")).alias("child"), place_key(F.col("parent")).alias("parent"), "line")
    return keyed.groupBy("child").agg(F.max_by("parent", "line").alias("parent"))


def area_keys(parents: DataFrame) -> DataFrame:
    """key: every place that lies in one or holds one."""
    return parents.select(F.col("child").alias("key")).unionByName(parents.select(F.col("parent").alias("key"))).distinct()


def is_place(words: DataFrame, places: DataFrame) -> DataFrame:
    """words (lemma) that are places (lemma)."""
    return words.join(places.select("lemma").distinct(), "lemma", "left_semi")


def learn(parents: DataFrame, said: DataFrame) -> DataFrame:
    """child, parent: what statements (inner, outer, seq) teach beyond what is known. A pair that is known the other way
    round is turned; what a place is known to lie in stays; the first statement about a new place holds.

    Statements are judged against what was known before them, all at once."""
    known = containment(parents.select("child", "parent"))
    keyed = said.select(place_key(F.col("inner")).alias("a"), place_key(F.col("outer")).alias("b"), "seq")
    turned = keyed.join(known.where("hops > 0").select(F.col("child").alias("b"), F.col("ancestor").alias("a"), F.lit(True).alias("turned")).distinct(), ["a", "b"], "left")
    child, parent = F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b"))
    pairs = turned.select(child.alias("child"), parent.alias("parent"), "seq").where("child <> '' AND parent <> '' AND child <> parent")
    new = pairs.join(parents.select("child").distinct(), "child", "left_anti")
    return new.groupBy("child").agg(F.min_by("parent", "seq").alias("parent"))
