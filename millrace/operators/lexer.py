"""Tokens with all the classes that they may have; nothing is decided here, patterns choose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import strings

EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"


def lex(text: Column) -> Column:
    """Words, addresses of mail, and dotted abbreviations; a point at a word's end is cut off."""
    raw = F.regexp_extract_all(text, F.lit(rf"{EMAIL}|[\p{{L}}\p{{N}}_.]+"), F.lit(0))
    cut = F.transform(raw, lambda t: F.when(t.rlike(f"^{EMAIL}$") | F.substring(t, F.lit(1), F.length(t) - 1).contains("."), t).otherwise(F.regexp_replace(t, r"\.+$", "")))
    return F.filter(cut, lambda t: t != "")


def classes(form: Column, tables: Mapping[str, Sequence[str]], endings: Mapping[str, tuple[int, Sequence[str]]], verb_bars: Sequence[str] = ()) -> Column:
    """array of classes, sorted: of the tables by the word without marks, and by rule: email, jmeno (a capital and letters
    only), l_tvar (an l-participle), and one for each entry of endings (least length, endings). sloveso_fin is only given to
    words of none of the classes in verb_bars."""
    norm = strings.fold_accents(form)
    low = F.lower(form)
    one = lambda name, test: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    found = [one(name, norm.isin(*words)) for name, words in tables.items() if words]
    found += [one("email", form.rlike(f"^{EMAIL}$")), one("jmeno", form.rlike(r"^\p{Lu}") & F.replace(form, F.lit("-"), F.lit("")).rlike(r"^\p{L}+$")), one("l_tvar", strings.participle_stem(form).isNotNull())]
    barred = F.lit(False)
    for name in verb_bars:
        if tables.get(name):
            barred = barred | norm.isin(*tables[name])
    for name, (least, tails) in endings.items():
        test = (F.length(form) >= least) & low.rlike(f"(?:{'|'.join(tails)})$")
        found.append(one(name, test & ~barred if name == "sloveso_fin" else test))
    return F.array_sort(F.array_compact(F.array(*found)))


def tagged(texts: DataFrame, key: str, tables: Mapping[str, Sequence[str]], endings: Mapping[str, tuple[int, Sequence[str]]] | None = None, verb_bars: Sequence[str] = ()) -> DataFrame:
    """key, pos, form, norm, classes."""
    forms = texts.select(key, F.posexplode(lex(F.col("text"))).alias("at", "form"))
    return forms.select(key, (F.col("at") + 1).alias("pos"), "form", strings.fold_accents(F.col("form")).alias("norm"), classes(F.col("form"), tables, endings or {}, verb_bars).alias("classes"))


def features(tokens: DataFrame, key: str) -> DataFrame:
    """key, features: what a statement's tokens say of its kind. An address of mail puts out all that words say but the first
    person."""
    has = lambda name: F.bool_or(F.array_contains("classes", name))
    finite = F.min(F.when(F.array_contains("classes", "sloveso_fin"), F.struct("pos", "form")))
    past = F.bool_or(F.array_contains("classes", "l_tvar") & F.col("form").rlike(r"^\p{Ll}"))
    first = F.bool_or(F.array_contains("classes", "l_tvar") & (F.col("pos") == 1))
    rows = tokens.groupBy(key).agg(has("prvni_osoba").alias("me"), has("email").alias("mail"), has("spona").alias("cop"), finite.alias("fin"), past.alias("past"), first.alias("first"))
    one = lambda name, test: F.when(test, F.lit(name))
    plain = ~F.col("mail")
    found = F.array(one("first_person", F.col("me")), one("email", F.col("mail")), one("copula", plain & F.col("cop")), one("finite_verb", plain & F.col("fin").isNotNull()), one("l_verb", plain & (F.col("past") | (F.col("first") & F.col("fin").isNull()))))
    return rows.select(key, F.array_sort(F.array_compact(found)).alias("features"))
