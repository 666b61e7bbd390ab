r"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles that a contaminated document must hold whole, so with the shingles of a
window ordered by their rarity over all documents, the rarest one is its necessary prefix: a document without it can't
hold the window. Neighbouring windows mostly share their rarest shingle, and become one anchor. A document's shingles
meet the anchors by hash; the window's place then follows from the shingle's (positional bound), it must lie inside the
text (length bound), and its words are compared one by one (verification). Windows with a shingle that no document
holds are dropped before the join.

Only DataFrame functions are used. The anchors are broadcast while they are at most max_broadcast rows; beyond that they
are shuffled, and only ids and positions with them. A document's matches are gathered in its own row, never by item
or by passage.

Null text has no words. Each row is judged for itself, whether its id is null, repeated or its own. Benchmark rows without
an id are left out, repeated ones count once. Texts of any length are taken whole; columns besides the named ones are
kept or left out, but never read, whatever their names. Empty tables give no hits.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import settle

#: Written with what a word may hold: Java's matcher takes ten times as long for the negated class.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class LeakPolicy:
    window: int = 10
    shingle: int = 3
    max_broadcast: int = 100_000
    max_broadcast_bytes: int = 64 << 20


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def shingle_key(words: Column, at: Column, size: int) -> Column:
    """A hash of size words from position at (from 0)."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def shingle_rows(frame: DataFrame, words: str, size: int) -> DataFrame:
    """frame with a row for each shingle: its position pos and its key; a row without shingles has one with nulls.

    The outer form keeps the optimizer from filtering by the number of words, for which it would take them twice."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size))
    return frame.withColumn("pos", F.explode_outer(places)).withColumn("key", F.when(F.col("pos").isNotNull(), shingle_key(F.col(words), F.col("pos"), size)))


def item_shingles(benchmark: DataFrame, policy: LeakPolicy) -> DataFrame:
    """A row for each shingle of each item: item_id, words, width of its windows, size, pos, key."""
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("width", F.least(F.size("words"), F.lit(policy.window))).withColumn("size", F.least("width", F.lit(policy.shingle)))
    parts = [shingle_rows(items.where(F.col("size") == n), "words", n) for n in range(1, policy.shingle + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("key").isNotNull())


def small(frame: DataFrame, policy: LeakPolicy) -> bool:
    """Whether a settled frame may be broadcast: by its rows, and by the bytes of the words that it carries."""
    if frame.limit(policy.max_broadcast + 1).count() > policy.max_broadcast:
        return False
    return "snip" not in frame.columns or (frame.agg(F.sum(F.octet_length(F.array_join("snip", " ")))).first()[0] or 0) <= policy.max_broadcast_bytes


#: What tells a row from others: its id and two hashes of its text.
KEY = ["doc_id", "key1", "key2"]


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2"), *more)


def same_row(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Whether a row of left has the key that right holds under these names."""
    doc_id, key1, key2 = names
    return left["doc_id"].eqNullSafe(right[doc_id]) & (left["key1"] == right[key1]) & (left["key2"] == right[key2])


def document_words(docs: DataFrame) -> DataFrame:
    return keyed(docs, words_of(F.col("text")).alias("words"))


def rarity(docs: DataFrame, keys: DataFrame, sizes: list[int], policy: LeakPolicy) -> DataFrame:
    """How often each key occurs in all documents; keys that never do are missing."""
    keys = keys.select("key").distinct()
    held = F.broadcast(keys) if small(keys, policy) else keys
    texts = document_words(docs)
    counts = [shingle_rows(texts, "words", n).select("key").join(held, "key").groupBy("key").count() for n in sizes]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out.groupBy("key").agg(F.sum("count").alias("freq"))


def anchors_of(shingles: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each window's rarest shingle; windows of an item with the same one are one row: key, size, width, back (words
    before the shingle in snip), snip (the words of all its windows), item_id."""
    ranked = shingles.join(frequency, "key", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    starts = F.sequence(F.greatest(F.col("pos") + F.col("size") - F.col("width"), F.lit(0)), F.least(F.col("pos"), F.size("words") - F.col("width")))
    windows = ranked.withColumn("start", F.explode(starts)).groupBy("item_id", "words", "width", "size", "start").agg(F.min(F.struct("freq", "key", "pos")).alias("rarest"))
    held = windows.where("rarest.freq > 0").groupBy("item_id", "words", "width", "size", "rarest.key", "rarest.pos").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    return held.select("item_id", "key", "size", "width", (F.col("pos") - F.col("first")).alias("back"), F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("width")).alias("snip"))


def verified(rows: DataFrame) -> DataFrame:
    """rows: a document's words, pos and an anchor. Adds starts: where in the document its windows stand, word for word.

    Rows with no such place stay: a filter here would be made part of the join and there hold up every shingle."""
    rows = rows.withColumn("low", F.greatest(F.col("pos") - F.col("back"), F.lit(0)))
    rows = rows.withColumn("near", F.slice("words", F.col("low") + 1, F.col("pos") - F.col("back") + F.size("snip") - F.col("low"))).withColumn("n", F.size("words")).drop("words")
    begin = F.col("pos") - F.col("back")

    def stands(j: Column) -> Column:
        inside = (begin + j >= 0) & (begin + j + F.col("width") <= F.col("n"))
        return F.when(inside, F.slice("near", begin + j - F.col("low") + 1, F.col("width")) == F.slice("snip", j + 1, F.col("width"))).otherwise(False)

    found = F.filter(F.sequence(F.lit(0), F.size("snip") - F.col("width")), stands)
    return rows.withColumn("starts", F.transform(found, lambda j: begin + j)).select(*KEY, "anchor", "width", "starts")


def find_leaks(docs: DataFrame, benchmark: DataFrame, policy: LeakPolicy | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences: a row's key, anchor, width, starts; items: anchor, item_id)."""
    policy = policy or LeakPolicy()
    docs = docs.select("doc_id", "text")
    shingles = settle(item_shingles(benchmark, policy), "shingles")
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())  # 1 to policy.shingle
    frequency = rarity(docs, shingles, sizes or [policy.shingle], policy)
    every = settle(anchors_of(shingles, frequency).withColumn("anchor", F.sha2(F.concat_ws("\x00", "key", "size", "width", "back", "snip"), 256)), "anchors")
    anchors = every.dropDuplicates(["anchor"]).drop("item_id")
    texts, parts = document_words(docs), []
    held = small(anchors, policy)
    for n in sizes or [policy.shingle]:
        own = anchors.where(F.col("size") == n)
        if held:
            parts.append(verified(shingle_rows(texts, "words", n).join(F.broadcast(own), "key")))
        else:
            places = shingle_rows(texts, "words", n).select(*(F.col(x).alias(f"place_{x}") for x in KEY), "pos", "key").join(own, "key")
            found = [f"place_{x}" for x in KEY]
            parts.append(verified(places.join(texts.distinct(), same_row(texts, places, found)).drop(*found)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return settle(out, "leaks").where(F.size("starts") > 0), every.select("anchor", "item_id").distinct()


def leak_report(docs: DataFrame, benchmark: DataFrame, policy: LeakPolicy | None = None) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, item_ids (sorted as strings)."""
    leaks, items = find_leaks(docs, benchmark, policy)
    covered = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("width") - 1)))
    hits = leaks.select(*KEY, covered.alias("places")).groupBy(*KEY).agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("n_hit"))
    held = [f"leak_{x}" for x in KEY]
    named = leaks.select(*KEY, "anchor").distinct().join(items, "anchor").groupBy(*(F.col(x).alias(y) for x, y in zip(KEY, held, strict=True))).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = hits.join(named, same_row(hits, named, held)).select(*held, "n_hit", "item_ids")
    counted = keyed(docs, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_words"))
    out = counted.join(found, same_row(counted, found, held), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, policy: LeakPolicy | None = None) -> DataFrame:
    """The documents that hold no window of the benchmark, with their own columns."""
    leaks, _ = find_leaks(docs, benchmark, policy)
    dirty = settle(leaks.select(*(F.col(x).alias(f"leak__{x}") for x in KEY)).distinct(), "leaky")
    dirty = F.broadcast(dirty) if small(dirty, policy or LeakPolicy()) else dirty
    same = docs["doc_id"].eqNullSafe(dirty["leak__doc_id"]) & (F.xxhash64(docs["text"]) == dirty["leak__key1"]) & (F.xxhash64(F.lit(1), docs["text"]) == dirty["leak__key2"])
    return docs.join(dirty, same, "left_anti")


def op2_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leak_report(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
