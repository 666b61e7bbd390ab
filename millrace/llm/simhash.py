"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints.

Fingerprints that differ in at most `distance` of 64 bits agree in at least `blocks - distance` of `blocks` blocks, so a
pair shares the bits of at least one choice of that many blocks. Distinct fingerprints are joined on each choice and the
pairs verified by Hamming distance. Copies share a fingerprint and never meet as pairs.

A choice's bucket may hold very many fingerprints (many near copies of one text). Buckets above `max_bucket` are not
paired: each of their fingerprints names the values within one bit of itself in the bits outside the choice, and all
that name the same value are linked to the least of them. Two fingerprints of a bucket differ in at most two bits if and
only if they name a common value, so the groups are the same as from all pairs, from a number of rows in proportion to
the bucket. (The form needs distance 2; other distances take a finer split of the bucket.)

Groups are found by passing labels over the links in rounds, each a written table; nothing but a count reaches the
driver.

Null text counts as empty, which has fingerprint zero. Rows with a null id get a fingerprint and their group's id; a
group's id is the least id in it, null where there is none. Repeated ids and rows are kept as they are. Texts of any
length are taken whole, their hashes some at a time. Other columns of the documents are not read, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import smallest_reachable
from millrace.runtime import settle

SEED = 42
#: Rows of ids that are broadcast at most.
MOST_BROADCAST = 200_000


@dataclass(frozen=True)
class SimHashPolicy:
    shingle: int = 3
    distance: int = 2
    blocks: int = 4
    max_bucket: int = 16

    def __post_init__(self):
        if self.distance != 2:
            raise ValueError("large buckets are linked through values one bit away, which needs distance 2")

    def choices(self) -> list[int]:
        """The bit masks to join on: each of all choices of blocks - distance blocks."""
        edges = [64 * i // self.blocks for i in range(self.blocks + 1)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        return [sum(x) for x in combinations(masks, self.blocks - self.distance)]


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    body = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = min(size, len(words))
    spans = zip(starts[: len(words) - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, policy: SimHashPolicy | None = None) -> Column:
    """The fingerprint as a signed 64-bit number."""
    size = (policy or SimHashPolicy()).shingle

    def hashed(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(x.as_py(), size) for x in texts], dtype=np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    hashed.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashed, "long")(text)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, policy: SimHashPolicy) -> DataFrame:
    """prints: fp, distinct. Pairs (a, b) of fingerprints whose connected parts are those of all close pairs."""
    masks = F.array(*(F.lit(signed(m)) for m in policy.choices()))
    keyed = prints.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    sizes = settle(keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    shared = settle(keyed.join(sizes, ["choice", "part"]), "buckets")
    small = shared.where(F.col("n") <= policy.max_bucket).select("choice", "part", "fp")
    pairs = small.alias("x").join(small.alias("y"), ["choice", "part"]).where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= policy.distance)
    if shared.where(F.col("n") > policy.max_bucket).limit(1).count() == 0:
        return pairs
    bits = F.array(F.lit(0), *(F.lit(signed(1 << i)) for i in range(64)))
    large = shared.where(F.col("n") > policy.max_bucket).select("choice", "part", "mask", "fp", F.explode(bits).alias("bit")).where(F.col("bit").bitwiseAND(F.col("mask")) == 0)
    named = large.select("choice", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("value"))
    least = named.groupBy("choice", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("choice", "value", "a")
    stars = named.join(least, ["choice", "value"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def near_duplicate_groups(docs: DataFrame, policy: SimHashPolicy | None = None, key: bool = False) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, fp (signed), component_id, and with key the text's hash."""
    policy = policy or SimHashPolicy()
    own = [F.xxhash64("text").alias("key")] if key else []
    prints = settle(docs.select("doc_id", *own, fingerprints(F.col("text"), policy).alias("fp")), "fingerprints")
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    pairs = settle(links(classes.select("fp"), policy).distinct(), "links")
    parts = smallest_reachable(pairs)  # node, root: the least fingerprint, for those with links
    rooted = classes.join(parts, classes.fp == parts.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = settle(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = settle(rooted.join(least, "root").select("fp", "component_id"), "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", *(["key"] if key else []))


def drop_near_duplicates(docs: DataFrame, policy: SimHashPolicy | None = None) -> DataFrame:
    """One document of each group stays, that with the least id; rows with its id and a text of its group stay with it, as
    do rows without an id. Rows that share an id but not the text are judged each for itself."""
    groups = near_duplicate_groups(docs.select("doc_id", "text"), policy, key=True)
    gone = groups.where(F.col("doc_id") != F.col("component_id"))
    gone = settle(gone.select(F.col("doc_id").alias("gone__id"), F.col("key").alias("gone__key")).distinct(), "copies")
    if gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # else the texts are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, (docs["doc_id"] == gone["gone__id"]) & (F.xxhash64(docs["text"]) == gone["gone__key"]), "left_anti")


def op1_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicate_groups(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
