"""Near copies by the Jaccard similarity of their word shingles, without loss.

Two texts are near copies if their sets of `shingle`-word shingles (lower case, by ASCII blanks; a shorter text is one
shingle) have a Jaccard similarity of 4/5 or more. No pair of them is missed, whatever the size of the texts:

Sizes fall into intervals of which the greatest is 5/4 of the least, so near copies lie in the same or in neighbouring
ones. In such a pair the smaller set has at most r elements, r being its interval's greatest size, and the two differ in
at most r // 4. Each set is dealt by hash into q sections of about 256 elements, and so is what differs: in one section at
least it is a q-th of it or less, d at most. Each section is dealt into more than d parts, so that in this one at least
`parts - d` of them are the same in both; a part's sum is what they meet by. Empty parts say nothing, and are named only by
sets in which those that agree might all be empty.

A section has a sketch, the parities of 256 classes of its shingles; two sketches differ in no more places than the sections
do. Texts that share a part are only compared if their sizes and the sketches of its section allow it, so that long texts
with a passage in common are told apart by it as short ones are. Each is first compared with the least that it meets. Parts
whose texts are then all in one group are done; in the others texts of different groups are paired. Pairs are decided by the
sets themselves, which are made again for those that need it.

Null text counts as empty; empty texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.components import smallest_reachable
from millrace.runtime import HELD, released, settle

SEED = 43
SHINGLE = 5
#: Rows of ids that are broadcast at most.
MOST_BROADCAST = 200_000
#: Elements of a section, about.
SECTION = 256
#: Rows with one set above which only the first of them names its parts.
MOST_COPIES = 100
SKETCH = ("s0", "s1", "s2", "s3")
SETS_DDL = f"node long, n int, sections array<struct<q: int, {', '.join(f'{x}: long' for x in SKETCH)}, keys: array<long>>>, members array<long>"
SECTIONS = pa.list_(pa.struct([("q", pa.int32()), *((x, pa.int64()) for x in SKETCH), ("keys", pa.list_(pa.int64()))]))
SETS = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("sections", SECTIONS), ("members", pa.list_(pa.int64()))])


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the text's different shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    body = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = min(size, len(words))
    spans = zip(starts[: len(words) - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(body[a:b], SEED) for a, b in spans], dtype=np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look independent of x (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def intervals(n: int) -> list[tuple[int, int]]:
    """(number, greatest size) of the interval that size n lies in and of the one below."""
    low, at, below = 1, 0, None
    while True:
        high = low * 5 // 4
        if n <= high:
            return [x for x in ((at, high), below) if x]
        below, low, at = (at, high), high + 1, at + 1


def sections(members: np.ndarray) -> list[dict]:
    """For each section of the set, in both of its intervals: q (how many there are), its sketch and the keys of its parts."""
    out, spread = [], mixed(members)
    classes = (members >> np.uint64(56)).astype(np.int64)
    for number, high in intervals(len(members)) if len(members) else ():
        q = max(1, high // SECTION)
        differ = high // 4 // q
        parts = differ + 1 + (differ + 9) // 10 + 1
        where = (members % np.uint64(q * parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        held, first = np.unique(where[order], return_index=True)
        sums = np.add.reduceat(spread[order], first)
        group = mixed(np.array([number + 1], np.uint64))
        keys = mixed(sums + mixed(held.astype(np.uint64) + group))
        ends = np.searchsorted(held, np.arange(q + 1) * parts)
        odd = np.bincount((where // parts) * 256 + classes, minlength=q * 256) % 2
        sketches = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(q, 4)
        for at in range(q):
            own = keys[ends[at] : ends[at + 1]]
            if len(own) <= differ:  # what agrees may be empty throughout
                empty = np.setdiff1d(np.arange(at * parts, (at + 1) * parts), held).astype(np.uint64)
                own = np.concatenate([own, mixed(mixed(empty + group))])
            out.append({"q": q, **dict(zip(SKETCH, sketches[at].tolist(), strict=True)), "keys": own.view(np.int64)})
    return out


def part_keys(members: np.ndarray) -> np.ndarray:
    """Hashes by which any two sets of similarity 4/5 or more meet."""
    return np.concatenate([np.zeros(0, np.uint64), *(x["keys"].view(np.uint64) for x in sections(members))])


def sets(text: Column, members: bool = False) -> Column:
    """node (equal for equal sets), n, and the sections; or only the members, if asked for."""

    def one(raw: str | None) -> dict:
        found = shingles(raw)
        spread = mixed(found)
        node = int(mixed(np.add.reduce(spread, dtype=np.uint64, keepdims=True) + np.uint64(len(found))).view(np.int64)[0])
        return {"node": node, "n": len(found), "sections": None if members else sections(found), "members": found.view(np.int64) if members else None}

    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([one(x.as_py()) for x in texts], SETS)

    made.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(made, SETS_DDL)(text)


def similar(both: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b elements that share `both` have similarity 4/5 or more."""
    return 9 * both >= 4 * (a + b)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b: nodes) whose sets are similar."""
    with released(docs.sparkSession) as kept:  # the sets go as soon as the pairs are decided
        links = similar_pairs(pairs, docs, nodes)
        kept.append(HELD[-1])
    return links


def similar_pairs(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = settle(pairs.distinct(), "similar-pairs")
    wanted = settle(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "similar-wanted")
    ids = settle(nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("want")).distinct(), "similar-ids")
    if ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        ids = F.broadcast(ids)
    made = docs.join(ids, docs["doc_id"].eqNullSafe(ids["want"]), "left_semi").select(sets(F.col("text"), True).alias("s")).select("s.node", "s.n", "s.members")
    made = settle(made.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "similar-members")
    left = made.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("members").alias("m_a"))
    right = made.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("members").alias("m_b"))
    both = pairs.join(left, "a").join(right, "b")
    return settle(both.where(similar(F.size(F.array_intersect("m_a", "m_b")), F.col("n_a"), F.col("n_b"))).select("a", "b"), "similar-links")


def shared_parts(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, node, n, q and the sketch of the key's section, for parts that different sets share. All that have a key meet in one
    shuffle; of a set that very many rows have, only the row that nodes names takes part."""
    often = nodes.where(F.col("copies") > MOST_COPIES).select("node", "rep")
    often = F.broadcast(often) if often.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else often
    once = made.join(often, "node", "left").where(F.col("rep").isNull() | F.col("doc_id").eqNullSafe(F.col("rep")))
    each = once.select("node", "n", F.posexplode("sections").alias("at", "x"))
    same = Window.partitionBy("key")
    keys = each.select("node", "at", F.explode("x.keys").alias("key"))
    keys = keys.select("key", "node", "at", F.min("node").over(same).alias("low"), F.max("node").over(same).alias("high"))
    shared = settle(keys.where("low < high").select("key", "node", "at").distinct(), "parts-met")
    sketches = each.select("node", "at", "n", "x.q", *(f"x.{x}" for x in SKETCH)).dropDuplicates(["node", "at"])
    return settle(shared.join(sketches, ["node", "at"]).select("key", "node", "n", "q", *SKETCH), "parts-shared")


def allowed(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether sizes and sketches of a section allow two sets to be similar: some section has a q-th of what differs, or less."""
    apart = sum((F.bit_count(a(x).bitwiseXOR(b(x))) for x in SKETCH[1:]), F.bit_count(a(SKETCH[0]).bitwiseXOR(b(SKETCH[0]))))
    return (9 * a("q") * apart <= a("n") + b("n")) & (5 * F.least(a("n"), b("n")) >= 4 * F.greatest(a("n"), b("n")))


def similar_links(made: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose connected parts are those of all similar pairs."""
    shared = shared_parts(made, nodes)
    known = ["node", "n", "q", *SKETCH]
    low = F.first(F.struct(*known)).over(Window.partitionBy("key").orderBy("node"))
    near = shared.withColumn("low", low).where((F.col("node") != F.col("low.node")) & allowed(F.col, lambda x: F.col(f"low.{x}")))
    stars = verified(near.groupBy("node").agg(F.min("low.node").alias("a")).select("a", F.col("node").alias("b")), docs, nodes)
    roots = smallest_reachable(stars)
    marked = settle(shared.join(roots, "node", "left").select("key", *known, F.coalesce("root", "node").alias("root")), "parts-marked")
    mixed_keys = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rest = settle(marked.join(mixed_keys, "key", "left_semi"), "parts-mixed")
    left = rest.select("key", *(F.col(x).alias(f"{x}_a") for x in (*known, "root")))
    right = rest.select("key", *(F.col(x).alias(f"{x}_b") for x in (*known, "root")))
    close = allowed(lambda x: F.col(f"{x}_a"), lambda x: F.col(f"{x}_b"))
    pairs = left.hint("merge").join(right, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & close)
    return stars.unionByName(verified(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), docs, nodes))


def drop_similar(docs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """One document of each group of near copies stays, that with the least id; rows with its id and a text of its group
    stay with it, as do rows without an id. Rows that share an id but not the text are judged each for itself. linked
    (doc_id, key: the text's hash, group) tells of further links: what shares a group is linked as well."""
    with released(docs.sparkSession) as kept:
        gone = copies(docs, linked)
        kept.append(HELD[-1])
    if gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, (docs["doc_id"] == gone["gone__id"]) & (F.xxhash64(docs["text"]) == gone["gone__key"]), "left_anti")


def group_links(made: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: each of a group's with the least of them."""
    told = linked.where("group IS NOT NULL").select(F.col("doc_id").alias("l_id"), F.col("key").alias("l_key"), "group")
    met = made.select("doc_id", "key", "node").join(told, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("key") == F.col("l_key"))).select("group", "node").distinct()
    least = met.groupBy("group").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("group", "a")
    return settle(met.join(least, "group").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "similar-linked")


def copies(docs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """gone__id, gone__key: the rows that go, by their ids and the hashes of their texts."""
    texts = docs.select("doc_id", "text")
    made = settle(texts.select("doc_id", F.xxhash64("text").alias("key"), sets(F.col("text")).alias("s")).select("doc_id", "key", "s.node", "s.n", "s.sections"), "shingle-sets")
    nodes = settle(made.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "shingle-nodes")
    links = similar_links(made, texts, nodes)
    if linked is not None:
        links = links.unionByName(group_links(made, linked))
    parts = smallest_reachable(links)
    rooted = settle(nodes.join(parts, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "similar-rooted")
    named = settle(rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("least")), "root").select("node", "least"), "similar-named")
    gone = made.select("doc_id", "key", "node").join(named, "node").where("doc_id <> least")
    return settle(gone.select(F.col("doc_id").alias("gone__id"), F.col("key").alias("gone__key")).distinct(), "similar-gone")
