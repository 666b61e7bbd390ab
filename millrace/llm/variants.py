"""Spelling variants: words one edit apart, and for each the far more frequent word that it is a variant of.

Of two words one insertion, deletion or replacement apart, the shorter of m characters, either the first m / 2 characters
are equal or the last ones are. So words meet by halves: each word is dealt by the first and the last half that it would
share, both as the shorter word of a pair and as the longer one. A worker holds the words of a number of halves in two minimal
acyclic automata, one of the words and one of the words read backwards. A word's half is matched exactly, what follows is
completed with one error, and the number that perfect hashing gives the word reached finds its count. A pair that shares
its first half is told by the forward automaton alone, so each pair is told once, and only sums by word leave the worker.

A half that more than `bucket_words` words share is split again by the halves of what lies between the parts already
equal, until what is left is one or two characters; a hot half so never fills a worker, and words with nothing else in
common are not compared.

Counting, dealing, summing and the chains of forms are Spark jobs; a chain's root is found by doubling, in rounds that grow
with the logarithm of the longest chain, whose counts grow by `ratio` at each step.

Words are compared by code points, whatever they are; null words are left out, and repeated rows of a word add up. A word
without a near one has n_near 0, no form, and is its own root. Texts are taken whole; null texts have no words, a null id
is written as nothing. Repeated rows are counted as often as they occur, other columns aren't looked at. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sql import LOWER, UPPER
from millrace.llm.workers import give_back
from millrace.runtime import settle

RUN = r"[A-Za-zÀ-ÿ]{%d,}"


@dataclass(frozen=True)
class VariantPolicy:
    min_chars: int = 6
    min_count: int = 5
    #: a word's form occurs at least so many times as often
    ratio: int = 5
    #: words that share a part before it is split further; a smaller part of a small input
    bucket_words: int = 5000
    #: words that a worker puts into its automata at once, at least those of one bucket
    batch_words: int = 40_000


class Automaton:
    """A minimal acyclic automaton of sorted distinct words. A state is [final, {character: (state, words before it)}, words];
    the words before on a path add up to the word's number."""

    def __init__(self, words: list[str]) -> None:
        register: dict[tuple, list] = {}
        self.root: list = [False, {}, 0]
        path, last = [self.root], ""

        def close(down: int) -> None:
            while len(path) > down:
                state = path.pop()
                key = (state[0], tuple((c, id(x)) for c, x in state[1].items()))
                path[-1][1][last[len(path) - 1]] = register.setdefault(key, state)

        for word in words:
            same = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                same += 1
            close(same + 1)
            for c in word[same:]:
                path[-1][1][c] = fresh = [False, {}, 0]
                path.append(fresh)
            path[-1][0], last = True, word
        close(1)
        self.states = [*register.values(), self.root]  # children before parents
        for state in self.states:
            n = int(state[0])
            for c, child in state[1].items():
                state[1][c] = (child, n)
                n += child[2]
            state[2] = n

    def number(self, word: str) -> int | None:
        return finish(self.root, 0, word, 0)

    def near(self, word: str, head: int, tail: int) -> list[int]:
        """Numbers of the words that come from word, which is in the automaton, by one edit between its first `head` and
        its last `tail` characters; each once."""
        state, number, found = self.root, 0, []
        for c in word[:head]:
            state, before = state[1][c]
            number += before
        stop = len(word) - tail
        for i in range(head, stop + 1):
            own = word[i : i + 1]
            if i < stop and (i == head or word[i - 1] != own):
                found.append(finish(state, number, word, i + 1))
            for c, (child, before) in state[1].items():
                if c != own:
                    if i < stop:
                        found.append(finish(child, number + before, word, i + 1))
                    found.append(finish(child, number + before, word, i))
                elif i == stop:
                    found.append(finish(child, number + before, word, i))
            if i < stop:
                state, before = state[1][own]
                number += before
        return [x for x in found if x is not None]


def finish(state: list, number: int, word: str, at: int) -> int | None:
    """The number of the word that word[at:] leads to, if there is one."""
    for c in word[at:] if len(word) - at < 64 else (word[k] for k in range(at, len(word))):
        step = state[1].get(c)
        if step is None:
            return None
        state = step[0]
        number += step[1]
    return number if state[0] else None


def run_words(docs: DataFrame, min_chars: int) -> DataFrame:
    """word: the contract's words of at least min_chars characters, one row each time."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN % min_chars), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    told = low.withColumn("h", F.expr("crc32(CAST(concat(coalesce(CAST(doc_id AS STRING), ''), ':', run) AS BINARY))"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    return told.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)


def halved(rows: DataFrame) -> DataFrame:
    """rows: word, n, key, m, head, tail, base (characters between head and tail of the shorter word), told: places of first
    halves that must differ. Each is dealt by the first and by the last half of what lies between."""
    half = F.floor(F.col("base") / 2).cast("int")
    rest = F.col("base") - half
    between = F.length("word") - F.col("head") - F.col("tail")
    front = F.substring(F.col("word"), F.col("head") + 1, half)
    back = F.substring(F.col("word"), F.col("head") + between - rest + 1, rest)
    both = F.array(
        F.struct(F.xxhash64("key", F.lit(0), front).alias("key"), F.lit(True).alias("forward"), (F.col("head") + half).alias("head"), F.col("tail").alias("tail"), rest.alias("base"), F.col("told").alias("told")),
        F.struct(F.xxhash64("key", F.lit(1), back).alias("key"), F.lit(False).alias("forward"), F.col("head").alias("head"), (F.col("tail") + rest).alias("tail"), half.alias("base"), F.concat("told", F.array(F.struct(F.col("head").alias("at"), half.alias("size")))).alias("told")),
    )
    return rows.select("word", "n", "m", F.explode(both).alias("e")).select("word", "n", "m", "e.*")


def dealt(words: DataFrame, policy: VariantPolicy) -> DataFrame:
    """The words by the parts that they are matched on, no part shared by too many."""
    spark = words.sparkSession
    nothing = F.array().cast("array<struct<at: int, size: int>>")
    length = F.length("word")
    roots = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m >= 0")
    open_ = halved(roots.select("word", "n", "m", F.col("m").cast("long").alias("key"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.col("m").alias("base"), nothing.alias("told")))
    done = None
    while True:
        open_ = settle(open_, "variant-parts")
        sizes = settle(open_.groupBy("key").agg(F.count("*").alias("size"), F.max("base").alias("most_base")), "variant-sizes")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        most = min(policy.bucket_words, max(100, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
        hot = sizes.where((F.col("size") > most) & (F.col("most_base") > 1)).select("key")
        if hot.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        settled = open_.join(hot, "key", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        open_ = halved(open_.join(hot, "key", "left_semi"))


NEAR = "word string, n_near long, form_n long, form string"


def near_words(policy: VariantPolicy):  # noqa: ANN201
    """The mapInArrow function: rows of dealt(), sorted by key. Returns sums for each word in each part."""

    def answers(rows: pa.Table) -> pa.RecordBatch:
        columns = {x: rows.column(x).to_pylist() for x in ("word", "n", "m", "forward", "head", "tail", "told")}
        out: list[tuple] = []
        for forward in (True, False):
            at = [i for i, x in enumerate(columns["forward"]) if x == forward]
            turned = {i: columns["word"][i] if forward else columns["word"][i][::-1] for i in at}
            counts = {turned[i]: columns["n"][i] for i in at}
            words = sorted(counts)
            ordered = [counts[w] for w in words]
            automaton = Automaton(words)
            for i in at:
                word, m, head, tail = turned[i], columns["m"][i], columns["head"][i], columns["tail"][i]
                found = []
                for k in automaton.near(word, *((head, tail) if forward else (tail, head))):
                    other = words[k]
                    if min(len(word), len(other)) == m:
                        plain, own = (other, word) if forward else (other[::-1], columns["word"][i])
                        if all(plain[x["at"] : x["at"] + x["size"]] != own[x["at"] : x["at"] + x["size"]] for x in columns["told"][i]):
                            found.append((-ordered[k], plain))
                if found:
                    n, form = min(found)
                    out.append((columns["word"][i], len(found), -n, form))
        names = ["word", "n_near", "form_n", "form"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= policy.batch_words:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                edges = (key[1:] != key[:-1]).nonzero()[0]
                if len(edges):
                    cut = int(edges[-1]) + 1
                    yield answers(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), table.num_rows - cut
        if size:
            yield answers(pa.Table.from_batches(held))
        give_back()

    return run


def roots_of(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """links: word, form, without circles. Returns word, root: where the chain of forms ends."""
    at = settle(links.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(most_rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = settle(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        at = stepped.select("word", "root")
    raise RuntimeError(f"chains of forms aren't followed after {most_rounds} rounds")


def variant_groups(words: DataFrame, policy: VariantPolicy | None = None) -> DataFrame:
    """words: word, n. Returns word, form, root, n, n_near, form_n."""
    policy = policy or VariantPolicy()
    words = settle(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "variant-words")
    found = dealt(words, policy).repartition("key").sortWithinPartitions("key").mapInArrow(near_words(policy), NEAR)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    near = settle(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("form_n"), "best.form"), "variant-near")
    near = near.withColumn("held", F.col("form_n") >= policy.ratio * F.col("n"))
    roots = roots_of(near.where("held").select("word", "form"))
    return near.join(roots, "word", "left").select("word", F.when(F.col("held"), F.col("form")).alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.when(F.col("held"), F.col("form_n")).alias("form_n"))


def op11_spelling_variants(docs: DataFrame, policy: VariantPolicy | None = None) -> DataFrame:
    policy = policy or VariantPolicy()
    counted = run_words(docs, policy.min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= policy.min_count)
    return variant_groups(counted, policy)
