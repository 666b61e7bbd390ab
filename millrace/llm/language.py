"""Language identification by a mixture of languages.

Learning: over all labelled texts, characters in words are counted by language, each with the one and the two before it (a
word's start and end count as characters). Counts are held in tables of fixed size, addressed by a hash of the characters,
so that the model has (languages x about 200,000) numbers however large the corpus is; Spark sums them, and only sums by
language and place reach the driver.

Inference: the likelihood of a word under a language is the product of its characters' probabilities, of three characters
falling back to two and to one. A document is a mixture: each of its words comes from one of the languages, in unknown
proportions. Expectation-maximisation estimates them. Then sets of languages, in the order of their proportions, are
compared by likelihood less a penalty for each language (half the logarithm of the number of words); the proportions in
the best set are the document's, the largest is its language and its proportion the score.

Whole texts are taken; what lies between letters separates words, and runs of over 24 letters are taken in pieces. A text
that is null or holds no letter is `und` with score 0, as are all where nothing was learnt. A label that is null, or whose
texts have no letter, is not learnt; other labels are taken as they are. Rows are judged for themselves, so repeated ids and
rows don't matter; other columns are kept, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.workers import give_back

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]{1,24}")
#: sizes of the tables: of three characters, of two, of one; then of the two and the one that others follow
SIZES = (1 << 17, 1 << 15, 1 << 12, 1 << 15, 1 << 12)
OFFSETS = tuple(np.cumsum((0, *SIZES)).tolist())
LARGEST_MODEL = 1024


@dataclass(frozen=True)
class LanguagePolicy:
    #: weight of the shorter context, in observations
    back_off: float = 2.0
    #: smallest probability of a character that no text of the language has
    floor: float = 1e-5
    rounds: int = 12
    #: times half the logarithm of the number of words, for each language
    penalty: float = 2.0
    #: words that a worker remembers the likelihood of
    remembered: int = 200_000
    #: words that are judged at once
    batch_words: int = 100_000


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def words_of(text: str | None) -> Counter:
    """The words of a text in small letters, with their counts."""
    found = Counter(WORDS.findall((text or "").lower()))
    odd = [w for w in found if not w.isalpha()]
    for w in odd:
        n = found.pop(w)
        if kept := letters(w):
            found[kept] += n
    return found


def places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, slots): for each character and each word's end, the word's number and its place in the five tables."""
    codes = np.frombuffer(("\0\0" + "\0\0\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = (codes == 0) & np.r_[False, codes[:-1] != 0]
    at = np.flatnonzero((codes != 0) | ends)
    c, b, a = codes[at], codes[at - 1], codes[at - 2]
    mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    two = mix(b + np.uint64(1)) + c
    context = mix(a + np.uint64(3)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    three = mix(context) + mix(c + np.uint64(7))
    slots = np.stack([mix(three) % np.uint64(SIZES[0]), mix(two) % np.uint64(SIZES[1]), mix(c) % np.uint64(SIZES[2]), mix(context) % np.uint64(SIZES[3]), mix(b) % np.uint64(SIZES[4])])
    return (np.cumsum(ends) - ends)[at], slots.astype(np.int64) + np.array(OFFSETS[:-1])[:, None]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text -> lang, slot, n: sums over what a task reads, held as one table a language."""
    sums: dict[str, np.ndarray] = {}
    held: dict[str, Counter] = {}

    def add(lang: str) -> None:
        words = held.pop(lang)
        number, slots = places(list(words))
        weight = np.fromiter(words.values(), np.int64, len(words))[number]
        own = sums.setdefault(lang, np.zeros(OFFSETS[-1], np.int64))
        for row in slots:
            own += np.bincount(row, weight, OFFSETS[-1]).astype(np.int64)

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            name = lang.as_py()
            own = held.setdefault(name, Counter())
            own.update(words_of(text.as_py()))
            if len(own) > 100_000:
                add(name)
    for lang in list(held):
        if held[lang]:
            add(lang)
    for lang, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "slot", "n"])
    give_back()


@dataclass
class LanguageModel:
    """names: the languages; counts: languages x places."""

    names: list[str]
    counts: np.ndarray
    policy: LanguagePolicy = field(default_factory=LanguagePolicy)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Logarithms, words x languages."""
        number, (three, two, one, context, last) = places(words)
        k, n, total = self.policy.back_off, self.counts, self.counts[:, OFFSETS[2] : OFFSETS[3]].sum(1, keepdims=True)
        p1 = (n[:, one] + self.policy.floor * total) / (total * (1 + self.policy.floor * 256))
        p2 = (n[:, two] + k * p1) / (n[:, last] + k)
        p3 = (n[:, three] + k * p2) / (n[:, context] + k)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        return np.add.reduceat(np.log(p3), starts, axis=1).T

    def mixture(self, owner: np.ndarray, n_docs: int, count: np.ndarray, like: np.ndarray, allowed: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihood) of each document, over the languages allowed to it. owner: each word's document,
        ascending and without gaps; share: where to begin."""
        top = like.max(1, keepdims=True)
        p = np.exp(np.maximum(like - top, -200.0))
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total = np.add.reduceat(count, starts)[:, None]
        share = share * allowed
        share = share / share.sum(1, keepdims=True)
        for _ in range(self.policy.rounds):
            r = p * share[owner]
            r *= (count / np.maximum(r.sum(1), 1e-300))[:, None]
            share = np.maximum(np.add.reduceat(r, starts, axis=0) / total, 1e-12) * allowed
            share /= share.sum(1, keepdims=True)
        fit = np.log(np.maximum((p * share[owner]).sum(1), 1e-300)) + top[:, 0]
        return share, np.add.reduceat(fit * count, starts)

    def proportions(self, owner: np.ndarray, n_docs: int, count: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Each document's proportions in its best set of languages."""
        k = len(self.names)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        total = np.add.reduceat(count, starts)
        share, _ = self.mixture(owner, n_docs, count, like, np.ones((n_docs, k)), np.full((n_docs, k), 1 / k))
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        alone = np.add.reduceat(like * count[:, None], starts, axis=0)
        first = alone.argmax(1)
        best, best_fit = np.eye(k)[first], alone.max(1)
        for size in range(2, k + 1):
            # a language that has not half a word can't pay its penalty
            open_ = np.flatnonzero(((share * total[:, None]) >= 0.5).sum(1) >= size)
            if not len(open_):
                break
            chosen = np.isin(owner, open_)
            small = np.searchsorted(open_, owner[chosen])
            mixed, fit = self.mixture(small, len(open_), count[chosen], like[chosen], (rank[open_] < size).astype(float), share[open_])
            fit = fit - self.policy.penalty * (size - 1) * 0.5 * np.log1p(total[open_])
            won = fit > best_fit[open_]
            best[open_[won]], best_fit[open_[won]] = mixed[won], fit[won]
        return best


def learn(docs: DataFrame, policy: LanguagePolicy | None = None) -> LanguageModel:
    """docs: text, lang. All of its labelled rows are counted."""
    told = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = told.mapInArrow(counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    if len(names) > LARGEST_MODEL:
        raise ValueError(f"{len(names)} languages: the model would outgrow a worker")
    counts = np.zeros((len(names), OFFSETS[-1]))
    if names:
        row = np.searchsorted(np.array(names, dtype=object), found.column("lang").to_numpy(zero_copy_only=False))
        counts[row.astype(int), found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return LanguageModel(names, counts, policy or LanguagePolicy())


VERDICT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
VERDICT_DDL = "lang_pred string, score double, languages array<struct<lang: string, share: double>>"


class Known:
    """The likelihoods of words seen before; forgotten when they are too many."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.row, self.rows = model, {}, np.zeros((0, len(model.names)))

    def __call__(self, bags: list[Counter]) -> np.ndarray:
        if len(self.row) > self.model.policy.remembered:
            self.row, self.rows = {}, self.rows[:0]
        row = self.row
        fresh = list({w for bag in bags for w in bag if w not in row})
        if fresh:
            row.update(zip(fresh, range(len(row), len(row) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.likelihoods(fresh)])
        return self.rows[np.fromiter((row[w] for bag in bags for w in bag), np.int64)]


def verdicts(model: LanguageModel, texts: list[str | None], known: Known) -> list[dict]:
    bags = [words_of(x) for x in texts]
    out = [{"lang_pred": UNKNOWN, "score": 0.0, "languages": []} for _ in texts]
    asked = [i for i, bag in enumerate(bags) if bag] if model.names else []
    if not asked:
        return out
    owner = np.repeat(np.arange(len(asked)), [len(bags[i]) for i in asked])
    count = np.fromiter((n for i in asked for n in bags[i].values()), float, len(owner))
    shares = model.proportions(owner, len(asked), count, known([bags[i] for i in asked]))
    for i, share in zip(asked, shares, strict=True):
        order = [int(x) for x in np.argsort(-share, kind="stable") if share[x] > 1e-9]
        out[i] = {"lang_pred": model.names[order[0]], "score": min(1.0, float(share[order[0]])), "languages": [{"lang": model.names[x], "share": float(share[x])} for x in order]}
    return out


def language(text: Column, model: LanguageModel, docs: DataFrame) -> Column:
    """A struct column: lang_pred, score, and the languages of the best set with their proportions."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size, see LARGEST_MODEL

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        known = Known(own)
        for texts in batches:
            found: list[dict] = []
            group, size = [], 0
            for x in texts:
                group.append(x.as_py())
                size += len(group[-1] or "") // 6
                if size >= own.policy.batch_words:
                    found += verdicts(own, group, known)
                    group, size = [], 0
            if group:
                found += verdicts(own, group, known)
            yield pa.array(found, VERDICT)
        give_back()

    judged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judged, VERDICT_DDL)(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a column more."""
    return docs.select("*", language(F.col(text), model, docs).alias(out))


def op13_language_id(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents of three remainders of four of their ids' crc32 and judges all. A null id has no
    remainder: it is neither learnt from nor held out."""
    held_out = F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2")
    model = learn(docs.where(~held_out))
    judged = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), language(F.col("text"), model, docs).alias("v"))
    mixture = F.array_join(F.transform("v.languages", lambda x: F.concat(x["lang"], F.lit(":"), F.format_number(x["share"], 4))), ",")
    return judged.select("doc_id", "held_out", "v.lang_pred", "v.score", mixture.alias("mixture"))
