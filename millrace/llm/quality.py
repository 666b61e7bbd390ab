"""Quality rules by compression bands.

A text that compresses far better than prose repeats itself; one that hardly compresses is noise, an encoded blob or a
key dump. How well prose compresses depends on its length, so each limit belongs to a range of lengths. The ratio
(compressed / raw bytes, zstandard level 3) is taken over the whole text and over chunks that overlap by half, the last of
which ends with the text, so that a clean part, however long, can't hide a bad one that fills a chunk. Texts shorter than
a chunk are judged whole.

The limits can be fitted to labelled documents: in each range of lengths the low limit is put just under the ratios of
the good ones and the high limit just over them, where that tells bad ones apart; elsewhere the wide limits of the policy
hold. All labelled documents are used.

Everything is computed a row at a time, with no shuffle but that of ids, figures and labels. Null text counts as empty: no words,
base_failed true, kept false. Texts of any length are read whole. Each row is judged for itself, so null and repeated ids
and repeated rows don't matter; other columns are kept or left out, but not read, whatever their names. An empty table
gives an empty result, and no labels leave the policy's own limits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import settle

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits for texts of at least min_bytes bytes, up to the next band's min_bytes."""

    min_bytes: int
    low: float
    high: float


@dataclass(frozen=True)
class QualityPolicy:
    """Limits of the rules.

    Prose at zstandard level 3 comes to about 0.65 at 300 bytes, 0.5 at 2 KB and 0.4 beyond 30 KB; base64 and the like never
    come below 0.75. The bands leave a wide margin on both sides of prose. Texts below the first band are left to the base rules: a frame's fixed cost rules there.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    level: int = 3
    bands: tuple[Band, ...] = (Band(256, 0.32, 0.85), Band(1024, 0.26, 0.72), Band(4096, 0.22, 0.68), Band(16384, 0.18, 0.65), Band(65536, 0.15, 0.62))
    chunk_bytes: int = 4096
    chunk_low: float = 0.20
    chunk_high: float = 0.70
    max_bad_chunks: int = 0


VERDICT = pa.struct(
    [
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64()), ("chunk_least", pa.float64()), ("chunk_most", pa.float64()), ("n_bytes", pa.int64()),
    ]
)
VERDICT_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double, chunk_least double, chunk_most double, n_bytes long"


def count_repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text, its first place included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, reach = 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            total += at + 3 - max(at, reach)
            reach = at + 3
    return total


def band_for(size: int, bands: tuple[Band, ...]) -> Band | None:
    found = None
    for band in bands:
        if size >= band.min_bytes:
            found = band
    return found


def judge(text: str | None, policy: QualityPolicy, packer: zstandard.ZstdCompressor) -> dict:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly the six ASCII blanks
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_words, n_repeat = len(words), count_repeat_words(words)
    base_failed = n_words < policy.min_words or 100 * n_repeat > policy.max_repeat_percent * n_words
    ratio, bad_share, banded, ratios = None, None, True, []
    if raw:
        ratio = len(packer.compress(raw)) / len(raw)
        if band := band_for(len(raw), policy.bands):
            banded = band.low <= ratio <= band.high
        step = policy.chunk_bytes
        last = len(raw) - step
        chunks = [raw[at : at + step] for at in (*range(0, last, step // 2), last)] if last >= 0 else []
        if chunks:
            ratios = [len(packer.compress(x)) / step for x in chunks]
            bad = sum(not policy.chunk_low <= x <= policy.chunk_high for x in ratios)
            bad_share = bad / len(chunks)
            banded = banded and bad <= policy.max_bad_chunks
    return {
        "n_words": n_words,
        "word_chars": len(text) - sum(map(text.count, BLANKS)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": not base_failed and banded,
        "ratio": ratio,
        "bad_chunk_share": bad_share,
        "chunk_least": min(ratios, default=None),
        "chunk_most": max(ratios, default=None),
        "n_bytes": len(raw),
    }


def quality_verdict(text: Column, policy: QualityPolicy | None = None) -> Column:
    """A struct column with the counts, the ratios and the verdict for each text."""
    policy = policy or QualityPolicy()

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer = zstandard.ZstdCompressor(level=policy.level)
        for texts in batches:
            yield pa.array([judge(x.as_py(), policy, packer) for x in texts], VERDICT)

    judged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judged, VERDICT_DDL)(text)


def filter_quality(docs: DataFrame, policy: QualityPolicy | None = None, text: str = "text") -> DataFrame:
    """The rows of docs whose text passes, with their own columns as they were."""
    return docs.where(quality_verdict(F.col(text), policy).getField("kept"))


@dataclass(frozen=True)
class Fit:
    """How limits are fitted. least: good documents that a range of lengths needs. outside:
    the share of good ones that a limit may leave out, before margin is added. caught: the share of bad ones that it must
    reach to be used."""

    least: int = 30
    outside: float = 0.002
    margin: float = 0.004
    caught: float = 0.05


#: Figures are counted by their first four decimals, so that the driver gets a number of rows that no corpus exceeds.
DECIMALS = 4


def quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """numpy's quantile of values that occur so many times each."""
    order = np.argsort(values, kind="stable")
    values, until = values[order], np.cumsum(counts[order])
    at = q * (until[-1] - 1)
    low = values[np.searchsorted(until, np.floor(at), side="right")]
    high = values[np.searchsorted(until, np.ceil(at), side="right")]
    return float(low + (high - low) * (at - np.floor(at)))


def limits(good: np.ndarray, bad: np.ndarray, low: float, high: float, fit: Fit, n_good: np.ndarray, n_bad: np.ndarray) -> tuple[float, float]:
    """low and high, drawn in to the good ones where that reaches bad ones. n_good, n_bad: how often each figure occurs."""
    if n_good.sum() < fit.least or not n_bad.sum():
        return low, high
    near, far = quantile(good, n_good, fit.outside) - fit.margin, quantile(good, n_good, 1 - fit.outside) + fit.margin
    share = lambda test: n_bad[test].sum() / n_bad.sum()
    return (max(low, near) if share(bad < near) >= fit.caught else low), (min(high, far) if share(bad > far) >= fit.caught else high)


def band_edges(policy: QualityPolicy) -> list[int]:
    return sorted({x.min_bytes for x in policy.bands} | {round(256 * 2 ** (k / 2)) for k in range(2, 21)})


def fitted(sizes: np.ndarray, ratios: np.ndarray, least: np.ndarray, most: np.ndarray, good: np.ndarray, policy: QualityPolicy, fit: Fit, counts: np.ndarray | None = None) -> QualityPolicy:
    """The policy with bands of half octaves, each with the limits of its own rows, and limits for chunks. least, most: of a
    text's chunks, nan where there is none. counts: how many documents a row stands for, one if not given."""
    counts = np.ones(len(sizes), np.int64) if counts is None else counts
    drawn = lambda values, rows, low, high: limits(values[rows & good], values[rows & ~good], low, high, fit, counts[rows & good], counts[rows & ~good])
    edges = band_edges(policy)
    bands = []
    for edge, stop in zip(edges, [*edges[1:], np.inf], strict=True):
        inside = (sizes >= edge) & (sizes < stop) & ~np.isnan(ratios)
        wide = band_for(edge, policy.bands)
        if wide:
            bands.append(Band(edge, *drawn(ratios, inside, wide.low, wide.high)))
    low, _ = drawn(least, ~np.isnan(least), policy.chunk_low, policy.chunk_high)
    _, high = drawn(most, ~np.isnan(most), policy.chunk_low, policy.chunk_high)
    return replace(policy, bands=tuple(bands), chunk_low=low, chunk_high=high)


def fitted_policy(docs: DataFrame, labels: DataFrame, policy: QualityPolicy | None = None, fit: Fit | None = None) -> QualityPolicy:
    """The policy for these documents, by all that are labelled. docs: doc_id, text; labels: doc_id, quality (0 or 1).

    Each document is judged and its figures are joined to the labels; the driver gets how often each figure occurs, by range of lengths and label."""
    policy, fit = policy or QualityPolicy(), fit or Fit()
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    # figures of all documents are written first, so that the join moves no text; it is never a broadcast, as labels grow with documents
    verdicts = docs.where("doc_id IS NOT NULL").select("doc_id", quality_verdict(F.col("text"), policy).alias("v"))
    judged = settle(verdicts.select("doc_id", "v.base_failed", "v.n_bytes", "v.ratio", "v.chunk_least", "v.chunk_most"), "quality-figures").join(told.hint("merge"), "doc_id")
    one = judged.where("NOT base_failed").groupBy("doc_id", "good").agg(F.min(F.struct("n_bytes", "ratio", "chunk_least", "chunk_most")).alias("v"))
    band = F.lit(-1)
    for edge in band_edges(policy):
        band = F.when(F.col("v.n_bytes") >= edge, edge).otherwise(band)
    none = F.lit(None).cast("double")
    figure = lambda at, *values: F.struct(at.cast("int").alias("band"), *(F.round(x, DECIMALS).alias(name) for name, x in zip(("ratio", "least", "most"), values, strict=True)))
    figures = F.array(figure(band, F.col("v.ratio"), none, none), figure(F.lit(-1), none, F.col("v.chunk_least"), none), figure(F.lit(-1), none, none, F.col("v.chunk_most")))
    found = one.select("good", F.explode(figures).alias("f")).where("coalesce(f.ratio, f.least, f.most) IS NOT NULL").groupBy("good", "f").agg(F.count("*").alias("n")).select("good", "f.*", "n").toArrow()
    column = lambda name: found.column(name).to_numpy().astype(float)
    return fitted(column("band"), column("ratio"), column("least"), column("most"), column("good") > 0, policy, fit, column("n").astype(np.int64))


def op6_quality_rules(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """With labels (doc_id, quality) the limits are fitted to them."""
    policy = None if labels is None else fitted_policy(docs, labels)
    judged = docs.select("doc_id", quality_verdict(F.col("text"), policy).alias("verdict"))
    return judged.select("doc_id", "verdict.*")
