"""Best-fit packing of tokenized documents by bin completion.

Documents are tokenized once and cut only where they are longer than a sequence; what is kept of a piece is its length
and check sum. Pieces of one length are alike to the packing, so the whole problem is the histogram of lengths: at most
`capacity` numbers, whatever the corpus, and only that reaches the driver. There a branch-and-bound search packs it:
the largest length left opens a sequence, the undominated fillings of what remains beside it are tried in the order of
their waste, a filling being used for as many sequences at once as the counts allow; branches are cut where their waste
exceeds what a better solution than the incumbent could have. The first incumbent is best-fit decreasing. The search
ends at the lower bound, or when no branch waits, or after the first dive that brings it to `max_nodes` fillings or twice
the number of different lengths, if that is more: a dive is never broken off, so some end however many lengths there are.
The plan says what the bound was, how many fillings were tried and whether branches were left; `pack` logs it.

The plan, a few numbers per filling, goes back to the pieces, which are numbered within their length (in salted groups,
as one length may have most of the rows) and so find their sequence and place.

Null text counts as empty: a document of the end mark alone. Rows are kept as they are; repeated ids are packed as often
as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import logging
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.workers import give_back
from millrace.runtime import settle

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class PackPolicy:
    """tokenizer: the file's path, or None for the public one. end_id closes each document. A worker keeps the tokens
    of 2 ** cache_bits pieces at most; chunks of more than longest_merged bytes go to the tokenizer itself; texts are
    tokenized group_bytes at a time."""

    tokenizer: str | None = None
    capacity: int = 4096
    end_id: int = 1
    max_nodes: int = 4_000
    cache_bits: int = 17
    longest_merged: int = 256
    group_bytes: int = 1 << 18


# Tokens

#: The pieces that the pair tables stand for: what the tokenizer file must say for them to be used.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
NONE = np.iinfo(np.int32).max
LETTER, DIGIT, OTHER, GAP, FOREIGN = range(5)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def byte_classes() -> np.ndarray:
    """What each byte of a chunk is to the splitting. Chunks with FOREIGN bytes are left to the tokenizer itself: ASCII
    controls, the apostrophe (contractions), × and ÷, and all letters beyond Latin-1, whose lead bytes are not 0xC3."""
    out = np.full(256, FOREIGN, np.uint8)
    out[0x21:0x7F] = OTHER
    out[ord("0") : ord("9") + 1] = DIGIT
    for first, last in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xBF), (0xC3, 0xC3)):
        out[first : last + 1] = LETTER
    out[[ord("'"), 0x97, 0xB7]] = FOREIGN
    out[list(b" \t\n\r\x0b\x0c")] = GAP
    return out


def byte_lower() -> np.ndarray:
    """Small letters of ASCII and, by the second byte after 0xC3, of Latin-1."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    out[0x80:0x9F] += 32
    return out


CLASS, SMALL = byte_classes(), byte_lower()


class PairTable:
    """The merges of a byte-pair encoding with word ends, for very many short pieces at once.

    All pieces lie end to end; in each round every piece merges its pair of the least rank wherever it stands, until no
    piece has one. Each merge makes a token of its own, so a pair never ranks before the merges that made its sides, and
    the order among equal pairs doesn't matter but for overlaps, which go from left to right."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters], np.int32)
        self.last = np.array([vocabulary[x + WORD_END] for x in letters], np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # shift, key, rank, whether more follow
        ranks, bits = np.arange(len(keys), dtype=np.int32), max(4, int(len(keys)).bit_length() + 2)
        while len(keys):
            held, rank, more = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, bool)
            slots = self.slots(keys, 64 - bits)
            _, first = np.unique(slots, return_index=True)
            held[slots[first]], rank[slots[first]] = keys[first], ranks[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            more[slots[rest]] = True
            self.levels.append((64 - bits, held, rank, more))
            keys, ranks, bits = keys[rest], ranks[rest], bits - 1

    @staticmethod
    def slots(keys: np.ndarray, shift: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        shift, held, rank, more = self.levels[0]
        slots = self.slots(keys, shift)
        out = np.where(held[slots] == keys, rank[slots], NONE)
        left_over = np.flatnonzero(more[slots] & (out == NONE))
        for shift, held, rank, more in self.levels[1:]:
            if not len(left_over):
                break
            asked = keys[left_over]
            slots = self.slots(asked, shift)
            found = held[slots] == asked
            out[left_over[found]] = rank[slots[found]]
            left_over = left_over[more[slots] & ~found]
        return out

    def merge(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: bytes of pieces laid end to end, first: where each begins. Their tokens likewise, and how many each has."""
        tokens = self.inner[raw]
        sizes = np.diff(np.append(first, len(raw)))
        tokens[first + sizes - 1] = self.last[raw[first + sizes - 1]]
        out, counts = np.full(len(raw), -1, np.int32), np.zeros(len(first), np.int64)
        piece, begin = np.arange(len(first)), first
        while len(piece):
            ranks = np.full(len(tokens), NONE, np.int32)
            ranks[:-1] = self.ranks(tokens[:-1], tokens[1:])
            ranks[begin + sizes - 1] = NONE
            least = np.minimum.reduceat(ranks, begin)
            if (done := least == NONE).any():
                where, number = np.repeat(done, sizes), sizes[done]
                inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                out[np.repeat(first[piece[done]], number) + inside] = tokens[where]
                counts[piece[done]] = number
                tokens, ranks = tokens[~where], ranks[~where]
                piece, sizes, least = piece[~done], sizes[~done], least[~done]
                if not len(piece):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            if (at[1:] == at[:-1] + 1).any():  # a pair of equal sides in a row: every second one
                starts = np.concatenate(([True], at[1:] != at[:-1] + 1))
                run = at[starts][np.cumsum(starts) - 1]
                at = at[(at - run) % 2 == 0]
            owner = np.repeat(np.arange(len(sizes)), sizes)[at]
            tokens[at] = self.made[ranks[at]]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens = tokens[keep]
            sizes = sizes - np.bincount(owner, minlength=len(sizes))
            begin = np.cumsum(sizes) - sizes
        return out[out >= 0], counts


@functools.lru_cache(maxsize=1)
def pair_table(path: str) -> PairTable | None:
    """The tables of a tokenizer file, or None if it isn't of the form that they stand for."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, normal, before = said["model"], said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    steps = [x["type"] for x in normal.get("normalizers", [])]
    parts = before.get("pretokenizers", [])
    plain = [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": SPLIT} and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or steps != ["NFC", "Replace", "Lowercase"] or not plain or model.get("dropout") or model.get("ignore_merges"):
        return None
    merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    return PairTable(model["vocab"], merges) if len({a + b for a, b in merges}) == len(merges) else None


@functools.lru_cache(maxsize=1)
def tokenizer_of(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenizer_path(policy: PackPolicy) -> str:
    if policy.tokenizer is not None:
        return policy.tokenizer
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


WHOLE = 16  # bytes of a piece that can be kept
TOKENS = 8  # tokens of a piece that can be kept
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class PieceCache:
    """Tokens of pieces of at most WHOLE bytes and TOKENS tokens, found by the bytes themselves. A piece has one slot,
    and a new one there replaces the old, so the cache never grows."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.count = np.zeros(1 << bits, np.int64)
        self.tokens = np.zeros((1 << bits, TOKENS), np.int32)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def put(self, slots: np.ndarray, low: np.ndarray, high: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        fit = np.flatnonzero(counts <= TOKENS)
        _, last = np.unique(slots[fit][::-1], return_index=True)  # of several pieces in one slot one stays
        fit = fit[len(fit) - 1 - last]
        slots, counts, first = slots[fit], counts[fit], (ends - counts)[fit]
        self.low[slots], self.high[slots], self.count[slots] = low[fit], high[fit], counts
        reach = np.minimum(first[:, None] + np.arange(TOKENS), max(len(tokens) - 1, 0))
        self.tokens[slots] = tokens[reach]


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .. (counts[0] numbers), first[1], .."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class ChunkTokenizer:
    """Tokenizes texts through their chunks between ASCII blanks.

    The tokenizer's own splitting never crosses a blank, nor do its normal forms, so a text's ids are those of its
    chunks one after another. Chunks of Latin-1 letters, digits and marks are split into pieces and merged by the pair
    table, very many at once, the tokens of short pieces being kept; the tokenizer itself does the other chunks, and all
    texts if its file is of another form. Texts are taken some at a time and long ones in parts, so that memory doesn't
    follow their length."""

    def __init__(self, policy: PackPolicy):
        self.policy, self.path = policy, tokenizer_path(policy)
        self.table = pair_table(self.path)
        self.cache = PieceCache(policy.cache_bits)

    def asked(self, texts: list[str]) -> list[np.ndarray]:
        """What the tokenizer itself says."""
        done = tokenizer_of(self.path).encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, np.int32) for x in done]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        if self.table is None:
            for text in texts:
                yield self.asked([text or ""])[0].astype("<u4").tobytes()
            return
        parts: list[bytes] = []
        closes: list[bool] = []
        size, held = 0, b""
        for text in texts:
            for raw, last in segments((text or "").encode("utf-8", "surrogatepass"), self.policy.group_bytes):
                parts.append(raw)
                closes.append(last)
                size += len(raw)
                if size >= self.policy.group_bytes:
                    for ids, whole in zip(self.encoded(parts), closes, strict=True):
                        held += ids
                        if whole:
                            yield held
                            held = b""
                    parts, closes, size = [], [], 0
        for ids, whole in zip(self.encoded(parts), closes, strict=True):
            held += ids
            if whole:
                yield held
                held = b""

    def encoded(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part."""
        if not parts:
            return []
        joined = b"\n".join(parts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        kind = CLASS[raw]
        body = kind != GAP
        chunk_begins = body.copy()
        chunk_begins[1:] &= ~body[:-1]
        first = np.flatnonzero(chunk_begins)
        bounds = np.cumsum([len(x) + 1 for x in parts])
        if not len(first):
            return [b""] * len(parts)
        stops = np.flatnonzero(body[:-1] & ~body[1:]) + 1
        marks = (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        odd = np.maximum.reduceat(kind, first) == FOREIGN
        odd |= stops - first > self.policy.longest_merged
        if marks.any():
            odd[np.searchsorted(first, np.flatnonzero(marks), side="right") - 1] = True
        begins = body.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        if odd.any():  # such a chunk is one piece
            inner = ragged(first[odd] + 1, (stops - first)[odd] - 1)
            begins[inner] = False
        start = np.flatnonzero(begins)
        size = np.minimum(np.append(start[1:], len(raw)), stops[np.searchsorted(first, start, side="right") - 1]) - start
        strange = odd[np.searchsorted(first, start, side="right") - 1] if odd.any() else np.zeros(len(start), bool)
        small = np.concatenate((SMALL[raw], np.zeros(WHOLE, np.uint8)))
        words = np.ndarray((len(raw) + 8,), "<u8", small, strides=(1,))
        low = words[start] & MASKS[np.minimum(size, 8)]
        high = words[start + 8] & MASKS[np.clip(size - 8, 0, 8)]
        slots = self.cache.slots(low, high)
        kept = size <= WHOLE
        hit = kept & ~strange & (self.cache.low[slots] == low) & (self.cache.high[slots] == high)
        counts, at = np.where(hit, self.cache.count[slots], 0), slots * TOKENS
        pool = [self.cache.tokens.ravel().copy()]
        pooled = len(pool[0])
        new = np.flatnonzero(~hit & ~strange)
        if len(new):
            inside = ragged(start[new], size[new])
            tokens, number = self.table.merge(small[inside], np.cumsum(size[new]) - size[new])
            counts[new], at[new] = number, pooled + np.cumsum(number) - number
            pool.append(tokens)
            pooled += len(tokens)
            short = kept[new]
            self.cache.put(slots[new][short], low[new][short], high[new][short], tokens[ragged((np.cumsum(number) - number)[short], number[short])], number[short])
        if strange.any():
            where = np.flatnonzero(strange)
            found = self.asked([joined[a : a + n].decode("utf-8", "replace") for a, n in zip(start[where].tolist(), size[where].tolist(), strict=True)])
            number = np.array([len(x) for x in found], np.int64)
            counts[where], at[where] = number, pooled + np.cumsum(number) - number
            pool += found
        ids = np.concatenate(pool)[ragged(at, counts)].astype("<u4").tobytes()
        ends = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(start, bounds)] * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, text: str | None) -> bytes:
        return next(iter(self.encode_all([text])))


def segments(raw: bytes, size: int) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about size bytes, cut at blanks, and whether a part is the last."""
    at = 0
    while len(raw) - at > 2 * size and (found := BLANK.search(raw, at + size)):
        yield raw[at : found.start()], False
        at = found.end()
    yield (raw[at:] if at else raw), True


BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def token_pieces(docs: DataFrame, policy: PackPolicy) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = ChunkTokenizer(policy), np.array([policy.end_id], "<u4").tobytes()
        step = 4 * policy.capacity
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for row, ids in enumerate(tokenizer.encode_all(x.as_py() for x in batch.column("text"))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        del tokenizer
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


# The plan

Filling = tuple[int, ...]


@dataclass
class Plan:
    """fillings: (lengths in one sequence, number of such sequences); bound: the least number of sequences there can be;
    nodes: fillings tried; cut: whether the search left branches that might hold a better plan."""

    fillings: list[tuple[Filling, int]] = field(default_factory=list)
    bound: int = 0
    nodes: int = 0
    cut: bool = False

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing over the histogram; sequences that are filled alike are kept as one entry with a number."""
    open_: dict[int, list[list]] = {}  # room left: [lengths, number]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                whole, rest = divmod(left, per)
                for number, held in ((whole, per), (1 if rest else 0, rest)):
                    if number:
                        open_.setdefault(capacity - held * length, []).append([(length,) * held, number])
                break
            entry = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(left, entry[1])
            open_.setdefault(room - length, []).append([(*entry[0], length), used])
            if used < entry[1]:
                open_.setdefault(room, []).append([entry[0], entry[1] - used])
            left -= used
    return Plan([(tuple(x), n) for entries in open_.values() for x, n in entries])


def fits_into(items: Filling, bins: Filling) -> bool:
    """Whether items can be dealt into bins of these sizes."""
    if not items:
        return True
    return any(items[0] <= room and fits_into(items[1:], (*bins[:i], room - items[0], *bins[i + 1 :])) for i, room in enumerate(bins))


def undominated(found: list[Filling], limit: int) -> list[Filling]:
    """The first fillings, the fullest first, without those whose items can be dealt into another's: the other is never the
    worse choice."""
    kept: list[Filling] = []
    for x in sorted(set(found), key=lambda x: (-sum(x), len(x), tuple(-y for y in x))):
        if len(kept) == limit:
            break
        if not any(fits_into(x, y) for y in kept):
            kept.append(x)
    return kept


def least_pair_waste(sizes: np.ndarray, spare: np.ndarray, gap: int, used: int = 0) -> int:
    """What the best pair of lengths leaves of gap; gap itself where no pair fits. One piece of length used is taken."""
    seconds = np.searchsorted(sizes, np.minimum(gap - sizes, sizes), side="right") - 1
    ok = (seconds >= 0) & (gap - sizes > 0)
    firsts, seconds = sizes[ok], sizes[seconds[ok]]
    enough = 1 + (firsts == seconds) + (firsts == used) <= spare[firsts]
    return int((gap - firsts - seconds)[enough].min()) if enough.any() else gap


def fillings(counts: np.ndarray, gap: int, limit: int = 3, widest: int = 64) -> list[Filling]:
    """Undominated fillings of gap from the lengths left, best first. All items but three at most are the largest ones
    that fit, which keeps the list short where many small ones are needed."""
    forced: list[int] = []
    spare = counts
    while True:
        sizes = np.flatnonzero(spare[: gap + 1])
        if len(sizes) == 0:
            return [tuple(forced)]
        top = int(sizes[-1])
        if 3 * top >= gap:
            break
        take = min(int(spare[top]), max(1, (gap - 2 * top) // top))
        if spare is counts:
            spare = counts.copy()
        spare[top] -= take
        forced += [top] * take
        gap -= take * top
    if spare[gap]:
        return [(*forced, gap)]
    present = spare[: gap + 1] > 0
    least = min(gap - top, least_pair_waste(sizes, spare, gap))
    thirds = sizes[3 * sizes >= gap][::-1][:widest].tolist() if least else []
    if thirds:
        least = min(least, *(least_pair_waste(sizes, spare, gap - a, a) for a in thirds))
    found: list[Filling] = []
    for waste in range(least, min(least + 8, gap)):
        target = gap - waste
        if present[target]:
            found.append((target,))
        firsts = np.arange(target - 1, (target + 1) // 2 - 1, -1)
        for a in firsts[present[firsts] & present[target - firsts]][:limit].tolist():
            if a != target - a or spare[a] > 1:
                found.append((a, target - a))
        for a in thirds if len(found) < limit else []:
            rest = target - a
            seconds = np.arange(min(a, rest - 1), (rest + 1) // 2 - 1, -1)
            for b in seconds[present[seconds] & present[rest - seconds]][:1].tolist():
                trio = (a, b, rest - b)
                if all(spare[x] >= trio.count(x) for x in trio):
                    found.append(trio)
        if len(found) >= limit:
            break
    if not found:  # what the bounds promised needs more pieces of a length than there are
        found.append((top,))
    return [(*forced, *x) for x in undominated(found, limit)]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The greater of the volume bound and the bound from lengths of which no two share a sequence."""
    lengths = np.arange(capacity + 1)
    volume = -(-int((lengths * counts).sum()) // capacity)
    return max(volume, int(counts[capacity // 2 + 1 :].sum()))


def complete(counts: np.ndarray, policy: PackPolicy) -> Plan:
    """The packing of a histogram: counts[n] pieces of length n."""
    capacity = policy.capacity
    lengths = np.arange(capacity + 1)
    bound, total = lower_bound(counts, capacity), int((lengths * counts).sum())
    best = best_fit(counts, capacity)
    nodes, budget = 0, max(policy.max_nodes, 2 * int((counts > 0).sum()))
    left, done, used, waste = counts.copy(), [], 0, 0
    branches: list[tuple[int, Filling]] = [(0, ())]  # the latest first: each waits at a depth of the path that is walked
    while branches and best.sequences > bound and nodes < budget:
        depth, filling = branches.pop()
        while len(done) > depth:  # back to where the branch leaves the path
            last, times = done.pop()
            for x in last:
                left[x] += times
            used, waste = used - times, waste - times * (capacity - sum(last))
        if filling:
            left, done, used, waste = used_up(left, done, used, waste, filling, capacity)
        while True:
            sizes = np.flatnonzero(left)
            if len(sizes) == 0:
                if used < best.sequences:
                    best = Plan(list(done))
                break
            nodes += 1
            if waste > (best.sequences - 1) * capacity - total:
                break
            top = int(sizes[-1])
            left[top] -= 1
            options = fillings(left, capacity - top)
            left[top] += 1
            # the best is followed at once, the others wait
            branches += [(len(done), (top, *other)) for other in options[:0:-1]]
            left, done, used, waste = used_up(left, done, used, waste, (top, *options[0]), capacity)
    return Plan(best.fillings, bound, nodes, bool(branches) and best.sequences > bound)


def used_up(left: np.ndarray, done: list, used: int, waste: int, filling: Filling, capacity: int) -> tuple[np.ndarray, list, int, int]:
    """The state after a filling is used for as many sequences as its lengths are there."""
    sizes, needs = np.unique(np.array(filling), return_counts=True)
    times = int((left[sizes] // needs).min())
    left[sizes] -= needs * times
    done.append((filling, times))
    return left, done, used + times, waste + times * (capacity - sum(filling))


@dataclass
class Places:
    """The plan by length: from number `rank` of a length on, sequences `sequence`.. hold `each` of it from `offset`."""

    key: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    SPAN = 1 << 50

    @classmethod
    def of(cls, plan: Plan) -> Places:
        rows, ranks, base = [], {}, 0
        for filling, times in plan.fillings:
            offset = 0
            for length in sorted(set(filling), reverse=True):
                each = filling.count(length)
                rank = ranks.get(length, 0)
                rows.append((length * cls.SPAN + rank, rank, base, each, offset))
                ranks[length] = rank + each * times
                offset += each * length
            base += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return cls(*table.T)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, lengths * self.SPAN + ranks, side="right") - 1
        past = ranks - self.rank[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * lengths


def pack(docs: DataFrame, policy: PackPolicy | None = None) -> DataFrame:
    policy = policy or PackPolicy()
    pieces = settle(token_pieces(docs, policy), "pieces")
    counts = np.zeros(policy.capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # a row per length: at most `capacity`
        counts[row["length"]] = row["count"]
    plan = complete(counts, policy)
    LOG.info("packing: %d sequences, bound %d, %d nodes, search %s", plan.sequences, plan.bound, plan.nodes, "cut" if plan.cut else "ended")
    places = Places.of(plan)
    salts = int(min(max(counts.sum() // 200_000, 16), 4096))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    numbered = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = numbered.join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        sequence, offset = places.find(lengths.to_numpy(zero_copy_only=False).astype(np.int64), ranks.to_numpy(zero_copy_only=False).astype(np.int64))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    place.__annotations__ = {"lengths": pa.Array, "ranks": pa.Array, "return": pa.Array}
    placed = ranked.withColumn("place", F.arrow_udf(place, "sequence_id long, offset long")("length", "rank"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "place.sequence_id", "place.offset")


def op7_best_fit_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
