"""Long repeats through a run-length index.

A byte goes if some `length`-byte string that covers it also starts in a document with a smaller id.

Which strings can repeat. Each such string has a least hash among the 16-byte grams in it, and a first place of that
gram, both of which depend on its bytes alone; beside the gram it holds at least 17 bytes more on one side, on the right
if the gram begins in its first 18 bytes, else on the left. The hash of these 33 bytes is the string's key, which equal
strings share. Neighbouring strings mostly have the same 33 bytes; a run of them (at most 18) is a phrase, a piece of a
text of `length` - 1 bytes more than it has strings. Each string lies in one phrase. Round one finds the keys that occur
in two or more documents; other phrases hold nothing that repeats. Keys travel as 32 bits within their bucket, so that a
few that don't occur again may come along; what follows compares bytes.

The dictionary. Round two brings together, by key, the phrases that are left: equal ones are one entry, with the least
id that has it. In a repetitive corpus the entries are few beside the text. A document with a greater id than an entry's
loses all strings of that phrase. Within an entry's own first document, strings may still repeat ones of other entries
of the same key; those entries are put into the index: a suffix sort of their texts gives the Burrows-Wheeler
transform, which is kept as runs, and beside it the least id in the range of each string. (What is asked of a match is
the least id that has it, not a place, so no places are sampled at the runs' ends.) Matching statistics, cut at
`length`, are streamed over the entries from right to left, all entries abreast: a backward search over the runs finds
the last string, each further byte extends the match to the left by one step of the same kind, after which the range
widens to that of the string. A range whose least id is smaller marks the string.

Round three carries ids and marks back, where they differ from what the batch knows itself, and cuts the texts.

Rows are dealt to batches by their id and phrases to buckets by their key, both in numbers that follow the corpus, and
a batch reports a key or phrase once, however often its documents have it: a passage that a third of all rows share is
one entry per batch. Nothing but byte counts reaches the driver.

Null text counts as empty. Rows of one id don't take from each other; rows with a null id count as after all others and
don't take from each other either, as do rows with the id 2^63 - 1. Ids that aren't integers are ordered by their hash.
Texts of any length are taken whole, each by one task. Other columns are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 16
#: Bytes of a key beside its gram, and the strings that have one key's bytes on the same side.
BESIDE = 17
MOST_STRINGS = BESIDE + 1
SIDE = 128
#: Bytes of an entry before its text.
HEAD = 10
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class RepeatPolicy:
    length: int = 50
    batch_bytes: int = 8 << 20
    most_batch_bytes: int = 256 << 20

    def __post_init__(self):
        if not GRAM + 2 * BESIDE <= self.length < 256:
            raise ValueError(f"repeats of {GRAM + 2 * BESIDE} to 255 bytes can be found")


# Phrases


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each place on."""
    n = len(raw) - 7
    words = np.empty(n, np.uint64)
    for at in range(min(8, n)):
        words[at::8] = raw[at : at + (n - at + 7) // 8 * 8].view("<u8")
    out = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out += words[8:]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(31)
    return out


def least_grams(raw: np.ndarray, length: int) -> np.ndarray:
    """For each string of length bytes the first place in it of the least of its grams."""
    value, have, want = gram_hashes(raw), 1, length - GRAM + 1
    place = np.zeros(len(value), np.uint8)
    while have < want:
        step = min(have, want - have)
        left, right = value[:-step], value[step:]
        later = right < left
        value = np.where(later, right, left)
        place = np.where(later, place[step:] + np.uint8(step), place[:-step])
        have += step
    return place


def key_hashes(raw: np.ndarray, at: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A hash of the GRAM + BESIDE bytes from each of these places on, and of the side."""
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    out = side.astype(np.uint64)
    for step in (*range(0, GRAM + BESIDE - 8, 8), GRAM + BESIDE - 8):
        out = (out ^ words[at + step]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@dataclass
class Block:
    """Some documents laid end to end. row, doc: of each; edge: where they begin, and the end. hashes, starts, counts,
    owner, places: of their phrases (the key's hash, first string, number of strings, which document, the key's place)."""

    row: np.ndarray
    doc: np.ndarray
    raw: np.ndarray
    edge: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    owner: np.ndarray
    places: np.ndarray


def phrases(raw: np.ndarray, edge: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the key, first string, number of strings, document, place of the key) of each phrase; no string crosses an
    edge. A place is the key's first byte, counted from the first string, and in the bit above them the side."""
    if len(raw) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)
    place = least_grams(raw, length)
    size = len(place)
    gram = np.arange(size) + place
    side = place > BESIDE
    change = np.concatenate(([True], (gram[1:] != gram[:-1]) | (side[1:] != side[:-1])))
    begins, stops = np.minimum(edge[:-1], size), np.clip(edge[1:] - length + 1, 0, size)
    # a run ends with the last string that its document holds whole: what begins there is cut off
    change[begins[begins < size]] = True
    change[stops[stops < size]] = True
    starts = np.flatnonzero(change)
    counts = np.diff(np.append(starts, size))
    owner = np.searchsorted(edge, starts, side="right") - 1
    whole = starts < stops[owner]
    starts, counts, owner = starts[whole], counts[whole], owner[whole]
    if (counts > MOST_STRINGS).any():  # of lengths beyond the least
        pieces = -(-counts // MOST_STRINGS)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + within * MOST_STRINGS
        counts = np.minimum(np.repeat(counts, pieces) - within * MOST_STRINGS, MOST_STRINGS)
        owner = np.repeat(owner, pieces)
    at, left = gram[starts] - BESIDE * side[starts], side[starts]
    return key_hashes(raw, at, left), starts, counts, owner, (at - starts + SIDE * left).astype(np.uint8)


def buckets_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    spread_out = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (spread_out >> np.uint64(33)).astype(np.int64) % buckets


def tags_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A key's bucket and, below it, 32 bits of the key."""
    return buckets_of(hashes, buckets).astype(np.uint64) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def squeezed(raw: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw).tobytes())


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers, as the bytes of their differences, the first bytes of all before the second ones."""
    return squeezed(np.diff(keys, prepend=keys[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T)


def restored_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(restored(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def restored(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def bytes_of(text: pa.Scalar) -> np.ndarray:
    raw = text.as_buffer()
    return np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)


def blocks(table: pa.Table, length: int, size: int = 1 << 18) -> Iterator[Block]:
    """The documents of a batch, some at a time."""
    ids = table.column("id").to_numpy().astype(np.int64) if table.num_rows else np.empty(0, np.int64)
    texts = (text for chunk in table.column("text").cast(pa.large_binary()).chunks for text in chunk)
    held: list[np.ndarray] = []
    first, total = 0, 0

    def block() -> Block:
        raw = np.concatenate(held)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in held])))
        rows = np.arange(first, first + len(held))
        return Block(rows, ids[rows], raw, edge, *phrases(raw, edge, length))

    for text in texts:
        held.append(bytes_of(text))
        total += len(held[-1])
        if total >= size:
            yield block()
            first, total, held = first + len(held), 0, []
    if held:
        yield block()


def spread(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The stretches of a sorted array."""
    if not len(bucket):
        return
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True):
        yield int(bucket[a]), slice(int(a), int(b))


# Round one: keys that occur in several documents


def tags_in(table: pa.Table, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Tags in one document of the batch, and those in several, both in order."""
    parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
    for block in blocks(table, length):
        owner = block.doc[block.owner]
        parts.append(extremes(tags_of(block.hashes, buckets), owner, owner))
    values, low, high = extremes(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return values[low == high], values[low != high]


def extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, with the least low and the greatest high of each."""
    if not len(values):
        return values, low, high
    order = np.argsort(values)
    values = values[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def by_bucket(tags: np.ndarray) -> dict[int, bytes]:
    """Sorted tags as the 32-bit parts of each bucket."""
    return {bucket: squeezed_keys(tags[x].astype("<u4")) for bucket, x in spread((tags >> np.uint64(32)).astype(np.int64))}


def report(table: pa.Table, batch: int, length: int, buckets: int) -> pa.Table:
    one, several = (by_bucket(x) for x in tags_in(table, length, buckets))
    return as_table([(bucket, batch, one.get(bucket, NO_KEYS), several.get(bucket, NO_KEYS)) for bucket in sorted(one.keys() | several.keys())], ROUND_ONE)


def shared_keys(table: pa.Table) -> pa.Table:
    """For each batch those of its keys that several documents have, in the batch or beyond it."""
    bucket, batches = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
    ones, many = ([restored_keys(x) for x in table.column(name).to_pylist()] for name in ("ones", "many"))
    every = np.sort(np.concatenate((*ones, *many, *many)))  # those of several documents of one batch count twice
    shared = every[1:][every[1:] == every[:-1]]
    rows = []
    for batch, own, sure in zip(batches, ones, many, strict=True):
        found = np.concatenate((own[among(own, shared)], sure))
        if len(found):
            rows.append((batch, bucket, squeezed_keys(np.sort(found)), b"", b"", b""))
    return as_table(rows, REPLY)


def tags_said(replies: pa.Table) -> np.ndarray:
    """The tags in replies, in order."""
    parts = zip(replies.column("bucket").to_pylist(), replies.column("keys").to_pylist(), strict=True)
    return np.sort(np.concatenate([np.empty(0, np.uint64), *(np.uint64(bucket << 32) | restored_keys(x).astype(np.uint64) for bucket, x in parts)]))


def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


# Round two: the dictionary and its index


def row_bytes(length: int) -> int:
    """An entry: its key's hash, its number of strings, where the key begins and on which side, its text and padding, in
    whole words."""
    return (HEAD + length - 1 + MOST_STRINGS + 7) // 8 * 8


@dataclass
class Found:
    block: Block
    starts: np.ndarray
    counts: np.ndarray
    owner: np.ndarray
    entry: np.ndarray


def entries_of(table: pa.Table, shared: np.ndarray, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[Found]]:
    """The batch's distinct phrases with a shared key, as rows of bytes in order; the least id that has each; and what
    each block of documents has of them."""
    width, every = length - 1 + MOST_STRINGS, row_bytes(length)
    rows, owners, found = [np.empty((0, every), np.uint8)], [np.empty(0, np.int64)], []
    reach = np.arange(width)
    for block in blocks(table, length):
        hit = among(tags_of(block.hashes, buckets), shared)
        hashes, starts, counts, owner = block.hashes[hit], block.starts[hit], block.counts[hit], block.owner[hit]
        part = np.zeros((len(hashes), every), np.uint8)
        part[:, :8] = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        part[:, 8] = counts
        part[:, 9] = block.places[hit]
        if len(hashes):
            padded = np.concatenate((block.raw, np.zeros(width, np.uint8)))
            body = np.lib.stride_tricks.sliding_window_view(padded, width)[starts]
            np.multiply(body, reach < (counts + length - 1)[:, None], out=part[:, HEAD : HEAD + width])
        rows.append(part)
        owners.append(block.doc[owner])
        found.append(Found(block, starts, counts, owner, np.empty(0, np.int64)))
    entries, least, entry_of = distinct_rows(np.concatenate(rows), np.concatenate(owners))
    at = 0
    for x in found:
        x.entry = entry_of[at : at + len(x.starts)]
        at += len(x.starts)
    return entries, least, found


def distinct_rows(rows: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in the order of their hash and a second one; the least owner of each; which of them each is."""
    if not len(rows):
        return rows, owner, np.empty(0, np.int64)
    words = np.ascontiguousarray(rows).view("<u8")
    second = np.zeros(len(rows), np.uint64)
    for at in range(1, words.shape[1]):
        second = (second ^ words[:, at]) * np.uint64(0x9E3779B97F4A7C15)
        second ^= second >> np.uint64(32)
    order = np.lexsort((second, hash_of(rows)))
    ranked = words[order]
    new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))
    keyed = np.concatenate(([True], (ranked[1:, 0] != ranked[:-1, 0]) | (second[order][1:] != second[order][:-1])))
    if (new != keyed).any():  # two texts of one pair of hashes: told apart by their bytes
        order = np.lexsort((np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel().argsort(kind="stable").argsort(), second, hash_of(rows)))
        ranked = words[order]
        new = np.concatenate(([True], (ranked[1:] != ranked[:-1]).any(axis=1)))
    starts = np.flatnonzero(new)
    entry = np.empty(len(rows), np.int64)
    entry[order] = np.cumsum(new) - 1
    return rows[order[starts]], np.minimum.reduceat(owner[order], starts), entry


def hash_of(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)


def dealt_out(entries: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by bucket, and their buckets in that order."""
    where = buckets_of(hash_of(entries), buckets)
    order = np.argsort(where, kind="stable")
    return order, where[order]


def offer(table: pa.Table, replies: pa.Table, batch: int, length: int, buckets: int) -> pa.Table:
    entries, least, _ = entries_of(table, tags_said(replies), length, buckets)
    order, where = dealt_out(entries, buckets)
    return as_table([(bucket, batch, squeezed(entries[order[x], 8:]), squeezed(least[order[x]])) for bucket, x in spread(where)], ROUND_TWO)


class RunIndex:
    """The Burrows-Wheeler transform of texts, each closed by a zero, as runs; with the least owner of each range of
    suffixes that agree in `length` symbols."""

    def __init__(self, texts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int):
        inside = np.arange(texts.shape[1] + 1) <= sizes[:, None]
        symbols = np.zeros((len(texts), texts.shape[1] + 1), np.uint16)
        symbols[:, :-1] = texts.astype(np.uint16) + 1
        symbols[np.arange(len(texts)), sizes] = 0
        text = symbols[inside]
        owner = np.repeat(owners, sizes + 1)
        order, agree = self.sorted_suffixes(text, length)
        before = text[order - 1]  # of the first suffix: the last zero
        new = np.concatenate(([True], before[1:] != before[:-1]))
        self.size, self.length = len(text), length
        self.start = np.flatnonzero(new)
        self.count = np.diff(np.append(self.start, self.size))
        self.symbol = before[self.start].astype(np.int64)
        by = np.lexsort((self.start, self.symbol))
        self.key = self.symbol[by] * (self.size + 1) + self.start[by]
        counts, symbols_of = self.count[by], self.symbol[by]
        ahead = np.cumsum(counts) - counts
        first = np.searchsorted(symbols_of, symbols_of)
        self.ahead, self.held = ahead - ahead[first], counts
        self.by_symbol = symbols_of
        self.smaller = np.searchsorted(np.sort(text), np.arange(258))
        self.range_start = np.flatnonzero(~agree)
        self.range_end = np.append(self.range_start[1:], self.size)
        self.range_least = np.minimum.reduceat(owner[order], self.range_start)

    @staticmethod
    def sorted_suffixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes, and whether each agrees with the one before it in length symbols (none of them
        counts as agreeing beyond the last zero)."""
        n, depth, near = len(text), 7, None
        padded = np.concatenate((text.astype(np.uint64), np.zeros(depth, np.uint64)))
        key = np.zeros(n, np.uint64)
        for at in range(depth):
            key = (key << np.uint64(9)) | padded[at : at + n]
        while True:
            order = np.argsort(key)
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], ranked[1:] != ranked[:-1])))
            if depth <= length < 2 * depth:
                near = (depth, rank.copy())
            if (rank[order[-1]] == n - 1 and near is not None) or depth > 2 * n + 2 * length:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - depth)] = rank[depth:] + 1
            key = rank.astype(np.uint64) * np.uint64(n + 1) + after.astype(np.uint64)
            depth *= 2
        depth, rank = near
        second = np.full(n, -1)
        shift = length - depth
        second[: max(0, n - shift)] = rank[shift:]
        agree = np.concatenate(([False], (rank[order][1:] == rank[order][:-1]) & (second[order][1:] == second[order][:-1]) & (second[order][1:] >= 0)))
        return order, agree

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often symbol occurs in the transform before row."""
        at = np.searchsorted(self.key, symbol * (self.size + 1) + row, side="right") - 1
        ok = (at >= 0) & (self.by_symbol[at] == symbol)
        past = symbol * (self.size + 1) + row - self.key[at]
        return np.where(ok, self.ahead[at] + np.minimum(past, self.held[at]), 0)

    def extended(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of matches that are longer by symbol on the left."""
        base = self.smaller[symbol]
        return base + self.rank(symbol, low), base + self.rank(symbol, high)

    def widened(self, low: np.ndarray) -> np.ndarray:
        """Number of the range of all suffixes that agree in length symbols with the one in row low."""
        return np.searchsorted(self.range_start, low, side="right") - 1

    def marks(self, texts: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """For each text the bits of those of its strings that also occur in a text of a smaller owner."""
        out = np.zeros(len(texts), np.uint32)
        low, high = np.zeros(len(texts), np.int64), np.full(len(texts), self.size)
        rows = np.arange(len(texts))
        for back in range(1, self.length + 1):
            low, high = self.extended(low, high, texts[rows, counts - 1 + self.length - back].astype(np.int64) + 1)
        live, at = rows, counts - 1  # the last string of each
        while len(live):
            found = self.widened(low)
            hit = self.range_least[found] < owners[live]
            out[live[hit]] |= np.uint32(1) << at[hit].astype(np.uint32)
            on = at > 0
            live, at, found = live[on], at[on] - 1, found[on]
            low, _ = self.extended(self.range_start[found], self.range_end[found], texts[live, at].astype(np.int64) + 1)
        return out


def rows_of(raw: bytes, length: int) -> np.ndarray:
    """Entries that came without their hash."""
    width = row_bytes(length)
    held = np.frombuffer(raw, np.uint8).reshape(-1, width - 8)
    out = np.empty((len(held), width), np.uint8)
    out[:, 8:] = held
    place = held[:, HEAD - 8 - 1].astype(np.int64)
    at = np.arange(len(held)) * (width - 8) + (HEAD - 8) + place % SIDE
    out[:, :8] = key_hashes(held.ravel(), at, place >= SIDE).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def resolve(table: pa.Table, length: int) -> pa.Table:
    """For each batch the keys of its entries, and for those where it differs from what the batch knows the least id of
    all batches and the marks within that id's document."""
    body = HEAD + length - 1 + MOST_STRINGS
    bucket, batches = table.column("bucket")[0].as_py(), table.column("batch").to_pylist()
    parts = [rows_of(restored(x), length) for x in table.column("entries").to_pylist()]
    known = [np.frombuffer(restored(x), np.int64) for x in table.column("least").to_pylist()]
    entries, least, entry_of = distinct_rows(np.concatenate(parts), np.concatenate(known))
    hashes, counts = hash_of(entries), entries[:, 8].astype(np.int64)
    same = hashes[1:] == hashes[:-1]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    marks = np.zeros(len(entries), np.uint32)
    if several.any():
        texts, own_counts = np.ascontiguousarray(entries[several, HEAD:body]), counts[several]
        index = RunIndex(texts, own_counts + length - 1, least[several], length)
        marks[several] = index.marks(texts, own_counts, least[several])
    rows, at = [], 0
    for batch, part, own in zip(batches, parts, known, strict=True):
        mine = entry_of[at : at + len(part)]
        at += len(part)
        news = np.flatnonzero((least[mine] != own) | (marks[mine] != 0))
        keys = np.unique(hash_of(part).astype("<u4"))
        rows.append((batch, bucket, squeezed_keys(keys), squeezed_keys(news.astype("<u4")), squeezed(least[mine[news]]), squeezed(marks[mine[news]])))
    return as_table(rows, REPLY)


# Round three


def cut(table: pa.Table, replies: pa.Table, length: int, buckets: int) -> pa.Table:
    """Per document: what goes, and the rest."""
    entries, least, found = entries_of(table, tags_said(replies), length, buckets)
    marks = np.zeros(len(entries), np.uint32)
    order, where = dealt_out(entries, buckets)
    begins = dict((bucket, x.start) for bucket, x in spread(where))
    for bucket, *news in zip(*(replies.column(x).to_pylist() for x in ("bucket", "news", "least", "marks")), strict=True):
        mine = order[begins[bucket] + restored_keys(news[0]).astype(np.int64)]
        least[mine], marks[mine] = np.frombuffer(restored(news[1]), np.int64), np.frombuffer(restored(news[2]), np.uint32)
    rows, kept = [], []
    string = np.arange(MOST_STRINGS, dtype=np.uint32)
    for x in found:
        block, doc = x.block, x.block.doc[x.owner]
        bits = np.where(least[x.entry] < doc, np.uint32(0xFFFFFFFF), np.where(least[x.entry] == doc, marks[x.entry], np.uint32(0)))
        hit = ((bits[:, None] >> string) & np.uint32(1)).astype(bool) & (np.arange(MOST_STRINGS) < x.counts[:, None])
        places = (x.starts[:, None] + np.arange(MOST_STRINGS))[hit]
        size = len(block.raw)
        depth = np.bincount(places, minlength=size + 1) - np.bincount(places + length, minlength=size + 1)
        gone = np.cumsum(depth)[:size] > 0
        for a, b in zip(block.edge[:-1].tolist(), block.edge[1:].tolist(), strict=True):
            raw, out = block.raw[a:b], gone[a:b]
            lost = int(out.sum())
            spans = int(np.count_nonzero(out[1:] & ~out[:-1]) + bool(lost and out[0])) if lost else 0
            rest = (raw[~out] if lost else raw).tobytes()
            rows.append((len(raw), lost, spans, hashlib.sha256(rest).hexdigest()))
            kept.append(rest)
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table(
        {"doc_id": table.column("doc_id"), "n_bytes": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "n_spans": pa.array(columns[2], pa.int64()), "kept_sha256": pa.array(columns[3], pa.string()), "kept": pa.array(kept, pa.binary())}
    )


NO_KEYS = squeezed_keys(np.empty(0, "<u4"))
ROUND_ONE = {"bucket": pa.int64(), "batch": pa.int64(), "ones": pa.binary(), "many": pa.binary()}
ROUND_TWO = {"bucket": pa.int64(), "batch": pa.int64(), "entries": pa.binary(), "least": pa.binary()}
REPLY = {"batch": pa.int64(), "bucket": pa.int64(), "keys": pa.binary(), "news": pa.binary(), "least": pa.binary(), "marks": pa.binary()}


def as_table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({name: pa.array(x, kind) for x, (name, kind) in zip(columns, kinds.items(), strict=True)})


def ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {'long' if kind == pa.int64() else 'binary'}" for name, kind in kinds.items())


def remove_repeats(docs: DataFrame, policy: RepeatPolicy | None = None) -> DataFrame:
    """docs: doc_id, text. Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    policy = policy or RepeatPolicy()
    length = policy.length
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col("doc_id").cast("bigint") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    docs = docs.select("doc_id", F.coalesce(number, F.lit(int(LAST))).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(max(policy.batch_bytes, math.isqrt(100 * total)), policy.most_batch_bytes)
    batches = max(1, -(-total // size))
    buckets = 3 * batches  # an index takes some twenty times its bucket's bytes
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches))).repartition(batches, "batch")

    def round_one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return report(table, key[0].as_py(), length, buckets)

    def reply_one(table: pa.Table) -> pa.Table:
        return shared_keys(table)

    def round_two(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return offer(table, replies, key[0].as_py(), length, buckets)

    def reply_two(table: pa.Table) -> pa.Table:
        return resolve(table, length)

    def round_three(table: pa.Table, replies: pa.Table) -> pa.Table:
        return cut(table, replies, length, buckets)

    for f in (round_one, round_two):
        f.__annotations__ = {}
    hashes = dealt.groupBy("batch").applyInArrow(round_one, ddl(ROUND_ONE)).groupBy("bucket").applyInArrow(reply_one, ddl(REPLY))
    entries = dealt.groupBy("batch").cogroup(hashes.groupBy("batch")).applyInArrow(round_two, ddl(ROUND_TWO))
    marks = entries.groupBy("bucket").applyInArrow(reply_two, ddl(REPLY))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return dealt.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(round_three, out)


def op10_run_index_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).drop("kept")
