"""Line dedup by a segment-partition edit join.

A line is what lies between newlines, without blanks at its ends. Lines of at least `min_chars` characters take part; with
`short_lines` all that are not blank do, those under `min_chars` with fewer edits (`short_edits`): none below 16
characters, one from there on.
A line occurrence is removed if an equal line, or one within `distance` edits, occurs before it, that is in a document
with a smaller id or further up in the same one. This is judged on the input, not on what is left of it. The removed
lines leave no empty line behind; every other line stays as it was, and a text that loses nothing is unchanged.

Equal lines are counted; edits are those of UTF-8 bytes. Each distinct line is cut into distance + 1
segments; of two lines within the distance, one holds a segment of the other in a place that its index, the lengths and
the distance confine to a few offsets. Segments and the substrings in those places meet by hash, the counts of 24
characters (which an edit changes by two at most) drop nearly all that merely share a segment inside the join itself, and
what is left is verified by an edit distance over the band of 2 * distance + 1 diagonals, held in the bits of one number
for each count of errors.

A segment that very many lines hold, as in logs and tables, doesn't pair them all: such lines are joined again by what else
they hold (busy_pairs), so that the work stays near linear in the lines.

Only DataFrame functions are used. A line that a third of all documents share is one row after the first partial sum;
where its occurrences meet the decisions, Spark may split them, as the decisions are a written table.

Null text has no lines. Rows without an id come before all others, in the order of a hash of their texts; rows that share
an id are each a document of their own, in that order too. Rows that are equal in id and text are copies of one row:
what stays in one stays in all, and what goes from one goes from all. (Where the hashes of two texts with one id fall
together, 28 bits of them for a given id, lines that are equal in text and place may both stay; none is lost.) Ids that
aren't integers are ordered by their hash. Texts of any length are taken whole. Columns besides doc_id and text are kept
as they are, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.runtime import HELD, released, settle

BLANKS = " \t\r\x0b\x0c"
LETTERS = ("aeinorst", "bcdfghlm", "kpuvwyz ", "01234567", "89.,-:/=")
#: First of the characters that stand for segments taken out of a line, and the one that stands for an edit. A line's bytes,
#: as characters, lie below both.
TAKEN, EDIT = 0x100, "\u2192"


@dataclass(frozen=True)
class LinePolicy:
    min_chars: int = 32
    distance: int = 2
    max_broadcast: int = 200_000
    short_lines: bool = False
    #: (characters from which on, edits) for lines under min_chars
    short_edits: tuple[tuple[int, int], ...] = ((16, 1),)
    #: lines that hold a segment before they are told apart by what else they hold
    bucket: int = 24
    #: characters, by the edits, up to which what is left of such lines is told apart by marking the edits
    marked: tuple[int, ...] = (0, 16, 8)

    def joins(self) -> list[tuple[int, int | None, int]]:
        """(least characters, most of the shorter line, edits) of each edit join."""
        if not self.short_lines:
            return [(self.min_chars, None, self.distance)]
        tops = [a for a, _ in self.short_edits[1:]] + [self.min_chars]
        return [(a, b, k) for (a, k), b in zip(self.short_edits, tops, strict=True)] + [(self.min_chars, None, self.distance)]


INTEGERS = ("tinyint", "smallint", "int", "bigint")


def row_key(docs: DataFrame) -> list[Column]:
    """What tells a row's text from those of other rows with its id."""
    return [F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2")]


def line_rows(docs: DataFrame, policy: LinePolicy) -> DataFrame:
    """doc_id, key1, key2, at (from 0), line, place: the lines that take part. Places are in the order of rows, then
    lines: rows without an id first, by the hash of their texts, then the others by id and by the hash of their texts."""
    whole = docs.schema["doc_id"].dataType.simpleString() in INTEGERS
    number = (F.col("doc_id") if whole else F.xxhash64("doc_id")).cast("decimal(20,0)")
    lost = F.lit("-18446744073709551617").cast("decimal(20,0)") - F.col("key1").cast("decimal(20,0)")
    first = F.when(F.col("doc_id").isNull(), lost).otherwise(number).cast("decimal(20,0)")
    tie = F.shiftrightunsigned("key1", 36) * F.lit(1 << 31)  # 28 bits of the hash, above the line's number
    keyed = docs.select("doc_id", "text", *row_key(docs))
    row = keyed.select("doc_id", "key1", "key2", "text", (first * F.lit(1 << 59).cast("decimal(18,0)") + tie.cast("decimal(18,0)")).cast("decimal(38,0)").alias("row"))
    lines = row.select("doc_id", "key1", "key2", "row", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("at", "raw"))
    cut = lines.select("doc_id", "key1", "key2", "at", F.btrim("raw", F.lit(BLANKS)).alias("line"), (F.col("row") + F.col("at")).cast("decimal(38,0)").alias("place"))
    return cut.where(F.length("line") >= (1 if policy.short_lines else policy.min_chars))


def line_id(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("id"), F.xxhash64(F.lit(1), line).alias("id2")]


def signature(line: Column) -> Column:
    """How often the line holds each of 40 characters (255 at most), a byte each, in an array of five numbers."""
    words = []
    for letters in LETTERS:
        out = F.lit(0).cast("bigint")
        for at, letter in enumerate(letters):
            out = out.bitwiseOR(F.shiftleft(F.least(F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit(""))), F.lit(255)).cast("bigint"), 8 * at))
        words.append(out)
    return F.array(*words)


def alike(a: Column, b: Column, distance: int) -> Column:
    """Whether the counts allow the distance: an edit changes two of them by one at most."""
    off = F.lit(0).cast("bigint")
    for word, letters in enumerate(LETTERS):
        byte = lambda x, at: F.shiftrightunsigned(x[word], 8 * at).bitwiseAND(F.lit(255))
        for at in range(len(letters)):
            off = off + F.abs(byte(a, at) - byte(b, at))
    return off <= 2 * distance


def segment(size: Column, index: int, parts: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment index of a line of this size; the later segments take the remainder."""
    over = size % parts
    short = ((size - over) / parts).cast("int")
    extra = F.greatest(F.lit(index) - (F.lit(parts) - over), F.lit(0))
    longer = (F.lit(index) >= F.lit(parts) - over).cast("int")
    return short * index + extra + 1, short + longer


def segment_keys(line: Column, size: Column, distance: int) -> Column:
    """Hashes of the line's own segments; line: its bytes, size: how many."""
    return F.array(*(F.xxhash64(n, F.lit(i), F.substring(line, at, width)) for n, i, at, width in own_places(size, distance)))


def probe_keys(line: Column, size: Column, distance: int) -> Column:
    """Hashes of the substrings that may be a segment of a line as long as this one or up to distance shorter; the line's
    own segments, which are substrings of this kind as well, are left out."""
    return F.array(*(F.xxhash64(n, F.lit(i), F.substring(line, at, width)) for n, i, at, width in probe_places(size, distance)))


Place = tuple[Column, int, Column, Column]


def own_places(size: Column, distance: int) -> list[Place]:
    """(size of the line, index, start, length) of the segments."""
    return [(size, i, *segment(size, i, distance + 1)) for i in range(distance + 1)]


def probe_places(length: Column, distance: int) -> list[Place]:
    """The same for the substrings that may be segments of other lines, whose sizes they have."""
    out = []
    for shorter in range(distance + 1):
        size = length - shorter
        for i in range(distance + 1):
            start, width = segment(size, i, distance + 1)
            for shift in range(max(-i, shorter - (distance - i)), min(i, shorter + (distance - i)) + 1):
                if shorter or shift:
                    out.append((size, i, start + shift, width))
    return out


def within(a: Column, b: Column, distance: int) -> Column:
    """Whether b comes from a by at most distance edits; a, b: arrays of single characters, as columns of their own (an
    expression would be taken anew at each step).

    For each number of errors a word of bits has the diagonals (place in a less place in b) that are reached with that
    many; a character of b moves them by one match, substitution or insertion, and then deletions run up the words."""
    middle, full = distance, (1 << (2 * distance + 1)) - 1

    def step(rows: Column, j: Column) -> Column:
        c = F.get(b, j)
        equal = F.lit(0)
        for d in range(-distance, distance + 1):
            equal = equal.bitwiseOR(F.when((j + d >= 0) & (F.get(a, F.greatest(j + d, F.lit(0))) == c), 1 << (d + middle)).otherwise(0))
        new = [rows["r0"].bitwiseAND(equal)]
        for e in range(1, distance + 1):
            old = rows[f"r{e - 1}"]
            moved = rows[f"r{e}"].bitwiseAND(equal).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
            new.append(moved.bitwiseAND(F.lit(full)))
        return F.struct(*(x.alias(f"r{e}") for e, x in enumerate(new)))

    start = F.struct(*(F.lit(sum(1 << (middle + d) for d in range(e + 1))).alias(f"r{e}") for e in range(distance + 1)))
    gap = F.size(a) - F.size(b)
    places = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1)).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(places, start, step, lambda rows: rows[f"r{distance}"])
    return F.when(F.abs(gap) > distance, False).otherwise(last.bitwiseAND(F.get(F.array(*(F.lit(1 << d) for d in range(2 * distance + 1))), gap + middle)) != 0)


def byte_chars(line: Column) -> Column:
    """The line's UTF-8 bytes, each as a character."""
    return F.filter(F.split(F.decode(line.cast("binary"), "ISO-8859-1"), ""), lambda x: x != "")


def distinct_lines(lines: DataFrame, policy: LinePolicy) -> DataFrame:
    """A row per distinct line: id, id2, first place, n, and for each edit join own segments and probes (null where the
    line takes no part in it). The text itself is not kept."""
    counted = lines.groupBy("line").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    raw = counted.select("first", "n", *line_id(F.col("line")), F.col("line").cast("binary").alias("raw"), F.octet_length("line").alias("size"), F.length("line").alias("chars"))
    keys = []
    for at, (least, below, distance) in enumerate(policy.joins()):
        part = F.col("chars") >= least if below is None else (F.col("chars") >= least) & (F.col("chars") < below + distance)
        keys.append(F.when(part, segment_keys(F.col("raw"), F.col("size"), distance)).alias(f"own{at}"))
        keys.append(F.when(part, probe_keys(F.col("raw"), F.col("size"), distance)).alias(f"probes{at}"))
    keyed = raw.select("id", "id2", "first", "n", *keys)
    return settle(keyed, "lines")


def close_pairs(distinct: DataFrame, lines: DataFrame, policy: LinePolicy) -> DataFrame:
    """Verified pairs of different lines: id, id2, other, other2 (both ways), of all edit joins."""
    found = [joined_pairs(distinct.select("id", F.col(f"own{at}").alias("own"), F.col(f"probes{at}").alias("probes")), lines, policy, distance) for at, (_, _, distance) in enumerate(policy.joins())]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(found) > 1 else out


def joined_pairs(distinct: DataFrame, lines: DataFrame, policy: LinePolicy, distance: int) -> DataFrame:
    """The pairs of one edit join.

    First the segments that more than the line itself hits are found, from hashes alone, without saying whose; only
    their lines are then read again and paired."""
    own = distinct.select("id", F.explode("own").alias("key"))
    probes = distinct.select("id", F.explode("probes").alias("key"))
    held = own.groupBy("key").agg(F.count("*").alias("n"))
    hit = held.join(probes.select("key", F.lit(True).alias("probed")).distinct(), "key", "left").where((F.col("n") > 1) | F.col("probed"))
    hit = settle(hit.select("key"), "segments-hit")
    hit = F.broadcast(hit) if few_rows(hit, policy) else hit
    own, probes = settle(own.join(hit, "key", "left_semi"), "own-hit"), settle(probes.join(hit, "key", "left_semi"), "probes-hit")
    wanted = settle(own.select(F.col("id").alias("want")).unionByName(probes.select(F.col("id").alias("want"))).distinct(), "lines-wanted")
    texts = lines.join(F.broadcast(wanted) if few_rows(wanted, policy) else wanted, F.xxhash64("line") == F.col("want"), "left_semi").groupBy("line").agg(F.min("place").alias("first"))
    texts = settle(texts.select(F.xxhash64("line").alias("id"), "line", "first", signature(F.col("line")).alias("sign")), "line-texts")
    busy = settle(own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > policy.bucket).select("key"), "segments-busy")
    if not busy.isEmpty():
        rare = F.broadcast(busy) if few_rows(busy, policy) else busy
        own, probes = own.join(rare, "key", "left_anti"), probes.join(rare, "key", "left_anti")
    signs = texts.select("id", "sign")
    left = settle(own.join(signs, "id"), "own-signs").hint("merge")
    right = settle(own.unionByName(probes).join(signs, "id").select("key", F.col("id").alias("probe_id"), F.col("sign").alias("probe_sign")), "probe-signs").hint("merge")
    pairs = left.join(right, (left.key == right.key) & (F.col("id") != F.col("probe_id")) & alike(F.col("sign"), F.col("probe_sign"), distance)).select("id", F.col("probe_id").alias("other"))
    if not busy.isEmpty():
        pairs = pairs.unionByName(busy_pairs(texts, busy, policy, distance))
    pairs = settle(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "line-pairs")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    both = settle(both.select("x", "y").repartition("x", "y"), "lines-paired").select("x", "y", byte_chars(F.col("x")).alias("xs"), byte_chars(F.col("y")).alias("ys"))
    # edits of characters are at most as many as of bytes: the built-in bound spares most pairs the exact count
    near = F.levenshtein("x", "y", distance) >= 0
    checked = settle(both.select("x", "y", F.when(near, within(F.col("xs"), F.col("ys"), distance)).otherwise(False).alias("close")), "lines-checked").where("close")
    one = checked.select(*line_id(F.col("x")), F.xxhash64("y").alias("other"), F.xxhash64(F.lit(1), "y").alias("other2"))
    return one.unionByName(one.select(F.col("other").alias("id"), F.col("other2").alias("id2"), F.col("id").alias("other"), F.col("id2").alias("other2")))


def busy_pairs(texts: DataFrame, busy: DataFrame, policy: LinePolicy, distance: int) -> DataFrame:
    """id, other: the pairs that meet in segments which very many lines hold, as candidates.

    Of two lines within the distance that share a segment in its place, what is left without it is within the distance too.
    So these lines are joined again, by segments of what is left, together with all that hold the segment; and again, as
    long as a segment is shared by very many. What is left gets shorter by a third or half each time. Where it is short,
    the lines are grouped by it with the edits marked: two strings are within the distance if and only if they are equal with
    as many marks, each instead of a character or between two. In such a group all are alike, so each is paired with the
    group's first line alone. No line is compared with all that share a part with it, however many do."""
    whole = texts.select(F.lit(0).cast("bigint").alias("within"), "id", "first", F.decode(F.col("line").cast("binary"), "ISO-8859-1").alias("rest"), F.lit(True).alias("own"), F.col("line").cast("binary").alias("raw"))
    rows, short, rare, level = placed(whole, distance, F.col("raw"), []), [], [], 0
    known = F.broadcast(busy) if few_rows(busy, policy) else busy
    while True:
        gap = F.lit(chr(TAKEN + level))
        left = rows.join(known, "key").select(F.col("key").alias("within"), "id", "first", "own", F.concat(F.substring("rest", F.lit(1), F.col("at") - 1), gap, F.substring(F.col("rest"), F.col("at") + F.col("width"), F.length("rest"))).alias("rest"))
        items = settle(left.groupBy("within", "id", "rest").agg(F.max("own").alias("own"), F.min("first").alias("first")), "busy-lines")
        brief = F.length("rest") <= policy.marked[distance]
        short.append(items.where(brief))
        rows = settle(placed(items.where(~brief), distance, F.col("rest"), ["within"]), "busy-segments")
        busy = settle(rows.where("own").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > policy.bucket).select("key"), "segments-busy")
        if busy.isEmpty():
            rare.append(rows)
            break
        known = F.broadcast(busy) if few_rows(busy, policy) else busy
        rare.append(rows.join(known, "key", "left_anti"))
        level += 1
    # keys tell what lies around the segment, so those of all levels can meet in one join
    every = rare[0]
    for more in rare[1:]:
        every = every.unionByName(more)
    one = every.where("own").select("key", "id", "rest")
    other = every.select("key", F.col("id").alias("other"), F.col("rest").alias("other_rest"))
    pairs = one.join(other, (one.key == other.key) & (F.col("id") != F.col("other")) & (F.levenshtein("rest", "other_rest", distance) >= 0)).select("id", "other")
    brief = short[0]
    for more in short[1:]:
        brief = brief.unionByName(more)
    return pairs.unionByName(marked_pairs(brief, distance))


def placed(items: DataFrame, distance: int, body: Column, keys: list[str]) -> DataFrame:
    """items with a row for each segment and each substring that may be one: key, at (from 1), width, own. Only the segments of
    items that are own are own themselves."""
    size = F.octet_length(body) if not keys else F.length(body)
    part = lambda place, own: F.struct(F.xxhash64(*keys, place[0], F.lit(place[1]), F.substring(body, place[2], place[3])).alias("key"), place[2].cast("int").alias("at"), place[3].cast("int").alias("width"), own.alias("own"))
    parts = F.array(*(part(x, F.col("own")) for x in own_places(size, distance)), *(part(x, F.lit(False)) for x in probe_places(size, distance)))
    return items.select("id", "first", "rest", F.explode(parts).alias("p")).select("id", "first", "rest", "p.*")


def marked_pairs(items: DataFrame, distance: int) -> DataFrame:
    """id, other: each item with the first of those that are equal to it with the edits marked."""

    def once(text: Column) -> Column:
        n = F.length(text)
        head = lambda i: F.substring(text, F.lit(1), i)
        tail = lambda i: F.substring(text, i + 1, n)
        put = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(head(i), F.lit(EDIT), tail(i)))
        instead = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.substring(text, i + 1, F.lit(1)) < F.lit(chr(TAKEN)))), lambda i: F.concat(head(i), F.lit(EDIT), tail(i + 1)))
        return F.concat(put, instead)

    marked = F.array("rest")
    for _ in range(distance):
        marked = F.array_distinct(F.flatten(F.transform(marked, once)))
    rows = settle(items.select("within", "id", "first", F.explode(marked).alias("marked")), "marked-lines")
    heads = rows.groupBy("within", "marked").agg(F.min(F.struct("first", "id")).alias("head"), F.count("*").alias("n")).where("n > 1").select("within", "marked", F.col("head.id").alias("other"))
    return rows.join(heads, ["within", "marked"]).where("id <> other").select("id", "other")


def few_rows(frame: DataFrame, policy: LinePolicy) -> bool:
    return frame.limit(policy.max_broadcast + 1).count() <= policy.max_broadcast


def removed_lines(docs: DataFrame, policy: LinePolicy | None = None) -> DataFrame:
    """doc_id, key1, key2 (the text's hashes), places: sorted places of the lines that go; rows that lose none are missing."""
    with released(docs.sparkSession) as kept:  # only the result is read later
        gone = found_lines(docs, policy or LinePolicy())
        kept.append(HELD[-1])
    return gone


def found_lines(docs: DataFrame, policy: LinePolicy) -> DataFrame:
    lines = line_rows(docs.select("doc_id", "text"), policy)
    distinct = distinct_lines(lines, policy)
    pairs = settle(close_pairs(distinct, lines, policy), "line-links")
    firsts = distinct.select("id", "id2", "first", "n")
    others = distinct.select(F.col("id").alias("other"), F.col("id2").alias("other2"), F.col("first").alias("near"))
    near = pairs.join(others, ["other", "other2"]).groupBy("id", "id2").agg(F.min("near").alias("near"))
    decided = firsts.join(near, ["id", "id2"], "left").withColumn("stays", F.least("first", F.coalesce("near", "first"))).where((F.col("n") > 1) | (F.col("stays") < F.col("first")))
    decided = settle(decided.select("id", "id2", "stays"), "line-decisions")
    decided = F.broadcast(decided) if few_rows(decided, policy) else decided.hint("merge")
    gone = lines.select("doc_id", "key1", "key2", "at", "place", *line_id(F.col("line"))).join(decided, ["id", "id2"]).where(F.col("place") > F.col("stays"))
    return settle(gone.groupBy("doc_id", "key1", "key2").agg(F.sort_array(F.collect_set("at")).alias("places")), "lines-removed")


def without_lines(text: Column, places: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda _, at: ~F.array_contains(places, at))
    return F.when(places.isNull() | (F.size(places) == 0), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, policy: LinePolicy | None = None, drop_emptied: bool = True) -> DataFrame:
    """docs with the repeated lines taken out of their texts, other columns as they were. A document that lost lines and
    has none left that is not blank is dropped if drop_emptied; those that lost nothing always stay."""
    policy = policy or LinePolicy()
    found, gone = with_removed(docs, policy)
    out = found.withColumn("text", without_lines(F.col("text"), F.col(gone)))
    if drop_emptied:
        out = out.where(F.col(gone).isNull() | (F.btrim("text", F.lit(BLANKS + "\n")) != ""))
    return out.drop(gone)


def with_removed(docs: DataFrame, policy: LinePolicy) -> tuple[DataFrame, str]:
    """docs with the places to remove, null where there are none, and the name of that column, which docs doesn't use."""
    names = {x: free_name(docs, f"gone_{x}") for x in ("doc_id", "key1", "key2", "places")}
    gone = removed_lines(docs, policy).select(*(F.col(x).alias(name) for x, name in names.items()))
    places = names["places"]
    few = gone.limit(policy.max_broadcast + 1).agg(F.count("*").alias("n"), F.sum(F.size(places)).alias("places")).first()
    small = few["n"] <= policy.max_broadcast and (few["places"] or 0) <= 10 * policy.max_broadcast
    own = [F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])]
    same = docs["doc_id"].eqNullSafe(gone[names["doc_id"]]) & (own[0] == gone[names["key1"]]) & (own[1] == gone[names["key2"]])
    joined = docs.join(F.broadcast(gone) if small else gone, same, "left")
    return joined.drop(names["doc_id"], names["key1"], names["key2"]), places


def free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def op3_line_dedup(docs: DataFrame, policy: LinePolicy | None = None) -> DataFrame:
    """Per document: lines, lines removed, and the digest of the text that is left."""
    found, gone = with_removed(docs.select("doc_id", "text"), policy or LinePolicy())
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select(
        "doc_id",
        F.size(F.split(text, "\n", -1)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(without_lines(text, F.col(gone)), 256).alias("kept_sha256"),
    )
