r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used and nothing is shuffled: a text's spans are found in its own row. The positions come
from splitting the text at the same matches, whose lengths and the lengths between them add up to offsets in code
points. Loops over groups are possessive and starts inside a run of candidate characters are cut off by look-behinds
(\G lets a match begin right after the one before), so that time is linear in the text and the stack stays flat; what is
matched is the same as with the plain patterns, as no later part of them could use what the loops would give back.

Null text counts as empty: no spans. Every row is judged for itself, so null or repeated ids and repeated rows don't
matter. Texts of any length are searched whole. Other columns stay as they are, whatever their names, but for one named
as the result, which it replaces. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = Callable[[Column], Column]

CONTEXT_CHARS = 40


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """number: digits only. The check digit counts from the right; every second digit is doubled."""

    def step(total: Column, at: Column) -> Column:
        d = F.substring(number, -at, F.lit(1)).cast("int")
        return total + F.when(at % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def mod97(value: Column) -> Column:
    """The remainder of an account number, its first four characters moved to the end and letters counted from 10."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def is_ip(value: Column) -> Column:
    return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")


def is_card(value: Column) -> Column:
    number = digits(value)
    return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)


def is_phone(value: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def is_iban(value: Column) -> Column:
    size = F.length(F.regexp_replace(value, " ", ""))
    return F.when(size.between(15, 34), mod97(value) == 1).otherwise(False)


def is_random(value: Column) -> Column:
    """Whether the letters' entropy (bits a letter) is that of a random string: 3 at least."""
    low, size = F.lower(value), F.length(value)
    kinds = F.filter(F.array_distinct(F.split(low, "")), lambda c: c != "")
    share = F.transform(kinds, lambda c: (size - F.length(F.replace(low, c, F.lit("")))) / size)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)) >= 3.0


def is_plain_password(value: Column) -> Column:
    """What a password is said to be, where that isn't a secret by itself, which is found as one."""
    said = F.regexp_extract(value, r"[:=]\x20?[\"']?(.*)$", 1)
    return ~(said.rlike(r"^(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])[0-9A-Za-z+/_-]{20,}+$") & is_random(said))


@dataclass(frozen=True)
class Kind:
    """pattern proposes, check confirms. score is raised by near where one of the words stands shortly before or after the span.
    hint: a literal, guard: a cheaper pattern, without which the pattern can't match."""

    name: str
    pattern: str
    check: Check
    score: float
    near: float
    words: str
    hint: str = ""
    guard: str = ""


def anything(_: Column) -> Column:
    return F.lit(True)


#: The kinds whose spans always stay, in the order that breaks ties.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", anything, 0.9, 0.1, "mail|contact|kontakt|correo|write|schreib", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", is_ip, 0.6, 0.3, r"\bip\b|host|server|address|adresse", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", is_card, 0.8, 0.2, "card|visa|master|amex|karte|carte|tarjeta|credit"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 0.7, 0.2, r"\btel|phone|call|mobil|fax|anruf", "+"),
)

#: Words beside a secret: of their own, or `key` with a value put to it.
SECRET_WORDS = r"\b(?:token|secret|password|passwd|passphrase|api[\x20_-]?key|access[\x20_-]?key|auth|authorization|credentials?|bearer)s?\b|\bkey[\"']?\x20?[:=]"
#: A run without which there is no hex or secret.
LONG_RUN = r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{20}"

#: Further kinds, which stay where the score reaches the limit.
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", is_iban, 0.9, 0.1, "iban|account|konto|compte|cuenta|bank"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", anything, 0.3, 0.5, r"\bssn\b|social|security", "-"),
    # secrets: runs of hexadecimal digits or of letters and digits that look random, known forms of keys, private keys with their
    # bodies (whose head lines hold few dashes), and what a password is said to be, if it has a digit
    Kind("hex", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])", is_random, 0.4, 0.4, SECRET_WORDS, guard=LONG_RUN),
    Kind("secret", r"(?<![0-9A-Za-z+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])[0-9A-Za-z+/_-]{20,}+(?![0-9A-Za-z+/_-])", is_random, 0.2, 0.5, SECRET_WORDS, guard=LONG_RUN),
    Kind("key", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|eyJ[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+\.[0-9A-Za-z_-]{10,}+)|-----BEGIN\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----(?:(?:[A-Za-z0-9+/=:,.\s]++|-(?!----)){0,64}+-----END\x20(?:[A-Z]+\x20)?PRIVATE\x20KEY-----)?", anything, 0.9, 0.1, r"\bkey\b|\btoken\b|\baws\b|\bgit\b"),
    Kind("password", r"(?i)\b(?:password|passwd|pwd|passphrase)[\"']?\x20?[:=]\x20?[\"']?(?=[^\s\"',;0-9]*+[0-9])[^\s\"',;]{6,}+", is_plain_password, 0.8, 0.0, "password", guard=r"(?i)(?:passw|pwd|passphrase)"),
)

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,score:double>>"


def proposals(text: Column, kind: Kind, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches, unchecked: array of (start, end, value, before)."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    if kind.hint:
        matches = F.when(F.instr(text, kind.hint) > 0, matches).otherwise(none)
    return matches if guard is None else F.when(guard, matches).otherwise(none)


def around(pieces: Column, matches: Column, i: Column) -> tuple[Column, Column]:
    """The characters before and after match i, the neighbouring matches and what lies beyond them included."""
    at = lambda xs, j: F.coalesce(F.when(j >= 0, F.get(xs, j)), F.lit(""))
    before = F.concat(at(pieces, i - 1), at(matches, i - 1), at(pieces, i))
    after = F.concat(at(pieces, i + 1), at(matches, i + 1), at(pieces, i + 2))
    return F.substring(before, -CONTEXT_CHARS, CONTEXT_CHARS), F.substring(after, 1, CONTEXT_CHARS)


def span_of(kind: Kind, rank: int, pieces: Column, matches: Column) -> Callable[[Column, Column], Column]:
    """From a match (value, start) and its number to a span with its score."""

    def span(match: Column, i: Column) -> Column:
        before, after = around(pieces, matches, i)
        near = F.lower(before).rlike(kind.words) | F.lower(after).rlike(kind.words)
        score = F.round(F.lit(kind.score) + F.when(near, F.lit(kind.near)).otherwise(F.lit(0.0)), 2)
        start, value = match["start"], match["value"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(value)).alias("end"), F.lit(kind.name).alias("kind"), value.alias("value"), score.alias("score"))

    return span


def with_spans(docs: DataFrame, text: str, kinds: Sequence[Kind], ranks: dict[str, int], least_score: float, out: str, base: bool) -> DataFrame:
    """Adds column out: array of spans of all kinds. Work columns are named after out."""
    found, guards = [], {}
    for kind in kinds:
        if kind.guard and kind.guard not in guards:
            guards[kind.guard] = f"{out}__guard{len(guards)}"
            docs = docs.withColumn(guards[kind.guard], F.col(text).rlike(kind.guard))
    for kind in kinds:
        m, p, s = f"{out}__{kind.name}_m", f"{out}__{kind.name}_p", f"{out}__{kind.name}"
        body = F.col(text)
        docs = docs.withColumn(m, proposals(body, kind, F.col(guards[kind.guard]) if kind.guard else None))
        docs = docs.withColumn(p, F.when(F.size(m) > 0, F.split(body, kind.pattern, -1)).otherwise(F.array().cast("array<string>")))
        start = F.aggregate(
            F.zip_with(F.col(p), F.col(m), lambda piece, match: F.struct(F.length(piece).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("size"))),
            F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")),
            lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts")),
            lambda acc: acc["starts"],
        )
        places = F.zip_with(F.col(m), F.slice(start, 1, F.size(m)), lambda match, at: F.struct(match.alias("value"), at.alias("start")))
        spans = F.transform(places, span_of(kind, ranks[kind.name], F.col(p), F.col(m)))
        sure = (lambda _: F.lit(True)) if base else (lambda x: x["score"] >= least_score)
        kept = F.filter(spans, lambda x: kind.check(x["value"]) & sure(x))  # noqa: B023
        docs = docs.withColumn(s, F.when(F.size(m) > 0, kept).otherwise(F.array().cast(SPAN))).drop(m, p)
        found.append(s)
    return docs.withColumn(out, F.array_sort(F.concat(*found))).drop(*found, *guards.values())


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii", base: Sequence[Kind] = BASE, more: Sequence[Kind] = MORE, least_score: float = 0.6) -> DataFrame:
    """docs with column out: the spans by start, then kind; offsets in code points, end exclusive. Spans of different
    kinds may overlap."""
    ranks = {k.name: i for i, k in enumerate((*base, *more))}
    work = f"{out}_"
    while any(x.startswith(work) for x in docs.columns):  # work columns must not meet any of the table's own
        work += "_"
    body, first, rest = f"{work}text", f"{work}base", f"{work}more"
    docs = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    docs = with_spans(docs, body, base, ranks, 0.0, first, True)
    docs = with_spans(docs, body, more, ranks, least_score, rest, False)
    return docs.withColumn(out, F.array_sort(F.concat(F.col(first), F.col(rest)))).drop(body, first, rest)


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    body = F.col(text)
    done = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(
            F.struct(x["end"].alias("at"), F.array_append(acc["parts"], F.concat(F.substring(body, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("parts"))
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(body, (acc["at"] + 1).cast("int"), F.length(body))),
    )
    return docs.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(body))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_pii(docs: DataFrame) -> DataFrame:
    names = [k.name for k in BASE]
    found = find_pii(docs.select("doc_id", "text")).select("doc_id", "pii", F.filter("pii", lambda x: x["rank"] < len(names)).alias("sure"))
    counts = [F.size(F.filter("sure", lambda x: x["kind"] == n)).cast("bigint").alias(f"n_{n}") for n in names]
    scores = F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(digest(F.col("sure")), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"), scores.alias("scores"))
