"""Anchored patterns over token classes.

An element is a class, with classes that the token must not have (`name!other`) and words of which it must be one
(`name:one|two`); `?` before it makes it optional, `*` takes any tokens, `%{NAME}` stands for elements of a table. A
pattern of single tokens is a regular language over classes, so it runs as one expression on a column of tokens. `fits` says
whether it fits; `captures` also what each element takes, and knows spans (`uzel+`) that a vocabulary confirms.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "uzel+"


@dataclass(frozen=True)
class Element:
    kind: str = ""
    without: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    optional: bool = False
    any: bool = False
    span: bool = False

    @classmethod
    def of(cls, text: str) -> Element:
        optional = text.startswith("?")
        body = text.removeprefix("?")
        if body in ("*", SPAN):
            return cls(optional=optional, any=body == "*", span=body == SPAN)
        classes, _, words = body.partition(":")
        kind, *without = classes.split("!")
        return cls(kind, tuple(without), tuple(words.split("|")) if words else (), optional)


def expand(elements: Sequence[str], table: Mapping[str, str | Sequence[str]], within: tuple[str, ...] = ()) -> list[str]:
    """The elements with names replaced by what the table has for them, however deep; an optional name makes all of its
    elements optional. Names that are unknown or contain themselves are errors."""
    out: list[str] = []
    for element in elements:
        mark, body = ("?", element[1:]) if element.startswith("?") else ("", element)
        if not (body.startswith("%{") and body.endswith("}")):
            out.append(element)
            continue
        name = body[2:-1]
        if name in within or name not in table:
            raise ValueError(f"pattern name {name} {'contains itself' if name in within else 'is unknown'}")
        value = table[name]
        inner = expand([value] if isinstance(value, str) else value, table, (*within, name))
        out += [x if not mark or x.startswith("?") else mark + x for x in inner]
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_fits(x: Element, token: Column) -> Column:
    """Whether a token (struct with norm and classes) is one that the element takes."""
    good = F.lit(True)
    if x.kind:
        good = good & F.array_contains(token["classes"], x.kind)
    for other in x.without:
        good = good & ~F.array_contains(token["classes"], other)
    return good & token["norm"].isin(*x.words) if x.words else good


def bit(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i)) != 0


def captures(pattern: Sequence[str], tokens: Column, spans: Column | None = None) -> Column:
    """Which tokens each element takes of the whole column of tokens (array of structs with norm and classes), as an array of
    bounds: element i (from 0) takes those from bound i up to bound i + 1, none if they are equal. Null where the pattern
    doesn't fit. Elements take as much as they can, the leftmost first.

    One pass from the right finds at each place the elements from which the rest of the line can be met, in the bits of a
    number; a walk from the left then takes for each element the farthest end from which the rest can be met, so nothing
    is tried twice. spans: array of struct(start, end), for elements `uzel+`."""
    elements = [Element.of(x) for x in pattern]
    m = len(elements)
    if m > 62:
        raise ValueError("patterns have 62 elements at most")
    spans = F.array().cast("array<struct<start: int, end: int>>") if spans is None else spans
    here = lambda i: F.transform(F.filter(spans, lambda s: s["start"] == i), lambda s: s["end"])

    def opened(own: Column, e: int, passed: bool) -> Callable[[Column], Column]:
        return lambda v: F.when(own | bit(v, e + 1) if passed else own, v.bitwiseOR(F.lit(1 << e))).otherwise(v)

    def reached(held: Column, i: Column, e: int) -> Callable[[Column], Column]:
        return lambda end: bit(F.get(held, F.size(held) + i - end), e + 1)

    def closed(mask: Column, taken: list[Column] | None) -> Column:
        for e in range(m - 1, -1, -1):
            x = elements[e]
            own = F.lit(False) if taken is None else taken[e]
            mask = let(mask, opened(own, e, x.optional or x.any))
        return mask

    def back(held: Column, i: Column) -> Column:
        """held: the masks of the places i + 1 to n, the last of them first in time, so that place p is at size - 1 - (p - i - 1)."""
        after = F.element_at(held, -1)
        taken = []
        for e, x in enumerate(elements):
            if x.any:
                taken.append(bit(after, e))
            elif x.span:
                taken.append(F.exists(here(i), reached(held, i, e)))
            else:
                taken.append(token_fits(x, F.get(tokens, i)) & bit(after, e + 1))
        return F.concat(held, F.array(closed(F.lit(0).cast("bigint"), taken)))

    n = F.size(tokens)
    places = F.when(n > 0, F.sequence(n - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    masks = F.aggregate(places, F.array(closed(F.lit(1 << m).cast("bigint"), None)), back)

    def walk(held: Column) -> Column:
        can = lambda place, e: bit(F.get(held, n - place), e)
        bounds = F.array(F.lit(0))

        def end_of(at: Column, e: int, x: Element) -> Column:
            if x.any:
                return F.array_max(F.filter(F.sequence(at, n), lambda q: can(q, e + 1)))
            if x.span:
                return F.coalesce(F.array_max(F.filter(here(at), lambda q: can(q, e + 1))), at)
            if x.optional:
                return F.when((at < n) & token_fits(x, F.get(tokens, at)) & can(at + 1, e + 1), at + 1).otherwise(at)
            return at + 1

        def further(e: int, x: Element) -> Callable[[Column], Column]:
            return lambda b: F.concat(b, F.array(end_of(F.element_at(b, -1), e, x)))

        for e, x in enumerate(elements):
            bounds = let(bounds, further(e, x))
        return F.when(can(F.lit(0), 0), bounds)

    return let(masks, walk)


def fits(pattern: Sequence[str], tokens: Column) -> Column:
    """Whether a pattern without spans fits a whole column of tokens (array of norm, classes).

    The set of elements that may come next is held in the bits of a number; a token moves each of them on, and optional
    elements and `*` let the next one in."""
    elements = [Element.of(x) for x in pattern]
    if any(x.span for x in elements) or len(elements) > 62:
        raise ValueError("patterns with spans are matched by captures(); none has more than 62 elements")

    def closed(mask: Column) -> Column:
        for i, x in enumerate(elements):
            if x.optional or x.any:
                mask = mask.bitwiseOR(F.shiftleft(mask.bitwiseAND(F.lit(1 << i)), 1))
        return mask

    def step(mask: Column, token: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for i, x in enumerate(elements):
            here = mask.bitwiseAND(F.lit(1 << i))
            if x.any:
                out = out.bitwiseOR(here)
                continue
            good = token_fits(x, token)
            out = out.bitwiseOR(F.when(good, F.shiftleft(here, 1)).otherwise(F.lit(0).cast("bigint")))
        return closed(out)

    start = closed(F.lit(1).cast("bigint"))
    return F.aggregate(tokens, start, step).bitwiseAND(F.lit(1 << len(elements))) != 0


@dataclass(frozen=True)
class Card:
    """A pattern with what a line that it fits asks for. Numbers are elements, from 1; `known` are roles ("" for the one that
    goes with the hole) and elements; `predicate` may be a word instead, and `role` and `type` replace those of the question
    word at `hole`. A card whose predicate, hole or class isn't found on the line doesn't speak."""

    name: str
    pattern: tuple[str, ...]
    priority: int = 0
    hole: int | None = None
    predicate: str | int | None = None
    known: tuple[tuple[str, int], ...] = ()
    role: str | None = None
    type: str | None = None
    date_part: int | None = None
    of_class: int | None = None
    copula: int | None = None
    novelty: int | None = None
    user_subject: bool = False


def best_card(cards: Sequence[Card], tokens: Column, spans: Column | None = None) -> Column:
    """The name of the card that fits a whole column of tokens: of the highest priority, then with the longest pattern, then the
    first in order; null where none fits. A deck is written by hand, so its cards are part of the expression."""
    ordered = sorted(cards, key=lambda c: (-c.priority, -len(c.pattern), c.name))
    fit = lambda c: captures(c.pattern, tokens, spans).isNotNull() if any(Element.of(x).span for x in c.pattern) else fits(c.pattern, tokens)
    return F.coalesce(*(F.when(fit(c), F.lit(c.name)) for c in ordered), F.lit(None).cast("string"))
