"""Sums in running text: numbers in digits or words, four operators, and bills.

All of it is expressions over arrays, so a whole column is worked out inside the JVM and nothing is ever evaluated as code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed, strings

TOKEN = r"[0-9]+(?:[.,][0-9]+)?|[+*/×÷-]|[\p{L}\p{N}_]+"


def numeral(word: Column, table: Mapping[str, int] = fixed.NUMERALS) -> Column:
    """The number that a word without marks stands for, taken apart into the longest numerals from the left; null if
    anything is left over. Hundreds multiply what stands before them in their group, thousands close it."""
    names = sorted(table, key=lambda x: (-len(x), x))
    any_of = "|".join(names)
    values = F.create_map(*(F.lit(x) for name in names for x in (name, table[name])))

    def step(acc: Column, value: Column) -> Column:
        group = F.when(value >= 100, F.greatest(acc["group"], F.lit(1)) * value).otherwise(acc["group"] + value)
        closes = value >= 1000
        return F.struct(F.when(closes, acc["total"] + group).otherwise(acc["total"]).alias("total"), F.when(closes, 0).otherwise(group).alias("group"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("group"))
    summed = lambda parts: F.aggregate(F.transform(parts, lambda part: F.element_at(values, part)), start, step, lambda acc: (acc["total"] + acc["group"]).cast("double"))
    return strings.bound(F.regexp_extract_all(word, F.lit(f"(?:{any_of})"), F.lit(0)), lambda parts: F.when((word != "") & (F.array_join(parts, "") == word), summed(parts)))


def number(token: Column) -> Column:
    """A token's value: digits with a decimal point or comma, or a numeral."""
    digits = token.rlike(r"^[0-9]+(?:[.,][0-9]+)?$")
    return F.when(digits, F.translate(token, ",", ".").try_cast("double")).otherwise(strings.bound(strings.fold_accents(token), lambda word: numeral(word)))


def shown(value: Column) -> Column:
    """Whole numbers without decimals, others with a comma and at most six digits behind it."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(F.translate(F.regexp_replace(F.round(value, 6).cast("decimal(38,6)").cast("string"), "0+$", ""), ".", ","))


def stream(text: Column, operators: Mapping[str, str] = fixed.OPERATOR_WORDS) -> Column:
    """array of (value, op): the numbers and operators of a text in their order, other words left out."""
    signs = dict.fromkeys("+-*/", None) | {"×": "*", "÷": "/"}
    names = F.create_map(*(F.lit(x) for k, v in {**{s: v or s for s, v in signs.items()}, **operators}.items() for x in (k, v)))

    def item(token: Column) -> Column:
        return strings.bound(number(token), lambda value: F.struct(value.alias("value"), F.when(value.isNull(), F.try_element_at(names, strings.fold_accents(token))).alias("op")))

    items = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), item)
    return F.filter(items, lambda x: x["value"].isNotNull() | x["op"].isNotNull())


def evaluated(items: Column) -> Column:
    """The value of numbers and operators in turn, from the left, products first; null after a division by zero."""

    def step(acc: Column, x: Column) -> Column:
        value = x["value"]
        times = F.when(acc["op"] == "*", acc["term"] * value).when(acc["op"] == "/", F.try_divide(acc["term"], value))
        product = F.coalesce(acc["op"].isin("*", "/"), F.lit(False))
        minus = F.when(acc["op"] == "-", -value).otherwise(value)
        after = F.struct(
            F.when(product, acc["sum"]).otherwise(acc["sum"] + acc["term"]).alias("sum"), F.when(product, times).otherwise(minus).alias("term"), F.lit(None).cast("string").alias("op"), (acc["bad"] | (product & times.isNull())).alias("bad")
        )
        sign = F.struct(acc["sum"].alias("sum"), acc["term"].alias("term"), x["op"].alias("op"), acc["bad"].alias("bad"))
        return F.when(x["op"].isNotNull(), sign).otherwise(after)

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("term"), F.lit(None).cast("string").alias("op"), F.lit(False).alias("bad"))
    return F.aggregate(items, start, step, lambda acc: F.when(~acc["bad"], acc["sum"] + acc["term"]))


def compute(text: Column, sum_phrases: Sequence[str] = fixed.SUM_PHRASES) -> Column:
    """struct(said, result), null where a text is no sum: numbers and operators strictly in turn, or at least two numbers
    beside a phrase that asks for their sum. Times (with a colon) are left alone."""
    return strings.bound(stream(text), lambda items: worked_out(text, items, sum_phrases))


def worked_out(text: Column, items: Column, sum_phrases: Sequence[str]) -> Column:
    """What compute gives for a text and its stream."""
    numbers = F.filter(items, lambda x: x["value"].isNotNull())
    in_turn = F.forall(F.transform(items, lambda x, i: x["value"].isNotNull() == (i % 2 == 0)), lambda x: x) & (F.size(items) >= 3)
    said = F.array_join(F.transform(items, lambda x: F.coalesce(shown(x["value"]), x["op"])), " ")
    phrases = F.array(*(F.lit(x) for x in sum_phrases)).cast("array<string>")
    asks = strings.bound(strings.fold_accents(text), lambda low: F.exists(phrases, lambda phrase: F.contains(low, phrase)))
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x["value"], shown)
    listed = F.array_join(F.transform(numbers, lambda x: shown(x["value"])), " + ")
    # numbers at the end close the last term; an operator at the end leaves its term as it stands
    expression = strings.bound(evaluated(items), lambda value: F.when(value.isNotNull(), F.struct(said.alias("said"), shown(value).alias("result"))))
    bill = F.when(asks, F.struct(listed.alias("said"), total.alias("result")))
    return F.when((F.size(numbers) >= 2) & (F.instr(text, ":") == 0), F.when(in_turn, expression).otherwise(bill))
