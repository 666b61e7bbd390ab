"""Words of time in running text, as half-open intervals around a given moment; everything is an expression over columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed, strings

INTERVAL = "struct<start:timestamp_ntz,end:timestamp_ntz,granularity:string>"


def claimed_words() -> frozenset[str]:
    """The words that belong to time, so that they are neither names nor content."""
    tables = (fixed.DAY_WORDS, fixed.TIME_UNITS, fixed.NOW_WORDS, fixed.LAST_WORDS, fixed.NEXT_WORDS, fixed.CURRENT_WORDS, fixed.DAY_PARTS, fixed.WEEKDAY_FORMS)
    return frozenset(word for table in tables for word in table)


def table_of(values: Mapping[str, object]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def words_of(text: Column) -> Column:
    """Words without marks, a point at the end cut off."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0)), lambda t: F.coalesce(F.nullif(F.regexp_replace(strings.fold_accents(t), r"\.+$", ""), F.lit("")), F.lit(".")))


def moved(moment: Column, unit: Column, n: Column) -> Column:
    """n units on; months and years keep to the end of a shorter month."""
    months = F.when(unit == "year", n * 12).when(unit == "month", n).otherwise(0).cast("int")
    seconds = F.when(unit == "second", n).when(unit == "minute", n * 60).when(unit == "hour", n * 3600).when(unit == "day", n * 86400).when(unit == "week", n * 604800).otherwise(0)
    return (moment + F.make_ym_interval(F.lit(0), months) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def floored(moment: Column, unit: Column) -> Column:
    return F.call_function("date_trunc", unit, moment).cast("timestamp_ntz")


def day_of(year: Column, month: Column, day: Column) -> Column:
    """The day's beginning; null for a day that doesn't exist."""
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit("y-M-d")).cast("timestamp_ntz")


def span(start: Column, end: Column, granularity: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), granularity.alias("granularity"))


def unit_span(start: Column, unit: Column) -> Column:
    return span(start, moved(start, unit, F.lit(1)), unit)


def first_of(words: Column, make: Callable[[Column, Column], Column]) -> Column:
    """The first interval that make(word, place) gives."""
    found = F.filter(F.transform(words, make), lambda x: x["start"].isNotNull())
    return F.try_element_at(found, F.lit(1))


def temporal_interval(text: Column, now: Column) -> Column:
    """struct(start, end, granularity) of the first rule that fits: centuries, now, a date, a month, a word for a day, so many
    units from now, the next, the last and this unit; null if a text says no time."""
    return strings.bound(words_of(text), lambda words: interval_of(words, now))


def interval_of(words: Column, now: Column) -> Column:
    """What temporal_interval gives for a text's words."""
    units, numerals, months = table_of(fixed.TIME_UNITS), table_of(fixed.TIME_NUMERALS), table_of(fixed.MONTH_FORMS | fixed.MONTH_NAMES)
    dated = table_of(fixed.MONTH_FORMS)
    unit_of = lambda t: F.nullif(F.try_element_at(units, t), F.lit("century"))
    whole = lambda t: F.when(F.regexp_replace(t, r"\.+$", "").rlike("^[0-9]{1,9}$"), F.regexp_replace(t, r"\.+$", "").try_cast("int"))
    at = lambda i: F.when(i >= 0, F.get(words, i))
    none = F.lit(None).cast("timestamp_ntz")
    blank = span(none, none, F.lit(None).cast("string"))
    spanned = lambda start, unit: strings.bound(start, lambda at: F.when(at.isNotNull(), unit_span(at, unit)).otherwise(blank))
    has = lambda held: F.exists(words, lambda t: t.isin(*held))

    numbers = F.filter(F.transform(words, whole), lambda n: n.between(1, 21))
    centuries = span(day_of((F.array_min(numbers) - 1) * 100 + 1, F.lit(1), F.lit(1)), day_of(F.array_max(numbers) * 100 + 1, F.lit(1), F.lit(1)), F.lit("century"))
    in_century = F.exists(words, lambda t: F.try_element_at(units, t) == "century") & (F.size(numbers) > 0)
    half = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(fixed.NOW_WINDOW_MINUTES * 30).cast("decimal(18,6)"))
    around = span((now - half).cast("timestamp_ntz"), (now + half).cast("timestamp_ntz"), F.lit("moment"))

    def explicit(t: Column, i: Column) -> Column:
        part = lambda k: F.regexp_extract(t, r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", k)
        numeric = F.when(part(1) != "", day_of(part(3), part(2).try_cast("int"), part(1).try_cast("int")))
        year = F.when(at(i + 1).rlike("^[0-9]{4}$"), at(i + 1))
        named = F.when((i > 0) & whole(at(i - 1)).isNotNull() & year.isNotNull(), day_of(year, F.try_element_at(dated, t), whole(at(i - 1))))
        start = F.coalesce(numeric, named)
        return spanned(start, F.lit("day"))

    def bare_month(t: Column, i: Column) -> Column:
        number = F.when((i == 0) | whole(at(i - 1)).isNull(), F.try_element_at(months, t))
        this = F.year(now) + F.when(has(fixed.NEXT_WORDS), 1).otherwise(0)
        year = F.when(at(i + 1).rlike("^[0-9]{4}$"), at(i + 1).try_cast("int")).otherwise(this)
        start = F.when(number.isNotNull(), day_of(year, number, F.lit(1)))
        return spanned(start, F.lit("month"))

    def day_word(t: Column, _: Column) -> Column:
        days = F.try_element_at(table_of(fixed.DAY_WORDS), t)
        start = F.when(days.isNotNull(), moved(floored(now, F.lit("day")), F.lit("day"), days))
        return spanned(start, F.lit("day"))

    def directed(t: Column, i: Column) -> Column:
        after = F.slice(words, i + 2, F.lit(3))
        named = F.transform(after, unit_of)
        place = F.array_position(F.transform(named, lambda u: u.isNotNull()), True)  # from 1, 0 if there is none
        before = F.slice(after, F.lit(1), F.greatest(place.cast("int") - 1, F.lit(0)))
        counts = F.filter(F.transform(before, lambda x: F.coalesce(F.try_element_at(numerals, x), whole(x))), lambda n: n.isNotNull())
        count = F.coalesce(F.try_element_at(counts, F.lit(-1)), F.lit(1))
        unit = F.when(place > 0, F.get(named, place.cast("int") - 1))
        sign = F.when(t.isin(*fixed.BACK_WORDS), -1).when(t.isin(*fixed.FORWARD_WORDS), 1)
        fine = F.when(unit.isin("second", "minute", "hour"), unit).otherwise(F.lit("day"))
        start = F.when(sign.isNotNull() & unit.isNotNull(), floored(moved(now, unit, sign * count), fine))
        return spanned(start, fine)

    def relative(held: tuple[str, ...], n: int):
        def make(t: Column, i: Column) -> Column:
            unit = F.coalesce(unit_of(F.get(words, i + 1)), unit_of(F.get(words, i + 2)))
            if n == 0:
                unit = F.when(t.isin(*fixed.THIS_YEAR_WORDS), "year").otherwise(unit)
            start = F.when(t.isin(*held) & unit.isNotNull(), moved(floored(now, unit), unit, F.lit(n)))
            return spanned(start, unit)

        return make

    rules = [explicit, bare_month, day_word, directed, relative(fixed.NEXT_WORDS, 1), relative(fixed.LAST_WORDS, -1), relative(fixed.CURRENT_WORDS, 0)]
    found = F.coalesce(*(first_of(words, rule) for rule in rules))
    return F.when(in_century, centuries).when(has(fixed.NOW_WORDS), around).otherwise(found)
