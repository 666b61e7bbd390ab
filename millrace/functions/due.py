"""When something is due that a text asks to be reminded of, as expressions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import fixed, strings
from millrace.functions.phrases import floored, moved, table_of

PLAN = "struct<due: timestamp_ntz, event: timestamp_ntz, offered: boolean>"
TIME = "timestamp_ntz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words without marks, colons kept, a point at the end cut off."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_:.]+"), F.lit(0))
    return F.transform(found, lambda t: F.coalesce(F.nullif(F.regexp_replace(strings.fold_accents(t), r"\.+$", ""), F.lit("")), F.lit(".")))


def number(word: Column) -> Column:
    return F.when(word.rlike("^[0-9]{1,9}$"), word.try_cast("int"))


def first(words: Column, make: Callable[[Column, Column], Column]) -> Column:
    """The first thing that make(word, place) gives, null if it gives none."""
    return F.get(F.filter(F.transform(words, make), lambda x: x.isNotNull()), F.lit(0))


def after_minutes(moment: Column, minutes: Column) -> Column:
    return moved(moment, F.lit("minute"), minutes)


def at_hour(day: Column, hour: Column, minute: Column | None = None) -> Column:
    return after_minutes(floored(day, F.lit("day")), hour * 60 + (F.lit(0) if minute is None else minute))


def date_of(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", year.cast("string"), month.cast("string"), day.cast("string")), F.lit("y-M-d")).cast(TIME)


def clock(word: Column) -> Column:
    """struct(hour, minute) of `18:30`."""
    hour, minute = (F.regexp_extract(word, "^([0-9]{1,2}):([0-9]{2})$", k).try_cast("int") for k in (1, 2))
    return F.when((hour < 24) & (minute < 60), F.struct(hour.alias("hour"), minute.alias("minute")))


def part_of_day(word: Column) -> Column:
    """struct(hour, minute) of a word for a part of the day."""
    told = F.try_element_at(table_of(fixed.DAY_PARTS), word)
    return F.when(told.isNotNull(), F.struct(F.substring(told, 1, 2).cast("int").alias("hour"), F.substring(told, 4, 2).cast("int").alias("minute")))


def by_offset(words: Column, now: Column) -> Column:
    """`in so many units`, `in a moment`, `in a quarter of an hour`: within three words behind one that points forward."""
    units, numerals = table_of(fixed.TIME_UNITS), table_of(fixed.TIME_NUMERALS)
    soon, fractions = table_of(fixed.SOON_MINUTES), table_of(fixed.FRACTION_MINUTES)
    none = F.lit(None)
    start = F.struct(F.lit(1).alias("count"), none.cast("int").alias("fraction"), none.cast("int").alias("minutes"), none.cast("string").alias("unit"))
    put = lambda s, **change: F.struct(*(change.get(x, s[x]).alias(x) for x in ("count", "fraction", "minutes", "unit")))

    def step(s: Column, t: Column) -> Column:
        unit = F.nullif(F.try_element_at(units, t), F.lit("century"))
        return (
            F.when(s["minutes"].isNotNull() | s["unit"].isNotNull(), s)
            .when(F.try_element_at(soon, t).isNotNull(), put(s, minutes=F.try_element_at(soon, t)))
            .when(F.try_element_at(fractions, t).isNotNull(), put(s, fraction=F.try_element_at(fractions, t)))
            .when(F.try_element_at(numerals, t).isNotNull(), put(s, count=F.try_element_at(numerals, t)))
            .when(number(t).isNotNull(), put(s, count=number(t)))
            .when(unit.isNotNull(), put(s, unit=unit, minutes=F.when(unit == "hour", s["fraction"])))
            .otherwise(s)
        )

    def make(t: Column, i: Column) -> Column:
        told = F.aggregate(F.slice(words, i + 2, F.lit(3)), start, step)
        due = lambda s: F.when(s["minutes"].isNotNull(), after_minutes(now, s["minutes"])).when(s["unit"].isNotNull(), moved(now, s["unit"], s["count"]))
        return F.when(t.isin(*fixed.FORWARD_WORDS), let(told, due))

    return first(words, make)


def by_clock(words: Column, now: Column) -> Column:
    """`at 18:30`: today, or tomorrow if that has passed."""
    due = first(words, lambda t, i: let(clock(t), lambda c: at_hour(now, c["hour"], c["minute"])))
    return F.when(due <= now, moved(due, F.lit("day"), F.lit(1))).otherwise(due)


def by_date(words: Column, now: Column) -> Column:
    """struct(found, due) of the first month, with a day before it and a year behind it: at the hour of reminders. Without a year
    the next such day; a month that runs, without a day, means tomorrow. Days that don't exist are found and never due."""
    months = table_of(fixed.MONTH_FORMS | fixed.MONTH_NAMES)
    hour = F.lit(fixed.REMINDER_HOUR)
    ahead = F.exists(words, lambda t: t.isin(*fixed.NEXT_WORDS))

    def make(t: Column, i: Column) -> Column:
        month = F.try_element_at(months, t)
        day = F.when(i > 0, number(F.get(words, i - 1)))
        said = F.when(F.get(words, i + 1).rlike("^[0-9]{4}$"), F.get(words, i + 1).try_cast("int"))
        year = F.coalesce(said, F.when(ahead, F.year(now) + 1))
        due = at_hour(date_of(F.coalesce(year, F.year(now)), month, F.coalesce(day, F.lit(1))), hour)
        passed = year.isNull() & (due <= now)
        later = F.when(day.isNull() & (F.month(now) == month), at_hour(moved(now, F.lit("day"), F.lit(1)), hour)).otherwise(at_hour(date_of(F.year(now) + 1, month, F.coalesce(day, F.lit(1))), hour))
        return F.when(month.isNotNull(), F.struct(F.lit(True).alias("found"), F.when(passed, later).otherwise(due).alias("due")))

    next_year = ahead & F.exists(words, lambda t: F.try_element_at(table_of(fixed.TIME_UNITS), t) == "year")
    new_year = at_hour(date_of(F.year(now) + 1, F.lit(1), F.lit(1)), hour)
    return F.coalesce(first(words, make), F.struct(next_year.alias("found"), F.when(next_year, new_year).alias("due")))


def day_ahead(words: Column) -> Column:
    """How many days the first word for a day to come looks ahead; null if there is none."""
    return first(words, lambda t, i: let(F.try_element_at(table_of(fixed.DAY_WORDS), t), lambda d: F.when(d > 0, d)))


def by_part(words: Column, now: Column) -> Column:
    """`in the evening at 8`, `tomorrow morning`: a part of the day, with the last hour up to twelve told within two words of it."""
    numerals = table_of(fixed.TIME_NUMERALS)
    hours = lambda t: F.coalesce(F.when(F.try_element_at(numerals, t) <= 12, F.try_element_at(numerals, t)), F.when(number(t) <= 12, number(t)))

    def make(t: Column, i: Column) -> Column:
        near = F.slice(words, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)) + 3)
        told = F.element_at(F.concat(F.array(F.lit(None).cast("int")), F.filter(F.transform(near, hours), lambda h: h.isNotNull())), -1)
        return let(part_of_day(t), lambda p: F.when(p.isNotNull(), let(told, lambda h: F.struct(F.when(h.isNull(), p["hour"]).when((p["hour"] >= 12) & (h < 12), h + 12).otherwise(h).alias("hour"), F.when(h.isNull(), p["minute"]).otherwise(0).alias("minute")))))

    due = let(first(words, make), lambda p: at_hour(moved(now, F.lit("day"), F.coalesce(day_ahead(words), F.lit(0))), p["hour"], p["minute"]))
    return F.when((due <= now) & day_ahead(words).isNull(), moved(due, F.lit("day"), F.lit(1))).otherwise(due)


def ahead_of(words: Column, due: Column) -> Column:
    """due, so much earlier as a text says it wants to know beforehand."""
    units, numerals = table_of(fixed.TIME_UNITS), table_of(fixed.TIME_NUMERALS)
    start = F.struct(F.lit(1).alias("count"), F.lit("day").alias("unit"), F.lit(False).alias("done"))

    def step(s: Column, t: Column) -> Column:
        unit = F.nullif(F.try_element_at(units, t), F.lit("century"))
        count = F.coalesce(F.try_element_at(numerals, t), number(t), s["count"])
        return F.when(s["done"], s).when(unit.isNotNull(), F.struct(s["count"].alias("count"), unit.alias("unit"), s["done"].alias("done"))).otherwise(F.struct(count.alias("count"), s["unit"].alias("unit"), F.lit(True).alias("done")))

    def make(t: Column, i: Column) -> Column:
        before = F.reverse(F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))))
        return F.when(t.isin(*fixed.ADVANCE_WORDS), F.aggregate(before, start, step))

    return let(first(words, make), lambda s: F.when(s.isNull(), due).otherwise(moved(due, s["unit"], -s["count"])))


def due_of(words: Column, now: Column) -> Column:
    def dated(told: Column) -> Column:
        alone = let(day_ahead(words), lambda d: at_hour(moved(now, F.lit("day"), d), F.lit(fixed.REMINDER_HOUR)))
        return F.when(told["found"], told["due"]).otherwise(F.coalesce(by_part(words, now), alone))

    plain = F.coalesce(by_offset(words, now), by_clock(words, now), let(by_date(words, now), dated))
    return let(plain, lambda due: ahead_of(words, due))


def due_time(text: Column, now: Column) -> Column:
    """When a text wants to be reminded: so many units from now, at an hour, on a date, in a part of the day, on a day to come, the
    first that it says; and so much earlier if it says so. Null if it says no time, or a date that doesn't exist."""
    return let(words_of(text), lambda words: due_of(words, now)).cast(TIME)


def plan(text: Column, now: Column) -> Column:
    """struct(due, event, offered): due_time with what is meant where only part of it is said, then offered for change.

    An hour today is an event, and due some hours before it (in five minutes if that has passed); the next week or month is due
    the evening before it begins; today without an hour some hours from now; tomorrow without an hour in the morning. Null if a
    text says no time."""
    units, numerals, days = table_of(fixed.TIME_UNITS), table_of(fixed.TIME_NUMERALS), table_of(fixed.DAY_WORDS)
    months = table_of(fixed.MONTH_FORMS | fixed.MONTH_NAMES)
    made = lambda due, event, offered: F.struct(due.cast(TIME).alias("due"), event.cast(TIME).alias("event"), offered.alias("offered"))
    nothing = F.lit(None).cast(TIME)
    hour_of = lambda name: int(fixed.DAY_PARTS[name][:2])

    def whole(words: Column) -> Column:
        has = lambda test: F.exists(words, test)
        part, day = has(lambda t: t.isin(*fixed.DAY_PARTS)), has(lambda t: t.isin(*fixed.DAY_WORDS))

        def event_of(t: Column, i: Column) -> Column:
            led = (i > 0) & F.get(words, i - 1).isin("v", "ve")
            hour = F.when(led, F.coalesce(F.try_element_at(numerals, t), F.when(number(t) < 24, number(t))))
            later = F.when(hour < fixed.AFTERNOON_FROM, hour + 12).otherwise(hour)
            return F.coalesce(let(clock(t), lambda c: at_hour(now, c["hour"], c["minute"])), F.when(later < 24, at_hour(now, later)))

        event = F.when(~part & ~day & ~has(lambda t: F.try_element_at(months, t).isNotNull()), first(words, event_of))
        ahead = has(lambda t: t.isin(*fixed.NEXT_WORDS))
        unit = first(words, lambda t, i: F.when(F.try_element_at(units, t).isin("week", "month"), F.try_element_at(units, t)))
        start = F.when(ahead & unit.isNotNull(), moved(floored(now, unit), unit, F.lit(1)))
        evening = let(start, lambda s: at_hour(moved(s, F.lit("day"), F.lit(-1)), F.lit(hour_of(fixed.HEADS_UP_PART))))
        today = has(lambda t: F.try_element_at(days, t) == 0)
        bare = day & ~part & has(lambda t: F.try_element_at(days, t) > 0)

        def before(e: Column) -> Column:
            due = moved(e, F.lit("hour"), F.lit(-fixed.EVENT_LEAD_HOURS))
            return made(F.when(due <= now, after_minutes(now, F.lit(5))).otherwise(due), e, F.lit(True))

        def told(due: Column) -> Column:
            morning = bare & (F.hour(due) == fixed.REMINDER_HOUR)
            soon = F.when(today, made(moved(now, F.lit("hour"), F.lit(fixed.TODAY_LEAD_HOURS)), nothing, F.lit(True)))
            exact = made(F.when(morning, at_hour(due, F.lit(hour_of(fixed.TOMORROW_PART)), F.minute(due))).otherwise(due), nothing, morning)
            return F.when(due.isNull(), soon).otherwise(exact)

        # the hour of a heads-up is never null where the next week or month is told
        return let(event, lambda e: F.when(e > now, before(e)).otherwise(let(start, lambda s: F.when(s.isNotNull(), made(evening, s, F.lit(True))).otherwise(let(due_of(words, now), told)))))

    return let(words_of(text), whole)
