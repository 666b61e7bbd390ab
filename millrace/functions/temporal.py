"""Time: floors, shifts, half-open intervals and partial dates. Every function takes the moment it needs; none looks at
a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "week", "month", "year")


def floor(moment: Column, unit: str) -> Column:
    """The start of the unit; weeks start on Monday."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    return F.date_trunc(unit, moment).cast("timestamp_ntz")


def shift(moment: Column, unit: str, n: int) -> Column:
    """n units on; months and years keep to the end of a shorter month."""
    if unit in ("month", "year"):
        months = n * (12 if unit == "year" else 1)
        return (moment + F.make_ym_interval(F.lit(0), F.lit(months))).cast("timestamp_ntz")
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit] * n
    return moment + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def contains(start: Column, end: Column, moment: Column) -> Column:
    return (start <= moment) & (moment < end)


def partial_interval(year: Column, month: Column, day: Column) -> tuple[Column, Column]:
    """The half-open interval that a partial date covers; null without a year, and for a date that doesn't exist."""
    low = F.try_make_timestamp_ntz(year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)), F.lit(0), F.lit(0), F.lit(0)) if hasattr(F, "try_make_timestamp_ntz") else F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)))).cast("timestamp_ntz")
    high = F.when(month.isNull(), shift(low, "year", 1)).when(day.isNull(), shift(low, "month", 1)).otherwise(shift(low, "day", 1))
    return low, high


def overlaps(start: Column, end: Column, year: Column, month: Column, day: Column) -> Column:
    """Whether a partial date overlaps an interval; false without a year."""
    low, high = partial_interval(year, month, day)
    return F.coalesce((low < end) & (start < high), F.lit(False))


def next_weekday(moment: Column, weekday: str) -> Column:
    """The next such day, never the same one; weekday: Mon to Sun."""
    return F.next_day(moment.cast("date"), weekday)


def century(number: Column) -> tuple[Column, Column]:
    """The first year of a century and the first after it."""
    return (number - 1) * 100 + 1, number * 100 + 1
