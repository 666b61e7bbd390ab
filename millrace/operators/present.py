"""What is shown: texts of events, labels of times, details of nodes, a landscape of heat, pulses of traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles that an event's text names only if it has no others.
QUIET = ("theme", "time", "num")


def event_text(predicate: Column, participants: Column, exclude: Sequence[str] = (), most: int = 5) -> Column:
    """The verb, then the first participants by role and node; quiet ones only where nothing else is told."""
    held = F.filter(participants, lambda p: ~p["node"].isin(*exclude)) if exclude else participants
    loud = F.filter(held, lambda p: ~p["role"].isin(*QUIET))
    told = F.slice(F.array_sort(F.when(F.size(loud) > 0, loud).otherwise(held)), 1, most)
    return F.btrim(F.concat_ws(" ", predicate, F.array_join(F.transform(told, lambda p: p["node"]), ", ")))


def due_label(due: Column, now: Column) -> Column:
    """The hour if it is today's, else the day and the hour."""
    return F.when(due.cast("date") == now.cast("date"), F.date_format(due, "H:mm")).otherwise(F.date_format(due, "d. M. yyyy H:mm"))


def date_label(start: Column, end: Column) -> Column:
    """An interval's year, month or day, by its length; the minute for anything shorter."""
    days = F.datediff(end, start)
    return F.when(days >= 365, F.date_format(start, "yyyy")).when(days >= 28, F.date_format(start, "M/yyyy")).when(days >= 1, F.date_format(start, "d. M. yyyy")).otherwise(F.date_format(start, "d. M. yyyy H:mm"))


def clock_answer(asked: Column, now: Column, weekdays: Sequence[str], months: Sequence[str], day_phrases: Sequence[str], time_phrases: Sequence[str], day_form: str = "Dnes je %s %d. %s %d.", time_form: str = "Je %d:%02d.") -> Column:
    """What the clock says where a line asks for the day or the time, else null."""
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda x: F.contains(asked, x))
    name = F.element_at(F.array(*map(F.lit, weekdays)), F.weekday(now) + 1)
    month = F.element_at(F.array(*map(F.lit, months)), F.month(now))
    day = F.format_string(day_form, name, F.dayofmonth(now), month, F.year(now))
    return F.when(any_of(day_phrases), day).when(any_of(time_phrases), F.format_string(time_form, F.hour(now), F.minute(now)))


def node_details(participants: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """role, predicate, facts, weight: what a node takes part in, heaviest first."""
    rows = participants.where(F.col("node") == node).groupBy("role", "predicate").agg(F.count_distinct("fact_id").alias("facts"), F.sum("weight").alias("weight"))
    return rows.orderBy(F.desc("weight"), "role", "predicate").limit(limit)


def fact_details(participants: DataFrame, fact_id: str) -> DataFrame:
    """role, node, type: a fact's rows, in the order that they are shown."""
    return participants.where(F.col("fact_id") == fact_id).select("role", "node", "type").orderBy("role", "node")


def landscape(heated: DataFrame, steps: str = " .:-=+*#%@") -> DataFrame:
    """doc_id, sent, line: each token behind a sign of its heat (0 to 1)."""
    sign = F.element_at(F.array(*map(F.lit, steps)), F.least(F.floor(F.col("heat") * len(steps)).cast("int"), F.lit(len(steps) - 1)) + 1)
    held = F.array_sort(F.collect_list(F.struct("pos", F.concat(sign, F.col("form")).alias("shown"))))
    return heated.groupBy("doc_id", "sent").agg(F.array_join(F.transform(held, lambda x: x["shown"]), " ").alias("line"))


def pulses(traces: DataFrame, ticks: int, recent: int = 6, scale: float = 1.5, slowest: int = 25) -> DataFrame:
    """trace, tick: when a packet runs along each of the last traces; the hotter, the oftener. traces: trace, seq, heat."""
    last = traces.orderBy(F.desc("seq"), "trace").limit(recent)
    period = F.least(F.greatest(F.round(F.lit(scale) / F.col("heat")).cast("int"), F.lit(1)), F.lit(slowest))
    return last.where("heat > 0").select("trace", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1), period)).alias("tick"))
