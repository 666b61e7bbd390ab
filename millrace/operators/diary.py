"""A diary: an append-only log of what is said and what is to be forgotten, replayed at once instead of line by line.

A line is forgotten if a later line of its user says so: by its predicate and objects, by a name that one of its nodes has, or
by an interval that its time lies in. Each kind of forgetting is an equality join, on a key that a forgotten line and the one
that forgets it share; what then remains is checked. Intervals are covered by days, months of 32 days and so on, each twice
as long as the one before, so that an interval of any length has few keys and a line as many as there are lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import name_stem

#: Lengths of cells, in powers of two of a day: up to 2 ** 17 days.
LEVELS = 17
SAID, PATTERN, ENTITY, INTERVAL = "say", "forget_pattern", "forget_entity", "forget_interval"


def days(moment: Column) -> Column:
    return F.datediff(moment.cast("date"), F.lit("1970-01-01").cast("date"))


def cells_of(moment: Column) -> Column:
    """The cells of all lengths that a moment lies in."""
    day = days(moment)
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(day / F.pow(F.lit(2), k)).cast("long").alias("cell")))


def cover_of(start: Column, end: Column) -> Column:
    """At most two cells of each length that together hold all days from start to end (which is not in the interval)."""
    first, last = days(start), days(end)
    low = lambda k: F.ceil(first / F.pow(F.lit(2), k)).cast("long")  # noqa: E731  the first cell of length k that begins inside
    high = lambda k: F.floor((last + 1) / F.pow(F.lit(2), k)).cast("long")  # noqa: E731  behind the last one that ends inside
    inside = lambda k, cell: (cell >= low(k)) & (cell < high(k))
    covered = lambda k, cell: inside(k + 1, F.floor(cell / 2).cast("long"))  # noqa: E731  a longer cell inside holds it

    def cells(k: Column) -> Column:
        ends = F.array_distinct(F.array(low(k), high(k) - 1))
        return F.transform(F.filter(ends, lambda c: inside(k, c) & ((k == LEVELS) | ~covered(k, c))), lambda c: F.struct(k.alias("level"), c.alias("cell")))

    longest = F.transform(F.when(high(F.lit(LEVELS)) > low(F.lit(LEVELS)), F.sequence(low(F.lit(LEVELS)), high(F.lit(LEVELS)) - 1)).otherwise(F.array().cast("array<bigint>")), lambda c: F.struct(F.lit(LEVELS).alias("level"), c.alias("cell")))
    return F.array_distinct(F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), cells)), longest))


def forgotten(log: DataFrame) -> DataFrame:
    """seq of the lines that a later line of their user has forgotten. log: seq (unique), user, op, predicate, objects, nodes, at,
    name, start, end."""
    said = log.where(F.col("op") == SAID)
    told = lambda op: log.where(F.col("op") == op)
    later = F.col("f_seq") > F.col("seq")

    objects = F.array_distinct(F.coalesce("objects", F.array().cast("array<string>")))
    patterns = told(PATTERN).select("user", "predicate", F.array_sort(objects).alias("wanted"), F.col("seq").alias("f_seq"))
    # of patterns that are alike only the last counts; they meet the lines by their first object
    last = patterns.groupBy("user", "predicate", "wanted").agg(F.max("f_seq").alias("f_seq")).withColumn("object", F.coalesce(F.get("wanted", F.lit(0)), F.lit("")))
    held = said.select("seq", "user", "predicate", objects.alias("objects"), F.explode(F.array_append(F.array_distinct(F.filter(objects, lambda x: x != "")), F.lit(""))).alias("object"))
    by_pattern = held.join(last, ["user", "predicate", "object"]).where(later & (F.size(F.array_except("wanted", "objects")) == 0)).select("seq")

    names = told(ENTITY).select("user", name_stem(F.col("name")).alias("stem"), F.col("seq").alias("f_seq")).groupBy("user", "stem").agg(F.max("f_seq").alias("f_seq"))
    touched = said.select("seq", "user", F.explode(F.array_distinct(F.transform(F.coalesce("nodes", F.array().cast("array<string>")), name_stem))).alias("stem"))
    by_name = touched.join(names, ["user", "stem"]).where(later).select("seq")

    spans = told(INTERVAL).where("start < end").select("user", "start", "end", F.col("seq").alias("f_seq"), F.explode(cover_of(F.col("start"), F.col("end"))).alias("c")).select("user", "start", "end", "f_seq", "c.*")
    timed = said.where("at IS NOT NULL").select("seq", "user", "at", F.explode(cells_of(F.col("at"))).alias("c")).select("seq", "user", "at", "c.*")
    by_time = timed.join(spans, ["user", "level", "cell"]).where(later & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).select("seq")
    return by_pattern.unionByName(by_name).unionByName(by_time).distinct()


def replay(log: DataFrame) -> DataFrame:
    """The lines that are still known when the whole log has been read."""
    return log.where(F.col("op") == SAID).join(forgotten(log), "seq", "left_anti")


def compacted(log: DataFrame) -> DataFrame:
    """A log that replays to the same, whatever is appended to it: only what is still known."""
    return replay(log)
