"""Memory over an append-only log: insert, recall, forget; and reminders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.strings import name_stem
from millrace.functions.temporal import contains

KINDS = ("episode", "attributed", "attribute", "event", "observation", "note")


def forget_interval(log: DataFrame, at: Column, start: Column, end: Column) -> DataFrame:
    """The log without what lies in the interval; rows without a time stay."""
    return log.where(~F.coalesce(contains(start, end, at), F.lit(False)))


def forget_pattern(log: DataFrame, predicate: str, objects: list[str]) -> DataFrame:
    """The log without rows of the predicate that hold all the objects."""
    held = F.forall(F.array(*(F.lit(x) for x in objects)).cast("array<string>"), lambda x: F.array_contains("objects", x))
    return log.where(~((F.col("predicate") == predicate) & held))


def forget_entity(facts: DataFrame, participants: DataFrame, name: str) -> DataFrame:
    """Facts without those that touch a node with the stem of the name."""
    touched = participants.where(name_stem(F.col("node")) == name_stem(F.lit(name))).select("fact_id").distinct()
    return facts.join(touched, "fact_id", "left_anti")


def recall(log: DataFrame, user: Column, label: Column, at: Column | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Sorted labels of a user's rows, perhaps within an interval."""
    rows = log if at is None else log.where(contains(start, end, at))
    return rows.select(user.alias("user"), label.alias("label")).distinct().orderBy("user", "label")


def due(reminders: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(fired, kept): what is due at now leaves the store, once."""
    return reminders.where(F.col("due") <= now), reminders.where((F.col("due") > now) | F.col("due").isNull())


def contact(emails: DataFrame, names: DataFrame, least_prefix: int = 3) -> DataFrame:
    """names: name -> name, email: by the stem, else by the only one whose stem it begins."""
    known = emails.select(name_stem(F.col("name")).alias("stem"), "email").distinct()
    asked = names.select("name", name_stem(F.col("name")).alias("asked"))
    same = asked.join(known, F.col("stem") == F.col("asked"))
    longer = asked.where(F.length("asked") >= least_prefix).join(known, F.substring("stem", 1, least_prefix) == F.substring("asked", 1, least_prefix))
    pairs = same.unionByName(longer.where(F.col("stem").startswith(F.col("asked")))).distinct()
    best = pairs.groupBy("name").agg(F.min(F.when(F.col("stem") == F.col("asked"), F.col("email"))).alias("same"), F.count_distinct("email").alias("n"), F.min("email").alias("only"))
    return best.select("name", F.coalesce("same", F.when(F.col("n") == 1, F.col("only"))).alias("email"))


def statement_facts(statements: DataFrame, user: Column, email: str = r"^[^@\s]+@[^@\s]+\.[^@\s]+$") -> DataFrame:
    """predicate, participants, seq: statements as facts by their kind. statements: seq, kind, predicate, objects, places,
    subject, time.

    Notes say their text as it stands; episodes are the user's; attributed ones and attributes are their subject's, with the
    user as the source; events have the user as observer; any other kind is said of its first object."""
    kind = F.col("kind")
    part = lambda role, node, type_: F.struct(F.lit(role).alias("role"), node.alias("node"), type_.alias("type"))
    person, concept = F.lit("person"), F.lit("concept")

    def things(objects: Column, role: str, type_: Callable[[Column], Column]) -> Column:
        here = lambda x: F.array_contains(F.coalesce("places", F.array().cast("array<string>")), x)
        return F.transform(objects, lambda x: F.when(here(x), part("loc", x, F.lit("geo"))).otherwise(part(role, x, type_(x))))

    plain = lambda _: concept
    objects = things(F.col("objects"), "obj", plain)
    mails = things(F.col("objects"), "obj", lambda x: F.when(x.rlike(email), "email").otherwise("concept"))
    first, rest = F.try_element_at("objects", F.lit(1)), F.slice("objects", 2, F.greatest(F.size("objects") - 1, F.lit(0)))
    source = F.array(part("theme", user, person))
    said = F.when(kind == "note", F.array(part("subj", user, person), part("pred", first, F.lit("výrok"))))
    said = said.when(kind == "episode", F.concat(F.array(part("subj", user, person)), objects)).when(kind == "attributed", F.concat(F.array(part("subj", F.col("subject"), person)), objects, source))
    said = said.when(kind == "attribute", F.concat(F.array(part("subj", F.col("subject"), person)), mails, source)).when(kind == "event", F.concat(objects, source))
    said = said.otherwise(F.concat(F.array(part("subj", first, concept)), things(rest, "pred", plain), source))
    whole = F.concat(said, F.array(part("time", F.col("time"), F.lit("time"))))
    held = F.array_sort(F.filter(whole, lambda p: p["node"].isNotNull()))
    return statements.select(F.concat(F.lower(F.substring("predicate", 1, 1)), F.substring("predicate", F.lit(2), F.length("predicate"))).alias("predicate"), held.alias("participants"), "seq")


def split_clauses(parsed: DataFrame, whole: DataFrame) -> DataFrame:
    """seq, clause, predicate, objects: a compound's clauses if all of them were read cleanly (a predicate in small letters)
    and there are two at least; else the whole if it was read, else the clean clauses. A clause without a capitalised object
    takes the subject of the last clause before it that has one.

    parsed: seq, clause (from 0, all clauses), predicate (null: not read), objects, needs_subject; whole: seq, predicate,
    objects."""
    clean = F.col("predicate").isNotNull() & ~F.col("predicate").rlike(r"^\p{Lu}")
    rows = parsed.withColumn("clean", clean).withColumn("lead", F.when(F.col("clean"), F.try_element_at(F.filter("objects", lambda x: x.rlike(r"^\p{Lu}")), F.lit(1))))
    before = Window.partitionBy("seq").orderBy("clause").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("subject", F.last("lead", ignorenulls=True).over(before))
    takes = F.col("lead").isNull() & F.col("subject").isNotNull() & ~F.coalesce("needs_subject", F.lit(False))
    filled = rows.withColumn("objects", F.when(takes, F.concat(F.array("subject"), "objects")).otherwise(F.col("objects")))
    sound = rows.groupBy("seq").agg((F.bool_and("clean") & (F.count("*") >= 2)).alias("sound"))
    told = filled.where("clean").join(sound, "seq").join(whole.select("seq", F.lit(True).alias("has_whole")), "seq", "left")
    split = told.where("sound OR has_whole IS NULL").select("seq", "clause", "predicate", "objects")
    rest = whole.join(sound.where("sound"), "seq", "left_anti").select("seq", F.lit(0).alias("clause"), "predicate", "objects")
    return split.unionByName(rest)


def manage_reminders(reminders: DataFrame, commands: DataFrame) -> DataFrame:
    """Reminders after cancelling and moving: each command takes those in its interval (nulls: any time), with its text in the
    task (null: any); the last command that takes a reminder holds. commands: seq, action (cancel or move), start, end, text,
    due (for move). reminders need an id."""
    inside = (F.col("start").isNull() | (F.col("r.due") >= F.col("start"))) & (F.col("end").isNull() | (F.col("r.due") < F.col("end")))
    named = F.col("text").isNull() | F.contains(F.lower("task"), F.lower("text"))
    told = commands.select("seq", "action", "start", "end", "text", F.col("due").alias("new_due"))
    hit = reminders.alias("r").join(F.broadcast(told), inside & named)  # a turn's commands: a handful of rows
    last = hit.groupBy("id").agg(F.max_by(F.struct("action", "new_due"), "seq").alias("c"))
    done = reminders.join(last, "id", "left").where("c IS NULL OR c.action <> 'cancel'")
    return done.withColumn("due", F.when(F.col("c.action") == "move", F.col("c.new_due")).otherwise(F.col("due"))).drop("c")
