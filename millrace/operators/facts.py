"""The fact graph as tables.

facts: fact_id, predicate, participants (array of role, node, type, sorted by role and node), weight, seq.
provenance: fact_id, source. One row per pair, so that no fact gathers all its sources in one value.
participants: the facts' participants as rows; the inverted index by node.

seq orders facts by their first appearance and breaks every tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import strings

PARTICIPANTS = "array<struct<role:string,node:string,type:string>>"


def lower_first(text: Column) -> Column:
    """Only a predicate's first character becomes small."""
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def participant(role: str, node: Column, kind: str | Column) -> Column:
    return F.struct(F.lit(role).alias("role"), node.cast("string").alias("node"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))


def fact_id(predicate: Column, participants: Column) -> Column:
    """The same in every process: a digest of the predicate and the sorted roles and nodes."""
    parts = F.transform(participants, lambda p: F.concat_ws("\x1f", p["role"], p["node"]))
    return F.sha2(F.concat_ws("\x1e", predicate, F.array_join(parts, "\x1e")), 256)


def make_facts(rows: DataFrame, predicate: Column, participants: Sequence[Column], *more: str) -> DataFrame:
    """rows with predicate and participants as facts have them; participants without a node are left out."""
    held = F.array_sort(F.filter(F.array(*participants).cast(PARTICIPANTS), lambda p: p["node"].isNotNull()))
    return rows.select(lower_first(predicate).alias("predicate"), held.alias("participants"), *more)


def upsert(mentions: DataFrame) -> DataFrame:
    """Facts with weight = number of mentions. mentions: predicate, participants, seq and perhaps weight."""
    weight = F.sum("weight") if "weight" in mentions.columns else F.count("*")
    summed = mentions.groupBy("predicate", "participants").agg(weight.alias("weight"), F.min("seq").alias("seq"))
    return summed.select(fact_id(F.col("predicate"), F.col("participants")).alias("fact_id"), "predicate", "participants", "weight", "seq")


def identified(counted: DataFrame, *more: str) -> DataFrame:
    """Rows that are one for each fact already, with the facts' columns."""
    return counted.select(fact_id(F.col("predicate"), F.col("participants")).alias("fact_id"), "predicate", "participants", "weight", "seq", *more)


def upsert_counted(mentions: DataFrame) -> DataFrame:
    """upsert with n_sources, the number of different sources, in one pass over the mentions."""
    summed = mentions.groupBy("predicate", "participants").agg(F.count("*").alias("weight"), F.min("seq").alias("seq"), F.count_distinct("source").alias("n_sources"))
    return summed.select(fact_id(F.col("predicate"), F.col("participants")).alias("fact_id"), "predicate", "participants", "weight", "seq", "n_sources")


def provenance(mentions: DataFrame) -> DataFrame:
    return mentions.select(fact_id(F.col("predicate"), F.col("participants")).alias("fact_id"), "source").distinct()


def keyed(facts: DataFrame) -> DataFrame:
    """facts with a fact_id of 16 bytes, a digest of their own, for steps that only meet by it and make it anew: 64 letters of a
    digest don't compress, and are most of what a participant's row moves."""
    return facts.withColumn("fact_id", F.unhex(F.md5("fact_id")))


def explode_participants(facts: DataFrame) -> DataFrame:
    """fact_id, predicate, role, node, type, weight, seq."""
    return facts.select("fact_id", "predicate", F.explode("participants").alias("p"), "weight", "seq").select("fact_id", "predicate", "p.role", "p.node", "p.type", "weight", "seq")


def nodes(facts: DataFrame) -> DataFrame:
    """id, type (of the first fact), weight: the sum over all participations."""
    return explode_participants(facts).groupBy(F.col("node").alias("id")).agg(F.min_by("type", F.struct("seq", "role")).alias("type"), F.sum("weight").alias("weight"))


def node_of(participants: Column, role: str) -> Column:
    """The node in a role, null where there is none."""
    return F.try_element_at(F.filter(participants, lambda p: p["role"] == role), F.lit(1))["node"]


def facts_of(facts: DataFrame, node: str, role: str | None = None, predicate: str | None = None) -> DataFrame:
    """The facts in which a node takes part, perhaps in a role."""
    found = facts if predicate is None else facts.where(F.col("predicate") == predicate)
    return found.where(F.exists("participants", lambda p: (p["node"] == node) & (F.lit(True) if role is None else p["role"] == role)))


def facts_of_predicates(facts: DataFrame, predicates: Sequence[str]) -> DataFrame:
    return facts.where(F.col("predicate").isin(*predicates))


def predicate_roles(participants: DataFrame) -> DataFrame:
    """The roles that each predicate ever carries."""
    return participants.groupBy("predicate").agg(F.sort_array(F.collect_set("role")).alias("roles"))


def instance_lit(roles: Column, hole: str) -> Column:
    """Whether a predicate carries a role: null where it is not known at all."""
    return F.when(F.size(roles) > 0, F.array_contains(roles, hole))


def remap(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with nodes renamed; those left with fewer than two different nodes go, those that fall together add up.

    mapping: node, target (one row per node)."""
    rows = explode_participants(keyed(facts)).join(mapping.select("node", "target"), "node", "left")
    renamed = rows.withColumn("node", F.coalesce("target", "node"))
    gathered = renamed.groupBy("fact_id", "predicate", "weight", "seq").agg(F.array_sort(F.collect_set(F.struct("role", "node", "type"))).alias("participants"))
    whole = gathered.where(F.size(F.array_distinct(F.transform("participants", lambda p: p["node"]))) >= 2)
    return upsert(whole)


def aliases(mapping: DataFrame) -> DataFrame:
    """canonical, alias."""
    return mapping.where("node <> target").select(F.col("target").alias("canonical"), F.col("node").alias("alias")).distinct()


def canonical_by_cluster(names: DataFrame, key: Column | None = None) -> DataFrame:
    """names: node. Per cluster key its canonical name, the shortest and then the first in order, and the members."""
    keyed = names.select("node", F.array_join(strings.cluster_key(F.col("node")) if key is None else key, " ").alias("key"))
    least = keyed.groupBy("key").agg(F.min(F.struct(F.length("node").alias("size"), F.col("node"))).alias("best"), F.count_distinct("node").alias("members"))
    return least.select("key", F.col("best.node").alias("canonical"), "members")


def cluster_mapping(names: DataFrame) -> DataFrame:
    """node, target: the map that renames each name to its cluster's canonical one."""
    keyed = names.select("node", F.array_join(strings.cluster_key(F.col("node")), " ").alias("key"))
    return keyed.join(canonical_by_cluster(names), "key").where("node <> canonical").select("node", F.col("canonical").alias("target"))


def positional_mapping(canonical: DataFrame) -> DataFrame:
    """A shorter name of several words goes to the only longer one with the same first and last stem.

    canonical: key (stems joined by blanks), canonical. Chains are followed by the caller with `remap` until no row is
    left; each step lengthens the name."""
    parts = canonical.select("key", "canonical", F.split("key", " ").alias("stems")).where(F.size("stems") >= 2)
    ends = parts.select("key", "canonical", F.size("stems").alias("n"), F.element_at("stems", 1).alias("first"), F.element_at("stems", -1).alias("last"))
    longer = ends.select(F.col("canonical").alias("target"), F.col("n").alias("m"), "first", "last")
    pairs = ends.join(longer, ["first", "last"]).where("m > n")
    only = pairs.groupBy("canonical").agg(F.count("*").alias("targets"), F.min("target").alias("target")).where("targets = 1")
    return only.select(F.col("canonical").alias("node"), "target")


def frequency_canon(surfaces: DataFrame) -> DataFrame:
    """surface, freq -> surface, canonical: the most frequent member of its cluster, the first in order of equal ones."""
    keyed = surfaces.select("surface", "freq", F.array_join(strings.cluster_key(F.col("surface")), " ").alias("key"))
    summed = keyed.groupBy("key", "surface").agg(F.sum("freq").alias("freq"))
    best = summed.groupBy("key").agg(F.min_by("surface", F.struct(-F.col("freq"), F.col("surface"))).alias("canonical"))
    return summed.join(best, "key").select("surface", "canonical")


def document_links(shared: DataFrame, most_documents: int | None = None) -> DataFrame:
    """doc, node (distinct rows). (a, b, weight) both ways: the nodes that two documents share.

    A node makes pairs of all its documents; most_documents leaves out nodes that are in more (hubs link everything)."""
    rows = shared.select("doc", "node").distinct()
    if most_documents is not None:
        rare = rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") <= most_documents)
        rows = rows.join(rare.select("node"), "node")
    pairs = rows.alias("x").join(rows.alias("y"), "node").where("x.doc < y.doc").groupBy(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).agg(F.count("*").alias("weight"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def name_families(names: DataFrame) -> DataFrame:
    """node -> stem, members: the names that share a stem, for stems with more than one."""
    stems = names.select("node", F.explode(strings.name_stems(F.col("node"))).alias("stem"))
    return stems.groupBy("stem").agg(F.sort_array(F.collect_set("node")).alias("members")).where(F.size("members") > 1)


def fingerprints(participants: DataFrame) -> DataFrame:
    """node, neighbour: who takes part in a node's facts, times and numbers aside."""
    other = participants.where(~F.col("type").isin("time", "number")).select("fact_id", F.col("node").alias("neighbour"))
    return participants.select("fact_id", "node").join(other, "fact_id").where("node <> neighbour").select("node", "neighbour").distinct()


def overlap(prints: DataFrame, least: int = 3, pairs: DataFrame | None = None, within: Sequence[str] = ()) -> DataFrame:
    """(a, b, shared): nodes with at least `least` neighbours in common; only among pairs (a, b) if those are given, and only
    of nodes that agree in the columns `within`, which are met by together with the neighbour."""
    left, right = prints.select(*within, F.col("node").alias("a"), "neighbour"), prints.select(*within, F.col("node").alias("b"), "neighbour")
    if pairs is not None:
        joined = pairs.select("a", "b").join(left, "a").join(right, [*within, "b", "neighbour"])
    else:
        joined = left.join(right, [*within, "neighbour"]).where("a < b")
    return joined.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def date_facts(participants: DataFrame) -> DataFrame:
    """node, part, value: what a time node's text tells of year, month and day."""
    parts = strings.date_parts(F.col("node"))
    dated = participants.where("type = 'time'").select("node").distinct().withColumn("parts", parts)
    stacked = dated.select("node", F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(f"parts.{n}").alias("value")) for n in ("year", "month", "day")))).alias("x"))
    return stacked.where("x.value is not null").select("node", "x.part", "x.value")


def export_nodes(facts: DataFrame) -> DataFrame:
    """Rows of a bipartite export: entities and facts."""
    entities = nodes(facts).select("id", F.lit("entity").alias("kind"), "type", "weight")
    return entities.unionByName(facts.select(F.col("fact_id").alias("id"), F.lit("fact").alias("kind"), F.col("predicate").alias("type"), "weight"))


def export_edges(facts: DataFrame) -> DataFrame:
    return explode_participants(facts).select(F.col("fact_id").alias("source"), F.col("node").alias("target"), "role", "weight")
