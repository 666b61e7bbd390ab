"""What is kept between runs: retrieval and sentence indexes, the fact graph, annotations, sessions, settings.

Each store is a folder of Parquet tables in whatever file system Spark reads, written whole and read lazily.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from typing import Any, TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import strings
from millrace.operators import retrieval, text

Settings = TypeVar("Settings")


def save_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each table under its name. A store that is being replaced must not be one that the tables are read from."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


# Retrieval


def save_index(index: retrieval.Index, path: str) -> None:
    """postings, term_stats, lengths and corpus; the postings sorted by term in files, so that a query's terms skip most."""
    tables = {"lengths": index.lengths, "corpus": index.corpus, "term_stats": index.term_stats}
    save_tables(tables, path)
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def load_index(spark: SparkSession, path: str, key: str) -> retrieval.Index:
    held = load_tables(spark, path, "postings", "term_stats", "lengths", "corpus")
    index = object.__new__(retrieval.Index)
    index.key, index.words = key, None
    index.postings, index.term_stats, index.lengths, index.corpus = (held[x] for x in ("postings", "term_stats", "lengths", "corpus"))
    return index


class SentenceIndex:
    """sentences: doc_id, sent, line; bounds: doc_id, n (its number of sentences); and the index over single sentences."""

    def __init__(self, docs: DataFrame, terms: Column | None = None):
        self.sentences = text.explode_sentences(docs).select("doc_id", F.col("sent_idx").alias("sent"), F.col("text").alias("line"))
        self.bounds = self.sentences.groupBy("doc_id").agg(F.count("*").alias("n"))
        keyed = self.sentences.withColumn("key", F.struct("doc_id", "sent"))
        self.index = retrieval.Index(keyed, "key", strings.tokens(F.col("line")) if terms is None else terms)

    def save(self, path: str) -> None:
        save_tables({"sentences": self.sentences, "bounds": self.bounds}, path)
        save_index(self.index, f"{path}/index")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SentenceIndex:
        out = object.__new__(cls)
        held = load_tables(spark, path, "sentences", "bounds")
        out.sentences, out.bounds, out.index = held["sentences"], held["bounds"], load_index(spark, f"{path}/index", "key")
        return out


# Graph and annotations

GRAPH = ("facts", "provenance", "aliases", "doc_links", "name_families")


def save_graph(tables: Mapping[str, DataFrame], path: str) -> None:
    """The tables of GRAPH that are given; facts must be."""
    if unknown := set(tables) - set(GRAPH):
        raise ValueError(f"no tables of a graph: {sorted(unknown)}")
    if "facts" not in tables:
        raise ValueError("a graph has facts")
    save_tables(tables, path)


def load_graph(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return load_tables(spark, path, *(names or GRAPH))


def save_annotations(tokens: DataFrame, entities: DataFrame, path: str, parts: int = 64) -> None:
    """In the order of parts by the documents' hash, so that files and row groups without the asked documents are skipped."""
    for name, frame in (("tokens", tokens), ("entities", entities)):
        frame.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartitionByRange("part").sortWithinPartitions("part", "doc_id").write.mode("overwrite").parquet(f"{path}/{name}")


def load_annotations(spark: SparkSession, path: str, doc_ids: list | None = None, parts: int = 64) -> dict[str, DataFrame]:
    held = load_tables(spark, path, "tokens", "entities")
    if doc_ids is not None:
        kind = held["tokens"].schema["doc_id"].dataType
        wanted = spark.createDataFrame([(x,) for x in doc_ids], f"doc_id {kind.simpleString()}").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
        held = {name: frame.join(F.broadcast(wanted), ["part", "doc_id"], "left_semi") for name, frame in held.items()}
    return {name: frame.drop("part") for name, frame in held.items()}


# Sessions

SESSION = "name string, seq long, graph_path string, weights map<string,double>, history array<struct<question:string,topic:string,predicate:string,answer:string,gravity:array<string>>>"


def save_session(spark: SparkSession, path: str, name: str, seq: int, weights: Mapping[str, float], history: list[dict], graph_path: str | None = None) -> None:
    """One more state of a session; none is overwritten, so sessions can be saved at the same time."""
    rows = [(name, seq, graph_path, dict(weights), [tuple(x.get(k) for k in ("question", "topic", "predicate", "answer", "gravity")) for x in history])]
    spark.createDataFrame(rows, SESSION).coalesce(1).write.mode("append").parquet(path)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each session."""
    rows = spark.read.schema(SESSION).parquet(path)
    return rows.groupBy("name").agg(F.max_by(F.struct("seq", "graph_path", "weights", "history"), "seq").alias("s")).select("name", "s.*")


# Settings


def settings_from(kind: type[Settings], data: Mapping[str, Any]) -> Settings:
    """A dataclass of blocks from nested values: what it doesn't know is left out, what is missing keeps its default."""
    values = {}
    for field in dataclasses.fields(kind):
        if field.name in data:
            default = field.default_factory() if field.default_factory is not dataclasses.MISSING else field.default
            nested = dataclasses.is_dataclass(default) and isinstance(data[field.name], Mapping)
            values[field.name] = settings_from(type(default), data[field.name]) if nested else data[field.name]
    return kind(**values)


def load_settings(spark: SparkSession, kind: type[Settings], path: str) -> Settings:
    text_of = spark.read.text(path, wholetext=True).first()
    return settings_from(kind, json.loads(text_of["value"]) if text_of else {})


def save_settings(spark: SparkSession, settings: Any, path: str) -> None:
    body = json.dumps(dataclasses.asdict(settings), ensure_ascii=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
