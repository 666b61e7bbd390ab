"""The corpus pipeline: five stages, each over all that the one before it kept, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, line_dedup, packing, quality, similar, simhash
from millrace.runtime import HELD, released, remove, settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the rules' limits are fitted to the labelled documents.

    Null text goes. Every row is judged for itself, so null and repeated ids and repeated rows don't matter; columns stay as
    they are, whatever their names. An empty table stays empty."""
    return quality.filter_quality(docs, quality.fitted_policy(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which only blanks would be left; n_chars follows the text.

    Null text stays. Of equal lines the one in the row with the least id stays; rows that share an id, or have none, are
    documents of their own, those without an id first; equal rows lose the same lines. Columns keep their names."""
    out = line_dedup.dedup_lines(docs, line_dedup.LinePolicy(short_lines=True))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.length("text").cast(kind))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of texts linked by SimHash fingerprints (two bits of 64) or by a Jaccard
    similarity of 0.8 of their 5-word shingles, which the fingerprints are too narrow to tell; links of both kinds chain.

    Null and empty texts are copies of each other. The least id stays, with all rows that have it and a text of the group;
    rows without an id stay. Columns keep their names; an empty table stays empty."""
    with released(spark) as kept:  # what the fingerprints need goes before the shingle sets are made
        found = simhash.near_duplicate_groups(docs.select("doc_id", "text"), key=True)
        linked = settle(found.select("doc_id", "key", F.col("component_id").alias("group")), "pipeline-fingerprints")
        kept.append(HELD[-1])
    return similar.drop_similar(docs, linked)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Each row is judged for itself, whatever its id; null text stays. Columns keep their names; an empty table stays empty."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences.

    Null text is an empty document. Repeated rows are packed as often as they occur; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed_sequences),
]

#: Fingerprints, tokens and packing are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with released(spark) as kept:  # what a stage has settled goes as soon as its result is written, as does its input
            docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(HELD[-1])
        if before:
            remove(spark, before)
        before = HELD[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
