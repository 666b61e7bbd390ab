"""The queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, features, html_text, language, line_dedup, packing, pii, quality, run_index, simhash, url_reputation, variants, warc
from millrace.llm.sql import SQL
from millrace.runtime import table

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def over(name: str, operator: Callable[..., DataFrame], *more: str) -> Query:
    """A query that hands whole tables to an operator."""
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, x) for x in (name, *more)))


QUERIES: dict[str, Query] = {
    "op1_simhash": over("documents", simhash.op1_simhash),
    "op2_decontamination": over("documents", decontam.op2_decontamination, "benchmark"),
    "op3_line_dedup": over("documents", lambda docs: line_dedup.op3_line_dedup(docs, line_dedup.LinePolicy(short_lines=True))),
    "op4_pii": over("documents", pii.op4_pii),
    "op5_url_filters": over("pages", url_reputation.op5_url_filters, "labels"),
    "op6_quality_rules": over("documents", quality.op6_quality_rules, "labels"),
    "op7_best_fit_packing": over("documents", packing.op7_best_fit_packing),
    "op8_warc": over("pages", warc.op8_warc),
    "op9_html_extraction": over("pages", html_text.op9_html_extraction),
    "op10_run_index_dedup": over("documents", run_index.op10_run_index_dedup),
    "op11_spelling_variants": over("documents", variants.op11_spelling_variants),
    "op12_feature_table": over("sales", features.op12_feature_table, "clicks", "sale_lines"),
    "op13_language_id": over("documents", language.op13_language_id),
}
