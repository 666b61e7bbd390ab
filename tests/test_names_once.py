"""A line's tokens are worked out once, however often its names are looked for in them."""

import re

from millrace import catalogue, catalogue_questions  # noqa: F401
from millrace.plans import questions
from pyspark.sql import functions as F


def test_tokens_are_bound(spark):
    no = F.lit(False)
    sub = F.lit(None).cast("struct<predicate: string, object: string>")
    tokens = F.transform(F.split("t", " "), lambda x: F.struct(F.upper(x).alias("form"), x.alias("norm"), no.alias("skip"), no.alias("relational"), no.alias("boundary"), no.alias("gone"), no.alias("relative"), sub.alias("sub")))
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    found = spark.createDataFrame([("a b c",)], "t string").select(questions.split_names(tokens, spans).alias("n"))
    assert len(re.findall(r"upper\(", found._jdf.queryExecution().optimizedPlan().toString())) <= 2
    assert [[(x["start"], x["text"]) for x in r["n"]] for r in found.collect()] == [[(0, "A B")]]


def test_lines_are_split_once(spark, sf_dir):
    plan = catalogue.QUERIES["name_segments"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
