"""Expressions are worked out once, however often their value is used."""

import datetime as dt

from millrace.functions import arithmetic, phrases
from millrace.operators import text as texts
from pyspark.sql import functions as F


def planned(frame):
    return frame._jdf.queryExecution().analyzed().toString()


def test_a_sum_is_read_once(spark):
    frame = spark.createDataFrame([("2 plus 3",)], "t string").select(arithmetic.compute(F.col("t")).alias("x"))
    assert planned(frame).count("regexp_extract_all(t#") == 1
    assert frame.select("x.said", "x.result").first() == ("2 + 3", "5")


def test_words_of_time_are_read_once(spark):
    frame = spark.createDataFrame([("za 3 dny", dt.datetime(2026, 7, 17))], "t string, now timestamp_ntz").select(phrases.temporal_interval(F.col("t"), F.col("now")).alias("x"))
    assert planned(frame).count("regexp_extract_all(t#") == 1


def test_once_each_keeps_all_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id long, t string")
    found = texts.once_each(rows, ["t"], "n", F.coalesce(F.length("t"), F.lit(-1)))
    assert found.columns == ["id", "t", "n"] and sorted(found.collect()) == [(1, "a", 1), (2, "a", 1), (3, None, -1), (4, None, -1), (5, "b", 1)]
