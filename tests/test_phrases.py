"""Words of time against a clock that stands at Friday, 17 July 2026, noon."""

import datetime as dt

from millrace.functions import fixed, phrases
from millrace.operators import present
from pyspark.sql import functions as F

NOW = dt.datetime(2026, 7, 17, 12)
D = dt.datetime


CASES = [
    ("v 18. nebo 19. století", (D(1701, 1, 1), D(1901, 1, 1), "century")), ("co dělá teď?", (D(2026, 7, 17, 11, 52, 30), D(2026, 7, 17, 12, 7, 30), "moment")),
    ("narozen 21.1.1900.", (D(1900, 1, 21), D(1900, 1, 22), "day")), ("21. ledna 1900", (D(1900, 1, 21), D(1900, 1, 22), "day")), ("31.2.1900", None),
    ("v září", (D(2026, 9, 1), D(2026, 10, 1), "month")), ("v lednu 2027", (D(2027, 1, 1), D(2027, 2, 1), "month")), ("v září příští rok", (D(2027, 9, 1), D(2027, 10, 1), "month")),
    ("zítra.", (D(2026, 7, 18), D(2026, 7, 19), "day")), ("předevčírem", (D(2026, 7, 15), D(2026, 7, 16), "day")), ("před dvěma hodinami", (D(2026, 7, 17, 10), D(2026, 7, 17, 11), "hour")),
    ("za 3 dny", (D(2026, 7, 20), D(2026, 7, 21), "day")), ("před týdnem", (D(2026, 7, 10), D(2026, 7, 11), "day")), ("před rokem", (D(2025, 7, 17), D(2025, 7, 18), "day")),
    ("příští týden", (D(2026, 7, 20), D(2026, 7, 27), "week")), ("minulý měsíc", (D(2026, 6, 1), D(2026, 7, 1), "month")), ("letos", (D(2026, 1, 1), D(2027, 1, 1), "year")),
    ("tento týden", (D(2026, 7, 13), D(2026, 7, 20), "week")), ("nic", None), ("", None), (None, None),

]


def test_intervals(spark):
    rows = spark.createDataFrame([(i, text, NOW) for i, (text, _) in enumerate(CASES)], "i int, t string, now timestamp_ntz")
    found = {r["i"]: tuple(r["x"]) if r["x"] else None for r in rows.select("i", phrases.temporal_interval(F.col("t"), F.col("now")).alias("x")).collect()}
    assert found == {i: want for i, (_, want) in enumerate(CASES)}


def test_clock_and_claimed_words(spark):
    rows = spark.createDataFrame([("kolik je hodin", NOW), ("co je za den", NOW), ("jiné", NOW)], "t string, now timestamp_ntz")
    said = rows.select(present.clock_answer(F.col("t"), F.col("now"), fixed.WEEKDAY_NAMES, fixed.MONTH_GENITIVES, fixed.CLOCK_DAY, fixed.CLOCK_TIME)).collect()
    assert [r[0] for r in said] == ["Je 12:00.", "Dnes je pátek 17. července 2026.", None]
    assert {"zitra", "rano", "tyden", "pristi"} <= phrases.claimed_words()
