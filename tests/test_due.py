"""Due times and plans: texts around one moment."""

import datetime

from millrace.functions import due
from pyspark.sql import functions as F

D = datetime.datetime
NOW = D(2026, 7, 17, 12, 0)
DUE = {
    "za deset minut vybrat maso": D(2026, 7, 17, 12, 10), "za hodinu": D(2026, 7, 17, 13), "za 3 dny": D(2026, 7, 20, 12), "za chvíli": D(2026, 7, 17, 12, 15), "za čtvrt hodiny": D(2026, 7, 17, 12, 15), "za půl hodiny": D(2026, 7, 17, 12, 30),
    "v 18:30 zavolat": D(2026, 7, 17, 18, 30), "v 9:00": D(2026, 7, 18, 9), "v 25:00": None, "svátek 21. června": D(2027, 6, 21, 9), "svátek 21. srpna den předem": D(2026, 8, 20, 9), "21. srpna 2028": D(2028, 8, 21, 9), "31. února": None,
    "zítra koupit rohlíky": D(2026, 7, 18, 9), "pozítří": D(2026, 7, 19, 9), "koupit rohlíky": None, "až zítra ráno": D(2026, 7, 18, 7), "vzbuď mě ráno v šest": D(2026, 7, 18, 6), "večer v 8": D(2026, 7, 17, 20), "ráno": D(2026, 7, 18, 7),
    "v září koupit učebnice": D(2026, 9, 1, 9), "v lednu revize": D(2027, 1, 1, 9), "v červenci": D(2026, 7, 18, 9), "příští rok obnovit pas": D(2027, 1, 1, 9), "příští rok v září": D(2027, 9, 1, 9), "za měsíc dva týdny předem": D(2026, 8, 3, 12), "": None,
}
PLANS = {
    "jede ve tři vlak": (D(2026, 7, 17, 13), D(2026, 7, 17, 15), True), "v 17:00 vyzvednout": (D(2026, 7, 17, 15), D(2026, 7, 17, 17), True), "v 13:00": (D(2026, 7, 17, 12, 5), D(2026, 7, 17, 13), True), "v 9:00": (D(2026, 7, 18, 9), None, False),
    "dnes zavolat": (D(2026, 7, 17, 15), None, True), "zítra zavolat": (D(2026, 7, 18, 7), None, True), "zítra večer": (D(2026, 7, 18, 19), None, False), "příští týden úklid": (D(2026, 7, 19, 19), D(2026, 7, 20), True), "příští měsíc": (D(2026, 7, 31, 19), D(2026, 8, 1), True),
    "ráno v šest": (D(2026, 7, 18, 6), None, False), "za hodinu": (D(2026, 7, 17, 13), None, False), "21. srpna": (D(2026, 8, 21, 9), None, False), "úklid": None, "v 23": (D(2026, 7, 17, 21), D(2026, 7, 17, 23), True),
}


def test_due_times(spark):
    rows = spark.createDataFrame([(t,) for t in (*DUE, None)], "text string")
    got = {r["text"]: r["d"] for r in rows.select("text", due.due_time(F.col("text"), F.lit(NOW).cast("timestamp_ntz")).alias("d")).collect()}
    assert got == {**DUE, None: None}


def test_plans(spark):
    rows = spark.createDataFrame([(t,) for t in PLANS], "text string")
    got = {r["text"]: r["p"] and tuple(r["p"]) for r in rows.select("text", due.plan(F.col("text"), F.lit(NOW).cast("timestamp_ntz")).alias("p")).collect()}
    assert got == PLANS
