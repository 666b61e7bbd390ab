"""Replay of a diary against reading it line by line."""

import datetime
import random

from millrace.functions import strings
from millrace.operators import diary
from pyspark.sql import functions as F

LOG = "seq long, user string, op string, predicate string, objects array<string>, nodes array<string>, at timestamp_ntz, name string, start timestamp_ntz, end timestamp_ntz"
T0 = datetime.datetime(2024, 1, 1)


def random_log(seed, n):
    rnd = random.Random(seed)
    when = lambda: T0 + datetime.timedelta(days=rnd.randrange(-40, 400), seconds=rnd.choice([0, 1, 43200, 86399]))
    some = lambda k: [rnd.choice(["pes", "kočka", "", "dům"]) for _ in range(rnd.randrange(k))]
    out = []
    for seq in range(n):
        user, predicate = rnd.choice(["a", "b", None]), rnd.choice(["mít", "vidět", None])
        op = rnd.choice([diary.SAID] * 6 + [diary.PATTERN, diary.ENTITY, diary.INTERVAL])
        a, b = when(), when()
        if rnd.random() < 0.5:
            b = a + datetime.timedelta(seconds=rnd.choice([1, 3600, 200_000]))
        said = op == diary.SAID
        out.append((seq, user, op, predicate, rnd.choice([None, some(4), some(3)]), [rnd.choice(["Jan", "Janu", "Eva", "Petr"]) for _ in range(rnd.randrange(3))] if said else None, rnd.choice([None, when(), when()]) if said else None, None if said else rnd.choice(["Jana", "Evou", None]), None if said else a, None if said else b))
    return out


def line_by_line(rows, stem):
    kept = []
    for seq, user, op, predicate, objects, nodes, at, name, start, end in rows:
        if op == diary.SAID:
            kept.append((seq, user, predicate, set(objects or ()), nodes or (), at))
            continue
        gone = {
            diary.PATTERN: lambda r: r[2] == predicate and predicate is not None and set(objects or ()) <= r[3],
            diary.ENTITY: lambda r: name is not None and any(stem[x] == stem[name] for x in r[4]),
            diary.INTERVAL: lambda r: r[5] is not None and start <= r[5] < end,
        }[op]
        kept = [r for r in kept if not (user is not None and r[1] == user and gone(r))]  # noqa: B023
    return {r[0] for r in kept}


def test_replay(spark):
    words = spark.createDataFrame([(w,) for w in ("Jan", "Janu", "Eva", "Petr", "Jana", "Evou")], "w string")
    stem = {r["w"]: r["s"] for r in words.select("w", strings.name_stem(F.col("w")).alias("s")).collect()}
    for seed in range(3):
        rows = random_log(seed, 400)
        log = spark.createDataFrame(rows, LOG)
        want = line_by_line(rows, stem)
        assert {r["seq"] for r in diary.replay(log).collect()} == want and 20 < len(want) < 250
    assert {r["seq"] for r in diary.replay(diary.compacted(log)).collect()} == want


def test_cover(spark):
    """Each day of an interval lies in one of its cells, no day far outside does, and there are few cells."""
    rnd = random.Random(1)
    spans = [(i, T0 + datetime.timedelta(days=rnd.randrange(-900, 900)), rnd.choice([1, 2, 31, 400, 5000, 300_000])) for i in range(40)]
    rows = [(i, a, a + datetime.timedelta(days=n) - datetime.timedelta(seconds=1)) for i, a, n in spans]
    found = spark.createDataFrame(rows, "i int, a timestamp_ntz, b timestamp_ntz").select("i", diary.cover_of(F.col("a"), F.col("b")).alias("c")).collect()
    for r, (_, a, n) in zip(sorted(found), spans, strict=True):
        first = (a - datetime.datetime(1970, 1, 1)).days
        days = [d for c in r["c"] for d in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"])]
        assert sorted(days) == list(range(first, first + n)) and len(r["c"]) <= 2 * diary.LEVELS + 3
