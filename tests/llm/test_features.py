"""The feature table against its SQL, on small tables with nulls, repeats and late rows, with spans of very few rows."""

import datetime
import random

import duckdb
import pytest
from millrace.llm import features
from millrace.llm.sql import SQL

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, client string, us int"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, cell string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, known string"
ORDER = "sale_id, d, t_us"


def tables(seed: int, n: int):
    rnd = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    maybe = lambda x, p=0.05: None if rnd.random() < p else x
    when = lambda: start + datetime.timedelta(seconds=rnd.randrange(0, 40 * 86400), microseconds=rnd.choice([0, 0, 7]))
    late = lambda t: t and t + datetime.timedelta(seconds=rnd.choice([0, 5, 900, 86400, 3 * 86400]))
    client = lambda: maybe(0 if rnd.random() < 0.4 else rnd.randrange(12))
    sales, clicks, lines = [], [], []
    for i in range(n):
        t = maybe(when())
        sales.append((maybe(i, 0.02), client(), "done", maybe(rnd.choice([0.005, 10.125, 3.3])), t, maybe(late(t)), 1, "x", 0))
    for i in range(2 * n):
        t = maybe(when())
        clicks.append((maybe(i // 2), t, maybe(late(t)), client(), maybe(rnd.choice(["purchase", "view"])), maybe(rnd.choice([1.005, -2.5])), maybe("{}"), "c"))
        clicks += clicks[-1:] * rnd.choice([0, 0, 1])
    for _ in range(4 * n):
        day = start + datetime.timedelta(days=rnd.randrange(45))
        lines.append((maybe(3 if rnd.random() < 0.3 else rnd.randrange(n + 5)), rnd.randrange(3), maybe(0 if rnd.random() < 0.3 else rnd.randrange(8)), 1, 1, maybe(rnd.choice([2.45, 7.0])), 0.0, None, maybe(day), "k"))
        lines += lines[-1:] * rnd.choice([0, 0, 1])
    return sales, clicks, lines


def compared(spark, tmp_path, rows, policy):
    frames = [spark.createDataFrame(r, s) for r, s in zip(rows, (SALES, CLICKS, LINES), strict=True)]
    con = duckdb.connect()
    for frame, name in zip(frames, ("sales", "clicks", "sale_lines"), strict=True):
        frame.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    found = features.op12_feature_table(*frames, policy)
    found.write.parquet(f"{tmp_path}/found")
    names = ", ".join(found.columns)
    want = con.execute(f"SELECT {names} FROM ({SQL['op12_feature_table']}) ORDER BY {ORDER}").fetchall()
    return want, con.execute(f"SELECT {names} FROM read_parquet('{tmp_path}/found/*.parquet') ORDER BY {ORDER}").fetchall()


@pytest.mark.parametrize(("seed", "n", "shard"), [(1, 60, 5), (2, 150, 20), (3, 40, 100_000)])
def test_features_are_those_of_the_sql(spark, tmp_path, seed, n, shard):
    want, got = compared(spark, tmp_path, tables(seed, n), features.FeaturePolicy(shard_rows=shard, chunk_rows=40))
    assert len(want) > n and got == want


def test_empty_tables(spark, tmp_path):
    sales = [(1, 1, None, 1.0, datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 1), None, None, None)]
    want, got = compared(spark, tmp_path, (sales, [], []), features.FeaturePolicy())
    assert got == want and len(got) == 2
    none = [spark.createDataFrame([], s) for s in (SALES, CLICKS, LINES)]
    assert features.op12_feature_table(*none).count() == 0


def test_a_busy_minute_cuts_only_the_time_around_it(spark):
    minute, start = features.MINUTE, 28_000_000 * features.MINUTE
    rows = [(1, start + i * 7 * minute) for i in range(2000)] + [(1, start + 3500 * minute)] * 300 + [(2, start)] * 3
    events = spark.createDataFrame(rows, "client long, known long")
    spans = features.client_spans(events, features.FeaturePolicy(shard_rows=50))
    cells = features.in_cells(events, spans, "known").groupBy("client", "cell").count().collect()
    busy = [x["count"] for x in cells if x["client"] == 1]
    assert len(busy) < 400 and sum(busy) == 2300 and sorted(busy)[-2] <= 50  # cut by the busy minute throughout: 2000
    assert [(x["cell"], x["count"]) for x in cells if x["client"] == 2] == [(0, 3)]
