"""Point-in-time features: what was known of a client at the moment of an ask, without anything learnt later.

An ask is (ask_id, client_id, at_us). For each window of d days it gets what lay in (at - d, at] and had arrived `delay`
before: clicks, sales, and the lines of these sales shipped by then. Every row counts from when it is known (the later of
its time and its arrival plus the delay; a line when its sale is known and it has shipped) until it expires (its time, for
a line its sale's, plus d). So a feature is a difference of two running sums: of the rows known by `at` and of those
expired by `at`. Each table of sums is probed by a DuckDB ASOF join inside mapInArrow.

The work is dealt by shards of a client's time. A client with few rows is one shard. One with more is cut into spans of
time, and each of these again into sixteen, down to a minute, as long as it holds more than `shard_rows`: a busy minute
cuts what is around it, not the client's other time. What the spans before have summed up to stands first in each shard
as a carried row. No row, sum or ask of a hot client so meets the others in one
task, only one row for each of its spans does, when these are summed up. Lines that a client has at one instant are
summed before they are dealt.

Distinct items don't add up, so each item's times are first cut into disjoint segments: in the order in which lines are
known, a line adds what lies between the latest expiry before it and its own. Of the segments at most one holds a given
moment, so counting segments counts items. This is done by client, item and span of time, with the latest expiry of the
spans before carried.

The last click is the running maximum of (time, id) over the known rows; where that has left the window, so have all
others. The label is a count as well: a sale in (at, at + label_days] is known from its time less label_days, and expires
at its time.

Rows: asks without client or time get no result; asks that repeat get one each. Clicks that are equal in all columns count
once; those without client, time or arrival, and sales likewise, are never known (such sales still count for the label if
they have client and time). Clicks without id are counted but never the last. Lines without sale or time of shipping are never
known; those without item count as lines only; repeats count as often as they stand there. Amounts that are null or not
numbers are 0 cents. Columns besides those named are only looked at to tell clicks apart. Empty tables give zeros, or no
rows where there are no asks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.workers import give_back
from millrace.runtime import settle

MINUTE = 60_000_000
#: Spans are 2 to one of these powers minutes long; what is cut at first is a client's whole time.
LEVELS = (20, 16, 12, 8, 4, 0)
DAY = 86_400_000_000


@dataclass(frozen=True)
class FeaturePolicy:
    windows: tuple[int, ...] = (2, 14)
    delay_minutes: int = 240
    label_days: int = 7
    #: most rows of one client's span, if it is longer than a minute; a smaller part of a small input
    shard_rows: int = 50_000
    #: rows that a worker hands to DuckDB at once, at least one shard
    chunk_rows: int = 200_000


COUNTED = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents")
#: those that are summed for each window by itself
LINES = ("n_lines", "n_items", "line_cents")


def micros(df: DataFrame, name: str) -> Column:
    """A time column as microseconds since 1970, whatever the session's zone."""
    column = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(column)


def cents(name: str) -> Column:
    """An amount in whole cents, halves up; 0 for null and for what is no number."""
    return F.coalesce(F.floor(F.col(f"`{name}`").cast("double") * 100 + 0.5).try_cast("long"), F.lit(0).cast("long"))


def distinct_clicks(clicks: DataFrame, delay: int) -> DataFrame:
    """client, ts, known, purchase, cents, click_id of the clicks that can be known; rows that are equal throughout are one."""
    own = ("client_id", "ts", "arrived_at", "kind", "value", "click_id")
    rest = []
    for i, field in enumerate(f for f in clicks.schema.fields if f.name not in own):
        column = F.col(f"`{field.name}`")
        rest.append((F.sha2(column, 256) if field.dataType.typeName() in ("string", "binary") else column).alias(f"rest{i}"))
    told = clicks.where("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL").select(
        F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("arrived"), "kind", "value", F.col("click_id").cast("long").alias("click_id"), *rest
    ).distinct()
    return told.select(
        "client", "ts", F.greatest("ts", F.col("arrived") + delay).alias("known"), F.coalesce(F.col("kind") == "purchase", F.lit(False)).cast("long").alias("purchase"), cents("value").alias("cents"), "click_id"
    )


#: Parts that the rows of a client are dealt by where they meet what is told of the client.
SALTS = 64


def with_client(df: DataFrame, told: DataFrame, at: str) -> DataFrame:
    """df with what is told of its clients, null where nothing is; a hot client's rows meet it in many parts."""
    spread = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(F.xxhash64(at), F.lit(SALTS)).cast("int")).join(spread, ["client", "salt"], "left").drop("salt")


def client_spans(events: DataFrame, policy: FeaturePolicy) -> DataFrame:
    """events: client, known. Returns (client, level, span): the spans with more rows than a shard takes, which are cut into those
    of the next level; level 0 is the client's whole time. There are at most as many of a level as shards."""
    spark = events.sparkSession
    counts = settle(events.groupBy("client").agg(F.count("*").alias("n")), "client-rows")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = min(policy.shard_rows, max(500, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    heavy = counts.where(F.col("n") > most).select("client", F.lit(True).alias("heavy"))
    minute = F.when(F.col("heavy"), F.floor(F.col("known") / MINUTE))
    minutes = with_client(events, heavy, "known").groupBy("client", minute.alias("m")).agg(F.count("*").alias("n"), F.max("heavy").alias("heavy")).where("heavy")
    cut = [F.expr(f"shiftright(m, {x})").alias(f"m{x}") for x in LEVELS[:-1]]
    rolled = minutes.rollup("client", *cut).agg(F.sum("n").alias("n"), F.grouping_id().alias("left_out"))
    level = len(cut) - F.log2(F.col("left_out") + 1).cast("int")
    span = F.coalesce(*(F.col(f"m{x}") for x in reversed(LEVELS[:-1])), F.lit(0))
    return settle(rolled.where(F.col("client").isNotNull() & (F.col("n") > most)).select("client", level.alias("level"), span.alias("span")), "client-spans")


def in_cells(df: DataFrame, spans: DataFrame, at: str) -> DataFrame:
    """df with whether its client is split (null if not) and the first minute of the span that `at` lies in, then 0."""
    minute = F.floor(F.col(at) / MINUTE)
    whole = spans.where("level = 0").select(F.col("client").alias("c0"), F.lit(True).alias("split"))
    out = df.join(F.broadcast(whole), F.col("client") == F.col("c0"), "left")
    cell, last = F.when(F.col("split"), F.expr(f"shiftleft(shiftright(minute, {LEVELS[0]}), {LEVELS[0]})")), "split"
    out = out.withColumn("minute", minute)
    for i, (bits, finer) in enumerate(zip(LEVELS, LEVELS[1:], strict=False), 1):
        held = spans.where(f"level = {i}").select(F.col("client").alias(f"c{i}"), F.col("span").alias(f"s{i}"), F.lit(True).alias(f"cut{i}"))
        out = out.join(F.broadcast(held), (F.col("client") == F.col(f"c{i}")) & (F.when(F.col(last), F.expr(f"shiftright(minute, {bits})")) == F.col(f"s{i}")), "left")
        cell, last = F.when(F.col(f"cut{i}"), F.expr(f"shiftleft(shiftright(minute, {finer}), {finer})")).otherwise(cell), f"cut{i}"
    return out.select(*df.columns, "split", F.coalesce(cell, F.lit(0).cast("long")).alias("cell"))


def before(keys: list[str], value: Column, order: str) -> Column:
    """value, an aggregate, over the rows of the keys that stand before."""
    return value.over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def summed(names: list[str]) -> list[Column]:
    return [F.sum(x).alias(x) for x in names]


def line_events(sold: DataFrame, spans: DataFrame, windows: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """sold: client, item, known, sold, cents of lines whose sale is known. Returns what becomes known, by (client, at), and
    what ends, by (client, sold): for each window its lines, items and cents."""
    zero, measures = F.lit(0).cast("long"), [f"{m}_{d}" for d in windows for m in LINES]
    fit = lambda d: F.col("known") < F.col("sold") + d * DAY
    own = [x for d in windows for x in (fit(d).cast("long").alias(f"n_lines_{d}"), F.when(fit(d), F.col("cents")).otherwise(zero).alias(f"line_cents_{d}"))]
    added = [f"{m}_{d}" for d in windows for m in ("n_lines", "line_cents")]
    held = in_cells(sold.select("client", "item", "known", "sold", *own), spans, "known").groupBy("client", "item", "cell", "known").agg(F.max("sold").alias("sold"), F.max("split").alias("split"), *summed(added))
    held = settle(held, "lines-by-item")
    latest = held.where("item IS NOT NULL AND split").groupBy("client", "item", "cell").agg(F.max("sold").alias("latest"))
    carried = settle(latest.select("client", "item", "cell", before(["client", "item"], F.max("latest"), "cell").alias("carried")).where("carried IS NOT NULL"), "latest-sold")
    ordered = held.join(carried, ["client", "item", "cell"], "left").withColumn("earlier", F.greatest(before(["client", "item", "cell"], F.max("sold"), "known"), "carried"))
    start = {d: F.greatest("known", F.col("earlier") + d * DAY) for d in windows}
    ordered = settle(ordered.select("client", "known", "sold", *added, *[F.when(F.col("item").isNotNull() & (start[d] < F.col("sold") + d * DAY), start[d]).alias(f"start_{d}") for d in windows]), "item-segments")

    at_once = {f"n_items_{d}": F.coalesce((F.col(f"start_{d}") == F.col("known")).cast("long"), zero) for d in windows}
    known = [ordered.select("client", F.col("known").alias("us"), *[at_once.get(m, F.col(m)).alias(m) for m in measures])]
    known += [ordered.where(F.col(f"start_{d}") > F.col("known")).select("client", F.col(f"start_{d}").alias("us"), *[F.lit(int(m == f"n_items_{d}")).cast("long").alias(m) for m in measures]) for d in windows]
    ends = [
        sold.select("client", "sold", *own, *[zero.alias(f"n_items_{d}") for d in windows]).select("client", "sold", *measures),
        ordered.select("client", "sold", *[(F.col(f"start_{m.rpartition('_')[2]}").isNotNull().cast("long") if m.startswith("n_items") else zero).alias(m) for m in measures]),
    ]
    return union(known).groupBy("client", "us").agg(*summed(measures)), settle(union(ends).groupBy("client", "sold").agg(*summed(measures)), "line-ends")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def probe(windows: tuple[int, ...], chunk_rows: int):  # noqa: ANN201
    """The mapInArrow function: rows sorted by client and cell, dealt so that a shard lies in one partition."""
    measures = ["n_next", *COUNTED]
    known = ", ".join([f"CAST(sum({m}) OVER w AS BIGINT) AS {m}" for m in measures] + [f"CAST(sum({m}_{d}) OVER w AS BIGINT) AS {m}_{d}" for d in windows for m in LINES])
    top = "18446744073709551616::HUGEINT"
    parts = [f"known AS (SELECT client, cell, us, {known}, max(last_ts::HUGEINT * {top} + last_id::HUGEINT + 9223372036854775808::HUGEINT) OVER w AS last FROM r WHERE side = 0 WINDOW w AS (PARTITION BY client, cell ORDER BY us RANGE UNBOUNDED PRECEDING))"]
    for i, d in enumerate(windows, 1):
        gone = ", ".join([f"CAST(sum({m}) OVER w AS BIGINT) AS {m}" for m in COUNTED] + [f"CAST(sum({m}_{d}) OVER w AS BIGINT) AS {m}_{d}" for m in LINES])
        parts.append(f"gone{i} AS (SELECT client, cell, us, {gone} FROM r WHERE side = {i} WINDOW w AS (PARTITION BY client, cell ORDER BY us RANGE UNBOUNDED PRECEDING))")
    selects = []
    for i, d in enumerate(windows, 1):
        features = [f"coalesce(k.{m}, 0) - coalesce(g.{m}, 0) AS {m}" for m in COUNTED] + [f"coalesce(k.{m}_{d}, 0) - coalesce(g.{m}_{d}, 0) AS {m}" for m in LINES]
        last = f"CASE WHEN k.last >= (q.us - {d * DAY} + 1)::HUGEINT * {top} THEN CAST(((k.last % {top}) + {top}) % {top} - 9223372036854775808::HUGEINT AS BIGINT) END AS last_click_id"
        selects.append(
            f"SELECT q.ask_id, {d} AS d, q.us AS t_us, coalesce(k.n_next, 0) > 0 AS label, {', '.join(features)}, {last} FROM q "
            "ASOF LEFT JOIN known k ON q.client = k.client AND q.cell = k.cell AND q.us >= k.us "
            f"ASOF LEFT JOIN gone{i} g ON q.client = g.client AND q.cell = g.cell AND q.us >= g.us"
        )
    sql = f"WITH q AS (SELECT client, cell, us, ask_id FROM r WHERE side = {len(windows) + 1}), {', '.join(parts)} {' UNION ALL '.join(selects)}"
    names = ["ask_id", "d", "t_us", "label", *COUNTED, *LINES, "last_click_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        import numpy as np

        con = duckdb.connect()
        con.execute("SET threads = 1")
        con.execute("SET temp_directory = ''")

        def answers(table: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("r", table)
            found = con.execute(sql).to_arrow_table().select(names)
            con.unregister("r")
            yield from found.cast(pa.schema([("ask_id", pa.int64()), ("d", pa.int32()), ("t_us", pa.int64()), ("label", pa.bool_()), *[(x, pa.int64()) for x in names[4:]]])).to_batches(max_chunksize=20_000)

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk_rows:
                continue
            table = pa.Table.from_batches(held)
            client, cell = (table.column(x).to_numpy() for x in ("client", "cell"))
            edges = np.flatnonzero((client[1:] != client[:-1]) | (cell[1:] != cell[:-1]))
            if len(edges):
                cut = int(edges[-1]) + 1
                yield from answers(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
        if rows:
            yield from answers(pa.Table.from_batches(held))
        con.close()
        give_back()

    return run


def feature_table(asks: DataFrame, sales: DataFrame, clicks: DataFrame, lines: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """asks: ask_id, client_id (integers), at_us. Returns a row per ask and window: ask_id, d, t_us, label, the features."""
    delay, windows = policy.delay_minutes * MINUTE, policy.windows
    bought = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL").select(
        F.col("client_id").cast("long").alias("client"), "sale_id", micros(sales, "sold_at").alias("sold"), (micros(sales, "arrived_at") + delay).alias("arrived"), cents("total").alias("cents")
    )
    seen = bought.where("arrived IS NOT NULL").withColumn("known", F.greatest("sold", "arrived"))
    clicked = settle(distinct_clicks(clicks, delay), "distinct-clicks")
    shipped = lines.where("sale_id IS NOT NULL AND shipped_at IS NOT NULL").select("sale_id", F.col("item_id").alias("item"), cents("amount").alias("cents"), micros(lines, "shipped_at").alias("shipped"))
    sold = shipped.join(seen.select("sale_id", "client", "sold", F.col("known").alias("sale_known")), "sale_id").select("client", "item", "sold", F.greatest("sale_known", "shipped").alias("known"), "cents")
    sold = settle(sold.where(F.col("known") < F.col("sold") + max(windows) * DAY), "lines-of-sales")
    spans = client_spans(clicked.select("client", "known").unionByName(seen.select("client", "known")).unionByName(sold.select("client", "known")), policy)

    asked = asks.where("client_id IS NOT NULL AND at_us IS NOT NULL").select(F.col("client_id").cast("long").alias("client"), F.col("at_us").alias("us"), F.col("ask_id").cast("long").alias("ask_id"))
    events = settle(in_cells(union(sides(clicked, bought, seen, asked, *line_events(sold, spans, windows), policy)), spans, "us"), "shard-rows")
    rows = events.drop("split").unionByName(carried_rows(events, len(windows)))
    kinds = "ask_id long, d int, t_us long, label boolean, " + ", ".join(f"{x} long" for x in (*COUNTED, *LINES, "last_click_id"))
    return rows.repartition("client", "cell").sortWithinPartitions("client", "cell").mapInArrow(probe(windows, policy.chunk_rows), kinds)


def sides(clicked: DataFrame, bought: DataFrame, seen: DataFrame, asked: DataFrame, known_lines: DataFrame, line_ends: DataFrame, policy: FeaturePolicy) -> list[DataFrame]:
    """All rows that meet: side 0 what becomes known, 1 to n what expires from each window, n + 1 the asks."""
    label, windows = policy.label_days * DAY, policy.windows
    zero, nothing, one = F.lit(0), F.lit(None), F.lit(1)
    measures = measure_names(windows)

    def side(df: DataFrame, number: int, at: Column, **values: Column) -> DataFrame:
        return df.select(
            "client", F.lit(number).alias("side"), at.alias("us"), *[values.get(m, zero).cast("long").alias(m) for m in measures], *[values.get(x, nothing).cast("long").alias(x) for x in ("last_ts", "last_id", "ask_id")]
        )

    click = {"n_clicks": one, "n_purchases": F.col("purchase"), "click_cents": F.col("cents")}
    sale = {"n_sales": one, "sale_cents": F.col("cents")}
    has_id = F.col("click_id").isNotNull()
    parts = [
        side(clicked, 0, F.col("known"), **click, last_ts=F.when(has_id, F.col("ts")), last_id=F.col("click_id")),
        side(seen, 0, F.col("known"), **sale),
        side(bought, 0, F.col("sold") - label, n_next=one),
        side(bought, 0, F.col("sold"), n_next=F.lit(-1)),
        side(known_lines, 0, F.col("us"), **{f"{m}_{d}": F.col(f"{m}_{d}") for d in windows for m in LINES}),
        side(asked, len(windows) + 1, F.col("us"), ask_id=F.col("ask_id")),
    ]
    for i, d in enumerate(windows, 1):
        parts.append(side(clicked, i, F.greatest("known", F.col("ts") + d * DAY), **click))
        parts.append(side(seen, i, F.greatest("known", F.col("sold") + d * DAY), **sale))
        parts.append(side(line_ends, i, F.col("sold") + d * DAY, **{f"{m}_{d}": F.col(f"{m}_{d}") for m in LINES}))
    return parts


def measure_names(windows: tuple[int, ...]) -> list[str]:
    return ["n_next", *COUNTED, *[f"{m}_{d}" for d in windows for m in LINES]]


def carried_rows(events: DataFrame, n_windows: int) -> DataFrame:
    """For each span of a split client that is asked about, and each side, what the spans before have summed up to, as a row
    at the span's start."""
    measures = [x for x in events.columns if x not in ("client", "cell", "split", "side", "us", "last_ts", "last_id", "ask_id")]
    last = F.max(F.when(F.col("last_id").isNotNull(), F.struct("last_ts", "last_id"))).alias("last")
    sums = settle(events.where("split").groupBy("client", "cell", "side").agg(*summed(measures), last), "span-sums")
    asked = sums.where(F.col("side") > n_windows).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(n_windows))))
    both = sums.where(F.col("side") <= n_windows).withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    cells = both.groupBy("client", "cell", "side").agg(*summed(measures), F.max("last").alias("last"), F.max("asked").alias("asked"))
    keys = ["client", "side"]
    carried = cells.select("client", "cell", "side", "asked", *[before(keys, F.sum(m), "cell").alias(m) for m in measures], before(keys, F.max("last"), "cell").alias("last"))
    return carried.where(F.col("asked") & F.col("n_next").isNotNull()).select(
        "client", "cell", "side", (F.col("cell") * MINUTE).alias("us"), *measures, "last.last_ts", "last.last_id", F.lit(None).cast("long").alias("ask_id")
    )


def op12_feature_table(sales: DataFrame, clicks: DataFrame, lines: DataFrame, policy: FeaturePolicy = FeaturePolicy()) -> DataFrame:
    """The contract's rows: each sale with an id, a client and a time asks at its time plus up to three days, by its id's crc32."""
    after = F.expr("crc32(CAST(CAST(sale_id AS STRING) AS BINARY))") % 259_200 * 1_000_000
    asks = sales.where("client_id IS NOT NULL AND sold_at IS NOT NULL AND sale_id IS NOT NULL").select(F.col("sale_id").alias("ask_id"), "client_id", (micros(sales, "sold_at") + after).alias("at_us"))
    return feature_table(asks, sales, clicks, lines, policy).withColumnRenamed("ask_id", "sale_id")
