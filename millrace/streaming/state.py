"""Keyed state over streams: the activation of a conversation, and reminders that fire once."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def warm_and_step(scores: dict[str, float], amounts: dict[str, float], decay: float, floor: float) -> dict[str, float]:
    """One step of a field: add, fade, forget."""
    summed = dict(scores)
    for key, amount in amounts.items():
        summed[key] = summed.get(key, 0.0) + amount
    return {k: v * decay for k, v in summed.items() if v * decay > floor}


def activation_stream(turns: DataFrame, decay: float = 0.8, floor: float = 1e-3) -> DataFrame:
    """turns: conv_id, turn, key, amount (a stream). conv_id, turn, key, score after each turn that arrives, hottest
    first; turns of one batch are taken in their order."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scores = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(frames))
        out = []
        for turn, group in rows.sort_values("turn").groupby("turn"):
            scores = warm_and_step(scores, group.groupby("key")["amount"].sum().to_dict(), decay, floor)
            out += [(key[0], int(turn), k, v) for k, v in sorted(scores.items(), key=lambda x: (-x[1], x[0]))]
        state.update((json.dumps(scores),))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "key", "score"])

    return turns.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, turn long, key string, score double", "scores string", "append", GroupStateTimeout.NoTimeout)


def fire_reminders(commands: DataFrame) -> DataFrame:
    """commands: user_id, at, task, due (a stream, in which every row also tells the time). user_id, task, due of each
    reminder once, with the first row of its user that comes at or after it."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values("at")
        fired = []
        for row in rows.itertuples():
            if row.task is not None and not pd.isna(row.due):
                kept.append([row.task, pd.Timestamp(row.due).isoformat()])
            now = pd.Timestamp(row.at)
            fired += [(key[0], t, pd.Timestamp(d)) for t, d in kept if pd.Timestamp(d) <= now]
            kept = [x for x in kept if pd.Timestamp(x[1]) > now]
        state.update((json.dumps(kept),))
        yield pd.DataFrame(fired, columns=["user_id", "task", "due"])

    return commands.groupBy("user_id").applyInPandasWithState(update, "user_id long, task string, due timestamp", "kept string", "append", GroupStateTimeout.NoTimeout)


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    return spark.readStream.text(path).select(F.col("value").alias("text"))


def notify(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Hands each batch to all sinks; a sink that fails doesn't keep the others from it, and its error is kept."""
    errors: list[Exception] = []

    def send(batch: DataFrame, number: int) -> None:
        for sink in sinks:
            try:
                sink(batch, number)
            except Exception as error:  # noqa: BLE001  each channel is on its own
                errors.append(error)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start(), errors
