"""A conversation's turns as a stateful stream.

What a line asks, which node it means and which others it might mean is found before, by joins over the batch (see
plans.questions and operators.resolve). The stream keeps for each conversation what only its past can tell: what is warm,
which question waits for a choice, which task for a time, and which tasks fall due. A task fires by a timer of event time,
when the watermark passes it, whether or not its conversation goes on. State lies in RocksDB, in parts by name, so a turn
reads and writes only the entries that it touches; it survives a restart from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import strings

CANDIDATE = "struct<node: string, keys: array<string>>"
TURN = f"conv_id string, at timestamp, text string, keys array<string>, asks boolean, answer string, quality double, node {CANDIDATE}, rivals array<{CANDIDATE}>, task string, due timestamp"
ANSWER = "conv_id string, at timestamp, kind string, text string, node string, assurance double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class TurnPolicy:
    #: below it a question with rivals is asked back
    sure: float = 0.5
    #: what a turn leaves of the warmth before it, and what is forgotten
    decay: float = 0.8
    floor: float = 1e-3
    #: warmth of a node that was chosen, and of one that was answered about
    chosen: float = 2.0
    answered: float = 0.7
    #: how late a line may come
    lateness: str = "10 seconds"


def word_keys(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(strings.WORD), F.lit(0)), strings.loose_key)))


def candidate(node: Column) -> Column:
    return F.when(node.isNotNull(), F.struct(node.alias("node"), word_keys(node).alias("keys")))


def prepared(lines: DataFrame) -> DataFrame:
    """lines: conv_id, at, text and, where they are known, answer, quality, node, rivals (array of nodes), task, due. The rows that
    `turns` takes; rows without conversation or time are left out."""
    kinds = {"answer": "string", "quality": "double", "node": "string", "rivals": "array<string>", "task": "string", "due": "timestamp"}
    for name, kind in kinds.items():
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    rivals = F.transform(F.coalesce("rivals", F.array().cast("array<string>")), candidate)
    return lines.where("conv_id IS NOT NULL AND at IS NOT NULL").select(
        F.col("conv_id").cast("string").alias("conv_id"), "at", "text", word_keys(F.col("text")).alias("keys"), F.coalesce(F.col("text").contains("?"), F.lit(False)).alias("asks"), "answer",
        F.coalesce("quality", F.lit(0.0)).alias("quality"), candidate(F.col("node")).alias("node"), rivals.alias("rivals"), "task", "due",
    )


class Turns(StatefulProcessor):
    """One conversation. A line that names one of the waiting candidates resumes the question that waits for them; a question that
    isn't sure of its node among rivals is asked back; a task without a time waits for the next line that tells one."""

    def __init__(self, policy: TurnPolicy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "held string")
        self.waiting = handle.getValueState("waiting", "task string")
        self.warmth = handle.getMapState("warmth", "node string", "score double")
        self.tasks = handle.getMapState("tasks", "task string", "due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(rows)).sort_values(["at", "text"], kind="stable")
        out = [answer for line in lines.itertuples(index=False) for answer in self.turn(key[0], line)]
        yield frame(out)

    def turn(self, conversation: str, line: Any) -> list[tuple]:
        told = lambda kind, text, node=None, sure=1.0: [(conversation, line.at, kind, text, node, float(sure))]
        due = None if pd.isna(line.due) else int(pd.Timestamp(line.due).timestamp() * 1000)
        chosen = self.choice(set(line.keys))
        if chosen is not None:
            held = json.loads(self.pending.get()[0])
            self.pending.clear()
            self.fade({chosen: self.policy.chosen})
            return told("resume", held["question"], chosen)
        task = line.task
        if not line.asks and due is not None and task is None and self.waiting.exists():
            task = self.waiting.get()[0]
        if not line.asks and task is not None:
            if due is None:
                self.waiting.update((task,))
                self.fade({})
                return told("when", task)
            if self.waiting.exists():
                self.waiting.clear()
            if self.tasks.containsKey((task,)):
                self.handle.deleteTimer(self.tasks.getValue((task,))[0])  # moved: others at that time are registered again
                self.tasks.removeKey((task,))
                for (_,), (other,) in list(self.tasks.iterator()):
                    self.handle.registerTimer(other)
            self.tasks.updateValue((task,), (due,))
            self.handle.registerTimer(due)
            self.fade({})
            return told("set", task)
        if not line.asks:
            self.fade({})
            return told("heard", line.text)
        node = line.node["node"] if line.node is not None else None
        rivals = [dict(x) for x in line.rivals if x is not None]
        glow = self.warmth.getValue((node,))[0] if node is not None and self.warmth.containsKey((node,)) else 0.0
        sure = min(1.0, max(0.0, line.quality / (1 + len(rivals)) + 0.3 * min(1.0, max(0.0, glow))))
        if rivals and node is not None and sure < self.policy.sure:
            options = [{"node": x["node"], "keys": list(x["keys"])} for x in (line.node, *rivals)]
            self.pending.update((json.dumps({"question": line.text, "options": options}),))
            self.fade({})
            return told("clarify", ", ".join(x["node"] for x in options), node, sure)
        if line.answer is None:
            self.fade({})
            return told("miss", line.text, node, sure)
        self.fade({node: self.policy.answered} if node is not None else {})
        return told("answer", line.answer, node, sure)

    def choice(self, keys: set[str]) -> str | None:
        """The waiting candidate that all of the line's words name, if there is one and no other."""
        if not keys or not self.pending.exists():
            return None
        fit = [x["node"] for x in json.loads(self.pending.get()[0])["options"] if keys <= set(x["keys"])]
        return fit[0] if len(fit) == 1 else None

    def fade(self, amounts: dict[str, float]) -> None:
        """One step of the field: add, fade, forget."""
        scores = {k: v for (k,), (v,) in list(self.warmth.iterator())}
        for node in scores.keys() | amounts.keys():
            score = (scores.get(node, 0.0) + amounts.get(node, 0.0)) * self.policy.decay
            if score > self.policy.floor:
                self.warmth.updateValue((node,), (score,))
            elif node in scores:
                self.warmth.removeKey((node,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        fired = sorted((due, task) for (task,), (due,) in list(self.tasks.iterator()) if due <= now)
        for _, task in fired:
            self.tasks.removeKey((task,))
        yield frame([(key[0], pd.Timestamp(due, unit="ms"), "due", task, None, 1.0) for due, task in fired])

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "at", "kind", "text", "node", "assurance"])
    out["at"] = pd.to_datetime(out["at"]).astype("datetime64[us]")
    return out.astype({"assurance": float})


def stateful(spark: SparkSession) -> None:
    """The session's setting for the state of new streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def turns(lines: DataFrame, policy: TurnPolicy = TurnPolicy()) -> DataFrame:
    """lines: as `prepared` makes them, a stream. A row for each turn (kind answer, clarify, resume, when, set, heard or miss) and for
    each task that falls due. A conversation's lines of one batch are taken in the order of their times, then texts."""
    return lines.withWatermark("at", policy.lateness).groupBy("conv_id").transformWithStateInPandas(Turns(policy), ANSWER, "Append", "EventTime")
