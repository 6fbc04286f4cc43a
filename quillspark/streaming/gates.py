"""Stages and gates as a stream: the state of every workspace, kept from event to event, and a notice when one falls silent."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.shared import delete, new_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SCHEMA = "ws long, stage long, gate string, since long"
_STATE = {"approve": "approved", "reject": "rejected"}


def _micros(ts: pd.Timestamp) -> int:
    return int(ts.value) // 1000


class _Gates(StatefulProcessor):
    """Per workspace: the last decision on each stage's gate, the last reset to each stage, and the time of the last event.

    All three are maxima over (time, event_id), so the state after a set of events doesn't depend on their order or batches.
    """

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.decisions = handle.getMapState("decisions", "stage long", "ts long, event_id long, kind string")
        self.resets = handle.getMapState("resets", "stage long", "ts long, event_id long")
        self.last = handle.getValueState("last", "ts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (ws,) = key
        decisions = {k[0]: tuple(v) for k, v in self.decisions.iterator()}
        resets = {k[0]: tuple(v) for k, v in self.resets.iterator()}
        before = _states(decisions, resets)
        last = was = tuple(self.last.get()) if self.last.exists() else None
        for batch in rows:
            for stage, kind, ts, event in zip(batch["stage"], batch["kind"], batch["ts"], batch["event_id"], strict=True):
                at = (_micros(ts), int(event))
                last = max(last or at, at)
                if kind == "reset":
                    resets[int(stage)] = max(resets.get(int(stage), at), at)
                elif kind in ("open", "approve", "reject"):
                    decisions[int(stage)] = max(decisions.get(int(stage), (*at, kind)), (*at, kind))
        for stage, value in decisions.items():
            self.decisions.updateValue((stage,), value)
        for stage, value in resets.items():
            self.resets.updateValue((stage,), value)
        if last != was and last is not None:
            self.last.update(last)
            if self.silence_ms:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer[0] if isinstance(timer, (tuple, list)) else timer)
                self.handle.registerTimer(last[0] // 1000 + self.silence_ms)
        changed = {s: x for s, x in _states(decisions, resets).items() if before.get(s) != x}
        if changed:
            yield pd.DataFrame([(ws, s, *x) for s, x in sorted(changed.items())], columns=["ws", "stage", "gate", "since"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        yield pd.DataFrame({"ws": [key[0]], "stage": pd.array([None], "Int64"), "gate": ["silent"], "since": [last[1]]})


def _states(decisions: dict[int, tuple], resets: dict[int, tuple]) -> dict[int, tuple[str, int]]:
    """gate, since of each stage: a later reset to it, or to a stage before, takes its decision back."""
    return {s: ("pending" if any(r <= s and at > (ts, event) for r, at in resets.items()) else _STATE.get(kind, "pending"), event) for s, (ts, event, kind) in decisions.items()}


def gate_changes(events: DataFrame, silence: datetime.timedelta | None = None, late: str = "10 minutes") -> DataFrame:
    """ws, stage, gate, since (update mode) of a stream of a log (ws, stage, kind, ts, event_id): each gate whose state an event changed; the last row of a gate is its state.

    With `silence` a workspace without events for as long gives a row of gate `silent` without stage, once the watermark (`late` behind the newest event) has passed
    that time; the next event takes it back. Events behind the watermark are dropped then. Without, no event is dropped and all states are kept, a row for each gate.
    The session must have the RocksDB state store (see `rocksdb`).
    """
    rows = events.select("ws", "stage", "kind", "ts", "event_id")
    if silence is not None:
        rows = rows.withWatermark("ts", late)
    ms = int(silence.total_seconds() * 1000) if silence is not None else 0
    return rows.groupBy("ws").transformWithStateInPandas(_Gates(ms), _SCHEMA, "Update", "EventTime" if ms else "None")


def rocksdb(spark: SparkSession) -> None:
    """Streams of this session keep their state in RocksDB, which states of several variables need."""
    spark.conf.set(_PROVIDER, _ROCKS)


def replayed(spark: SparkSession, events: DataFrame, checkpoint: str, out: str, **options) -> DataFrame:
    """ws, stage, gate, since after all events that a stream has now: run to its end, from where `checkpoint` left off, with the changes in a table at `out`.

    Each micro-batch is a folder of its own, written whole again if it is repeated. Rows of silence are left out.
    """
    rocksdb(spark)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    query = gate_changes(events, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(f"{_SCHEMA}, batch long").parquet(out)
    last = changes.where("stage is not null").groupBy("ws", "stage").agg(F.max_by(F.struct("gate", "since"), "batch").alias("s"))
    return last.select("ws", "stage", "s.gate", "s.since")


def final_states(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The states after a whole stream, with its checkpoint and changes in the shared folder."""
    checkpoint = new_path(spark, "gate-checkpoint")
    states = replayed(spark, events, checkpoint, new_path(spark, "gate-changes"))
    delete(spark, checkpoint)
    return states
