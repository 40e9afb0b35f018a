"""Ending runs that no longer improve, as a stream with keyed state and event-time timers.

Rows wait in the state of their run until the watermark has passed them and are then taken in order of
time and id, so the result does not depend on how files were split into batches or on a restart between
them. Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = "key long, reason string, ended_ms long, steps long, best double, best_id long"


@dataclass(frozen=True)
class Rule:
    """When a run ends: *patience* steps without a lower value, or more than *idle_ms* without a row."""

    patience: int = 10
    idle_ms: int = 3_600_000

    def __post_init__(self):
        if self.patience < 1 or self.idle_ms < 1:
            raise ValueError("patience and idle_ms are at least 1")


@dataclass
class Progress:
    """What is known of a run after its rows so far."""

    steps: int = 0
    since: int = 0
    last_ms: int = -1
    best: float | None = None
    best_id: int | None = None
    ended: bool = False
    #: Time of the earliest waiting row, so that the others need not be read to find it; -1 for none.
    first: int = -1

    def take(self, at: int, row_id: int, value: float | None, rule: Rule) -> str | None:
        """Count one row; the reason if the run ends, before it for a silent run and with it for a stalled one."""
        if self.steps and at // 1000 - self.last_ms > rule.idle_ms:
            return "silent"
        self.steps, self.last_ms = self.steps + 1, at // 1000
        if value is not None and (self.best is None or value < self.best):
            self.best, self.best_id, self.since = value, row_id, 0
        else:
            self.since += 1
        return "stalled" if self.since >= rule.patience else None


class Controller(StatefulProcessor):
    """State of a run: its progress, the rows the watermark has not passed, and its one timer."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "steps long, since long, last_ms long, best double, best_id long, ended boolean, first long")
        self.waiting = handle.getListState("waiting", "at long, id long, value double")

    def _known(self) -> Progress:
        return Progress(*self.progress.get()) if self.progress.exists() else Progress()

    def _keep(self, known: Progress) -> None:
        self.progress.update((known.steps, known.since, known.last_ms, known.best, known.best_id, known.ended, known.first))

    def _wake(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self._known()
        for batch in rows:
            if not known.ended:
                plain = batch[["at", "id", "value"]].astype(object)
                self.waiting.appendList(list(plain.where(plain.notna(), None).itertuples(index=False, name=None)))
                least = int(batch["at"].min())
                known.first = least if known.first < 0 else min(known.first, least)
        if not known.ended:
            self._keep(known)
            first = known.first // 1000 + 1
            self._wake(min(first, known.last_ms + self.rule.idle_ms + 1) if known.steps else first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, known = timerValues.getCurrentWatermarkInMs(), self._known()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        reason, taken = None, 0
        while taken < len(rows) and rows[taken][0] // 1000 < now and reason is None:
            reason = known.take(*rows[taken], self.rule)
            taken += 1
        if reason is None and known.steps and now > known.last_ms + self.rule.idle_ms:
            reason = "silent"
        rest = [] if reason else rows[taken:]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        known.ended = reason is not None
        known.first = rest[0][0] if rest else -1
        self._keep(known)
        if reason:
            yield pd.DataFrame({"key": [key[0]], "reason": [reason], "ended_ms": [known.last_ms], "steps": [known.steps], "best": pd.array([known.best], "Float64"), "best_id": pd.array([known.best_id], "Int64")})
        else:
            wake = known.last_ms + self.rule.idle_ms + 1
            self.handle.registerTimer(min(wake, rest[0][0] // 1000 + 1) if rest else wake)

    def close(self) -> None:
        pass


def ended_runs(rows: DataFrame, key: str, time: str, row_id: str, value: str, rule: Rule, late: str = "2 hours") -> DataFrame:
    """One row for each run of a stream that has ended: why, when, after how many steps, and its best row.

    A run is all rows of a key. It ends once and stays ended, whatever comes later. Rows without a key or a time are
    left out; a null or NaN value is a step that does not improve. The session must keep state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``), which timers need.
    """
    known = rows.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("_time"), F.col(row_id).cast("long").alias("id"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value"))
    known = known.where("key IS NOT NULL AND _time IS NOT NULL").withColumn("at", F.unix_micros("_time")).withWatermark("_time", late)
    return known.groupBy("key").transformWithStateInPandas(Controller(rule), ENDED, "Append", "EventTime")
