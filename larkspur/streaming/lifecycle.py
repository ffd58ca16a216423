"""The life of remote batches as a stream: what happens to each becomes a state that timers and restarts keep right."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from larkspur.operators.ports import BatchClient

EVENTS = "batch_id string, event string, at timestamp"
CHANGES = "batch_id string, before string, after string, at timestamp"
#: Which state an event leads to, from which states; all other events change nothing (late ones, repeated ones).
STEPS = {
    "submitted": ("submitted", ("none",)),
    "in_progress": ("running", ("submitted",)),
    "completed": ("completed", ("submitted", "running")),
    "failed": ("failed", ("submitted", "running")),
    "cancelled": ("cancelled", ("submitted", "running")),
    "collected": ("collected", ("completed",)),
}
OPEN = ("submitted", "running")


class Lifecycle(StatefulProcessor):
    """One batch: its state and the time by which it must have ended. What is open at that time has expired."""

    def __init__(self, hours: float):
        self.window = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else "none"
        changes = []
        for r in pd.concat(list(rows)).sort_values(["at", "event"], kind="stable").itertuples():
            after, before = STEPS.get(r.event, (None, ()))
            if now not in before:
                continue
            if now == "none":
                self.handle.registerTimer(int(r.at.timestamp() * 1000) + self.window)
            changes.append((key[0], now, after, r.at))
            now = after
        if changes:
            self.state.update((now,))
            if now not in OPEN:
                self._stop_timers()
        yield pd.DataFrame(changes, columns=["batch_id", "before", "after", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else "none"
        if now not in OPEN:
            return
        self.state.update(("expired",))
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], now, "expired", at)], columns=["batch_id", "before", "after", "at"])

    def _stop_timers(self) -> None:
        for (at,) in [(t[0] if isinstance(t, tuple) else t,) for t in self.handle.listTimers()]:
            self.handle.deleteTimer(at)


def events(spark: SparkSession, folder: str) -> DataFrame:
    """What happened to batches, from JSON lines in files that come into the folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def changes(happened: DataFrame, hours: float = 24, late: str = "10 minutes") -> DataFrame:
    """batch_id, before, after, at: each change of a batch's state, once.

    An event counts only from the states that it can follow, so repeated and late ones change nothing; a batch that has
    not ended `hours` after it was submitted expires, as soon as the events' time (less `late`) has passed that point.
    States outlive restarts in the query's checkpoint. Rows without a batch or a time do not count.
    """
    happened.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = happened.filter("batch_id is not null and at is not null").withWatermark("at", late)
    return known.groupBy("batch_id").transformWithStateInPandas(Lifecycle(hours), outputStructType=CHANGES, outputMode="append", timeMode="EventTime")


def land(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes that have come to a parquet folder, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def note(folder: str, happened: list[tuple[str, str]], now: datetime | None = None) -> str:
    """Puts a file of events (batch id, event) into the folder, whole or not at all."""
    at = (now or datetime.now(timezone.utc)).isoformat()
    written = Path(folder) / f".{uuid.uuid4().hex}"
    Path(folder).mkdir(parents=True, exist_ok=True)
    written.write_text("".join(json.dumps({"batch_id": b, "event": e, "at": at}) + "\n" for b, e in happened))
    return str(written.rename(written.with_name(f"{written.name[1:]}.json")))


def poll(registry: dict[str, str], client: BatchClient, folder: str, now: datetime | None = None) -> str:
    """Asks for the state of every batch of a registry (file name to id) and notes what it says."""
    return note(folder, [(batch_id, client.status(batch_id)) for batch_id in registry.values()], now)
