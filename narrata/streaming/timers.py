"""Stage states kept by a stateful processor with event-time timers: a silent stage becomes stale by itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from narrata.streaming.jobs import MOVES

#: The state store that processors of this kind need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OPEN = ("TRIGGERED", "RUNNING")
STALE_MS = 300_000

STATE = StructType([StructField("status", StringType()), StructField("seen", LongType()), *[StructField(c, LongType()) for c in ("events", "refused", "lapses")]])
OUTPUT = StructType([StructField("job_id", LongType()), StructField("status", StringType()), StructField("seen", TimestampType()), *[StructField(c, LongType()) for c in ("events", "refused", "lapses")]])


def micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


def advance(state: tuple, events, stale_us: int) -> tuple:
    """State (status, seen, events, refused, lapses) after events (microseconds, new status) in order of time.

    An open stage that was silent for `stale_us` has lapsed and starts again as PENDING; moves that aren't allowed are refused.
    """
    status, seen, n, refused, lapses = state
    for at, to in events:
        if status in (*OPEN, "STALE") and seen is not None and (status == "STALE" or at - seen > stale_us):
            lapses += status != "STALE"
            status = "PENDING"
        if to in MOVES.get(status, ()):
            status = to
        else:
            refused += 1
        seen, n = at, n + 1
    return status, seen, n, refused, lapses


class StageClock(StatefulProcessor):
    """One stage's state; a timer is set to the end of its patience and moved by every event."""

    def __init__(self, stale_ms: int = STALE_MS):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stage", STATE)

    def _row(self, key, state: tuple) -> pd.DataFrame:
        status, seen, *counts = state
        return pd.DataFrame([(key[0], status, pd.Timestamp(seen, unit="us"), *counts)], columns=OUTPUT.names)

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(rows).sort_values(["ts", "event_id"])
        state = tuple(self.state.get()) if self.state.exists() else ("PENDING", None, 0, 0, 0)
        state = advance(state, zip(micros(pdf.ts), pdf.status), self.stale_ms * 1000)
        self.state.update(state)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if state[0] in OPEN:
            self.handle.registerTimer(state[1] // 1000 + self.stale_ms + 1)
        yield self._row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        status, seen, n, refused, lapses = tuple(self.state.get())
        if status in OPEN:
            state = ("STALE", seen, n, refused, lapses + 1)
            self.state.update(state)
            yield self._row(key, state)

    def close(self) -> None:
        pass


def stage_clock(events: DataFrame, stale_ms: int = STALE_MS, late: str = "0 seconds") -> DataFrame:
    """Changes of each stage's state from a stream of events (job_id, event_id, ts, status), as they come and as timers fire.

    The session's state store must be that of `STORE`.  Events of a micro-batch are ordered by time and id.
    """
    rows = events.withWatermark("ts", late).groupBy("job_id")
    return rows.transformWithStateInPandas(statefulProcessor=StageClock(stale_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def replay(events: DataFrame, folder: str, stale_ms: int = STALE_MS) -> DataFrame:
    """The state of every stage after all that a stream holds now: runs it into a table below `folder` and reads the last change of each."""
    spark = events.sparkSession
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        changes = stage_clock(events, stale_ms)
        run = changes.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)
    table = spark.read.schema(OUTPUT).parquet(f"{folder}/changes")
    last = F.max_by(F.struct(*OUTPUT.names[1:]), F.struct("events", "lapses"))
    return table.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
