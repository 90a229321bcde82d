"""Job status from a stream of stage events, and a sink that pushes finished stages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Allowed moves of a stage.
MOVES = {"PENDING": ("TRIGGERED", "SKIPPED"), "TRIGGERED": ("RUNNING", "FAILED", "TRIGGERED"), "RUNNING": ("COMPLETED", "SKIPPED", "FAILED", "TRIGGERED")}
OUTPUT = "job_id long, status string, at timestamp, events long, refused long"


def _advance(stale_after_ms: int | None):
    """Applies events in order of time; moves that aren't allowed are counted and refused."""

    def run(key, batches, state: GroupState):
        status, at, n, refused = state.get if state.exists else ("PENDING", None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            status = "STALE" if status in ("TRIGGERED", "RUNNING") else status
        else:
            rows = pd.concat(batches).sort_values(["ts", "event_id"])
            for ts, to in zip(rows.ts, rows.status):
                n += 1
                if to in MOVES.get(status, ()):
                    status, at = to, ts
                else:
                    refused += 1
            state.update((status, at, n, refused))
            if stale_after_ms:
                state.setTimeoutDuration(stale_after_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "at": pd.to_datetime([at]), "events": [n], "refused": [refused]})

    return run


def job_states(events: DataFrame, stale_after_ms: int | None = 300_000) -> DataFrame:
    """Status of each job after each micro-batch of events (job_id, event_id, ts, status); a silent job is STALE after a while."""
    wait = GroupStateTimeout.ProcessingTimeTimeout if stale_after_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("job_id").applyInPandasWithState(_advance(stale_after_ms), OUTPUT, "status string, at timestamp, events long, refused long", "update", wait)


def stage_events(events: DataFrame) -> DataFrame:
    """Stage events from plain events: a user is a job, the type the new state."""
    names = {"signup": "TRIGGERED", "view": "RUNNING", "purchase": "COMPLETED", "error": "FAILED", "click": "SKIPPED"}
    status = F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("event_type")]
    return events.select(F.col("user_id").alias("job_id"), "event_id", "ts", status.alias("status"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each state in tumbling windows, late ones dropped behind the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size).alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def push(states: DataFrame, send, checkpoint: str, once: bool = False, alive=None):
    """Starts a query that hands finished jobs to a sink on the driver; `once` stops after what there is.

    send(dict) gets one job after another, as they stream in from the executors: a live feed has
    one connection.  alive() is called for a micro-batch without finished jobs, so that the connection stays open.
    """

    def each(df: DataFrame, _: int) -> None:
        sent = False
        for r in df.filter(F.col("status").isin("COMPLETED", "FAILED", "SKIPPED")).toLocalIterator():
            send(r.asDict())
            sent = True
        if alive and not sent:
            alive()

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def push_from_executors(states: DataFrame, connect, checkpoint: str, once: bool = False):
    """As `push`, but every task sends its own jobs: connect() is called once a partition and returns a function that takes a dict."""

    def part(rows) -> None:
        send = connect()
        for r in rows:
            send(r.asDict())

    def each(df: DataFrame, _: int) -> None:
        df.filter(F.col("status").isin("COMPLETED", "FAILED", "SKIPPED")).foreachPartition(part)

    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
