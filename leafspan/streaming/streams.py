"""Progress messages and call logs as streams. The same functions serve batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of every document; a running aggregate, for update mode."""
    last = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("event_type", last).alias("status"), F.max("ts").alias("updated"))


def progress(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Phase i of seven with its percentage; repeats within the watermark go."""
    unique = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    phase = F.col("event_id") % 7 + 1
    return unique.select("event_id", F.col("user_id").alias("document_id"), phase.alias("phase"), (phase / 7 * 100).alias("pct"))


def call_metrics(calls: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Calls, failures, tokens and time by operation and tumbling window."""
    if calls.isStreaming:
        calls = calls.withWatermark("created_at", delay)
    out = calls.groupBy(F.window("created_at", window), "operation").agg(
        F.count("*").alias("calls"), F.sum((~F.col("success")).cast("int")).alias("failures"), F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms")
    )
    return out.select(F.col("window.start").alias("window_start"), "operation", "calls", "failures", "tokens", "duration_ms")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Periods of activity of a user; a pause of gap ends one."""
    if events.isStreaming:
        events = events.withWatermark("ts", delay)
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def silences(events: DataFrame, timeout_seconds: int = 1800, delay: str = "2 hours", id_col: str = "user_id") -> DataFrame:
    """(id_col, last_seen, silent_at): a row as soon as a subscriber has said nothing for timeout_seconds of event time.

    events is a stream with id_col and ts. A subscriber's state is its last event
    and a timer; the timer fires when the watermark passes it and no event has
    come, without waiting for a next one. Within a batch events go by time, and a
    pause that is longer gives its row as the timer would have. A subscriber
    that comes back is watched anew. Null ids are one subscriber; events without a time say nothing.
    """
    gap = timeout_seconds * 1_000_000
    kind = events.schema[id_col].dataType.simpleString()

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, last = [], state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append(last)
            state.remove()
        else:
            seen = sorted(t for f in frames for t in f["us"])
            for t in seen:
                if last is not None and t - last >= gap:
                    out.append(last)
                last = t if last is None else max(last, t)
            if last is not None:
                state.update((last,))
                # A timer may not be set behind the watermark; such a one is due at once.
                state.setTimeoutTimestamp(max((last + gap) // 1000, state.getCurrentWatermarkMs() + 1))
        if not out:
            return
        when = pd.to_datetime(pd.Series(out, dtype="int64"), unit="us", utc=True)
        yield pd.DataFrame({id_col: pd.Series([key[0]] * len(out), dtype=object), "last_seen": when, "silent_at": when + pd.Timedelta(microseconds=gap)})

    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(id_col, "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy(id_col).applyInPandasWithState(watch, f"{id_col} {kind}, last_seen timestamp, silent_at timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(df: DataFrame, folder: str) -> DataFrame:
    """Drives a stream over all that is there now into Parquet files below a shared folder, and reads them."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a stream over all that is there now into a table in memory: for tests and small results."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)
