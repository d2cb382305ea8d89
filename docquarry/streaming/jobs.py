"""Streams of events: windowed counts, quiet periods, rate limits with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docquarry.session import ship_package

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Events from a folder of Parquet files as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def quiet_periods(events: DataFrame, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of events of a user without a gap; a run fires when it has been quiet for the gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("fires_at"), "n")
    )


def rate_limited(events: DataFrame, capacity: float, per_second: float, idle: str = "1 day", late: str = "1 day") -> DataFrame:
    """Each event of a user with whether its token bucket allows it; a bucket is forgotten when the watermark, which
    is `late` behind the latest event, has been idle behind its last one. Later events are dropped.

    A bucket is two numbers. Events of one batch are taken in the order of ts and event_id.
    """
    ship_package(events.sparkSession)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        tokens, last = state.get if state.exists else (capacity, None)
        allowed = []
        for at in rows["ts"].astype("int64") / 1e9 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].map(lambda t: t.timestamp()):
            tokens = min(capacity, tokens + (max(0.0, at - last) * per_second if last is not None else 0.0))
            last = at if last is None else max(last, at)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int(last * 1000) + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", limit: int = 3600) -> None:
    """Writes all that is there now as Parquet, exactly once, and ends; a run of over `limit` seconds is stopped."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(limit):
        query.stop()
        raise TimeoutError(f"the stream had not ended after {limit} seconds")
