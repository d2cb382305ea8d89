"""Keyed state that outlives batches: rate limits by route, and event streams folded to one row.

Both processors handle events in the order of event time, whatever order files bring them in: an event
waits in state until the watermark has passed it, and a timer then handles all that are due.
State of the RocksDB store is required (`state_settings`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docquarry.operators.state import FOLDED, Limits, fold_events
from docquarry.session import ship_package


def state_settings(spark: SparkSession) -> None:
    """The state store that state with timers needs."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _due(at: int) -> int:
    """Milliseconds of the timer of an event at so many microseconds: not before it."""
    return -(-at // 1000)


class RouteBuckets(StatefulProcessor):
    """One token bucket for each (client, route); a bucket is a number of tokens and the time of its last event."""

    def __init__(self, limits: Limits):
        self.limits, self.idle_ms = limits, int(limits.idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last long")
        self.waiting = handle.getListState("waiting", "at long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, r.event_id) for r in rows]
        if not self.waiting.exists():
            self.waiting.put(new)
        else:
            self.waiting.appendList(new)
        self.handle.registerTimer(max(_due(min(new)[0]), timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in held if _due(x[0]) <= now]
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.limits.burst, None)
        if not due:
            if not held and last is not None and _due(last) + self.idle_ms <= now:
                self.bucket.clear()
                self.waiting.clear()
            return
        for at, event_id in due:
            tokens, allowed, wait = self.limits.take(key[1], tokens, last, at)
            last = at
            yield Row(client=key[0], route=key[1], event_id=event_id, allowed=allowed, retry_after=wait)
        self.bucket.update((float(tokens), int(last)))
        left = held[len(due) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(max(_due(left[0][0]), now + 1))
        else:
            self.waiting.clear()
        self.handle.registerTimer(max(_due(last) + self.idle_ms, now + 1))

    def close(self) -> None:
        pass


def rate_limited_by_route(requests: DataFrame, limits: Limits = Limits(), late: str = "1 minute") -> DataFrame:
    """(client, route, event_id, allowed, retry_after) of a stream of requests (client, path, event_id, ts).

    Each route has its limit, each client its bucket for it; public routes take no part. Requests are handled in the order of ts
    and event_id once the watermark, `late` behind the latest one, has passed them; later ones
    are dropped. The state of a bucket goes when the watermark is limits.idle past its last request.
    """
    ship_package(requests.sparkSession)
    state_settings(requests.sparkSession)
    routed = limits.routed(requests.withWatermark("ts", late)).selectExpr("client", "route", "event_id", "ts", "unix_micros(ts) at")
    return routed.groupBy("client", "route").transformWithState(
        RouteBuckets(limits),
        "client string, route string, event_id long, allowed boolean, retry_after long", "append", "EventTime",
    )


class StreamFold(StatefulProcessor):
    """Typed events of one stream, by their number, until it ends or has been quiet for too long."""

    def __init__(self, quiet_seconds: float):
        self.quiet_ms = int(quiet_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "kind string, content string, cost double, at long")
        self.done = handle.getValueState("done", "at long")

    def _held(self) -> list[tuple]:
        return [(k[0], *v) for k, v in self.events.iterator()]

    def _out(self, key, events: list[tuple], now: int) -> Row:
        self.events.clear()
        # the mark stays while repeats may still come
        self.done.update((now,))
        self.handle.registerTimer(now + self.quiet_ms)
        return Row(**dict(zip(["stream_id", *FOLDED], [key[0], *fold_events(events)])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.exists():
            return
        last = None
        for r in sorted(rows, key=lambda r: (r.seq, r.at)):
            known = self.events.getValue((r.seq,)) if self.events.containsKey((r.seq,)) else None
            if known is None or r.at < known[3]:  # of repeats the earliest counts
                self.events.updateValue((r.seq,), (r.kind, r.content, r.cost, r.at))
            last = r.at if last is None else max(last, r.at)
        held = self._held()
        ends = [s for s, kind, *_ in held if kind in ("done", "error")]
        if ends and sum(s <= min(ends) for s, *_ in held) == min(ends) + 1:
            yield self._out(key, held, max(now, 0))
            return
        for at in [a for s, kind, _, _, a in held if s in ends] or [last + self.quiet_ms * 1000]:
            self.handle.registerTimer(max(_due(at), now + 1))
        self.handle.registerTimer(max(_due(last) + self.quiet_ms, now + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.exists():
            if self.done.get()[0] + self.quiet_ms <= now:
                self.done.clear()
            return
        held = self._held()
        if not held:
            return
        ends = [(s, at) for s, kind, _, _, at in held if kind in ("done", "error")]
        last = max(at for *_, at in held)
        if (ends and _due(min(ends)[1]) <= now) or _due(last) + self.quiet_ms <= now:
            yield self._out(key, held, now)

    def close(self) -> None:
        pass


def folded_streams(events: DataFrame, quiet: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """One row for each stream (see `operators.state.folded`) of a stream of events (stream_id, seq, kind, content, cost, ts).

    A stream comes out once: as soon as all events up to its first end are there, or when the watermark has passed
    the end, or when no event has come for `quiet`. Repeats and what comes later change nothing, until
    the stream has been out for `quiet`.
    """
    ship_package(events.sparkSession)
    state_settings(events.sparkSession)
    rows = events.withWatermark("ts", late).selectExpr("stream_id", "seq", "kind", "content", "cost", "ts", "unix_micros(ts) at")
    schema = "stream_id long, " + ", ".join(f"{n} {t}" for n, t in FOLDED.items())
    return rows.groupBy("stream_id").transformWithState(StreamFold(pd.Timedelta(quiet).total_seconds()), schema, "append", "EventTime")
