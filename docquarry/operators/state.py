"""Time and state in batch: token buckets, budgets, streaks, quiet periods."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.costs import route_of
from docquarry.session import ship_package


def token_bucket(events: DataFrame, capacity: float, per_second: float) -> DataFrame:
    """(key, event_id, allowed, tokens): each event, in the order of ts and event_id, takes a token of
    its key's bucket or is denied. Buckets start full and refill over time up to their capacity.

    Rows are sorted by Spark within partitions of keys and folded as they stream by; a key's rows are
    never held together.
    """
    ship_package(events.sparkSession)
    rows = events.selectExpr("key", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 at")
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "event_id")

    def fold(batches):
        now, tokens, last = None, capacity, 0.0
        for pdf in batches:
            allowed, left = [], []
            for key, at in zip(pdf["key"], pdf["at"]):
                if key != now:
                    now, tokens, last = key, capacity, at
                tokens, last = min(capacity, tokens + (at - last) * per_second), at
                ok = tokens >= 1
                tokens -= ok
                allowed.append(bool(ok))
                left.append(round(tokens, 6))
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "allowed": allowed, "tokens": left})

    return rows.mapInPandas(fold, "key long, event_id long, allowed boolean, tokens double")


# Requests a minute by the start of the path, the limit of other routes, and routes without limits.
ROUTE_LIMITS = {
    "/auth/login": 10, "/auth/register": 5, "/auth/me": 120, "/auth/logout": 30, "/chat/stream": 30, "/citations": 300,
}
DEFAULT_LIMIT, BURST = 60, 10
PUBLIC_ROUTES = ("/", "/health", "/docs", "/openapi.json", "/redoc")
PUBLIC_STARTS = ("/static/", "/favicon.ico", "/assets/")


@dataclass(frozen=True)
class Limits:
    """Requests a minute of each route, by the start of the path; how many tokens a bucket holds, and after how many
    seconds without requests it is forgotten, so that it starts full again. `unit` is how many seconds of the requests'
    times count as one."""

    routes: dict[str, int] = field(default_factory=lambda: dict(ROUTE_LIMITS))
    default: int = DEFAULT_LIMIT
    burst: float = BURST
    idle: float = 600
    public: tuple[str, ...] = PUBLIC_ROUTES
    public_starts: tuple[str, ...] = PUBLIC_STARTS
    unit: float = 1

    def routed(self, requests: DataFrame) -> DataFrame:
        """requests with their route, those of public ones left out; a null path is of no route of its own."""
        public = F.col("path").isin(*self.public)
        for start in self.public_starts:
            public = public | F.startswith("path", F.lit(start))
        return requests.where(~F.coalesce(public, F.lit(False))).withColumn("route", route_of("path", list(self.routes)))

    def take(self, route: str, tokens: float, last: int | None, at: int) -> tuple[float, bool, int]:
        """(tokens left, whether the request is allowed, seconds after which to try again) at so many microseconds."""
        rate = self.routes.get(route, self.default) / 60 / self.unit
        if last is None or (at - last) / 1e6 >= self.idle * self.unit:
            tokens = self.burst
        else:
            tokens = min(self.burst, tokens + (at - last) / 1e6 * rate)
        if tokens >= 1:
            return tokens - 1, True, 0
        return tokens, False, int((1 - tokens) / rate) + 1


def limited_by_route(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(client, route, event_id, allowed, retry_after) of requests (client, path, event_id, ts): the batch form of the stream's
    rate limits. Rows are folded as they stream by, sorted within partitions of (client, route); the fold looks
    at one row after another, as each decision hangs on the one before."""
    ship_package(requests.sparkSession)
    rows = limits.routed(requests).selectExpr("client", "route", "event_id", "unix_micros(cast(ts as timestamp)) at")
    rows = rows.repartition("client", "route").sortWithinPartitions("client", "route", "at", "event_id")

    def fold(batches):
        now, tokens, last = None, 0.0, None
        for batch in batches:
            allowed, waits = [], []
            for client, route, at in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (client, route) != now:
                    now, tokens, last = (client, route), limits.burst, None
                tokens, ok, wait = limits.take(route, tokens, last, at)
                last = at
                allowed.append(ok)
                waits.append(wait)
            columns = [*batch.columns[:3], pa.array(allowed, pa.bool_()), pa.array(waits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["client", "route", "event_id", "allowed", "retry_after"])

    return rows.mapInArrow(fold, "client string, route string, event_id long, allowed boolean, retry_after long")


#: What a stream of typed events comes down to.
FOLDED = {
    "status": "string", "answer": "string", "thinking": "string", "tools": "array<string>", "cost": "double",
    "n_events": "long", "missing": "long",
}


def fold_events(events: list[tuple]) -> tuple:
    """The FOLDED values of one stream's different events (seq, kind, content, cost, at)."""
    rows = sorted(events)
    ends = [s for s, kind, *_ in rows if kind in ("done", "error")]
    if ends:
        rows = [r for r in rows if r[0] <= ends[0]]
    said = {k: "".join(c or "" for _, kind, c, *_ in rows if kind == k) for k in ("text_delta", "thinking_delta")}
    tools = [c for _, kind, c, *_ in rows if kind == "tool_call" and c is not None]
    costs = [c for _, kind, _, c, _ in rows if kind == "cost_summary" and c is not None]
    status = rows[-1][1] if ends else "timeout"
    return status, said["text_delta"], said["thinking_delta"], tools, costs[-1] if costs else None, len(rows), rows[-1][0] + 1 - len(rows)


def folded(events: DataFrame) -> DataFrame:
    """(stream_id, status, answer, thinking, tools, cost, n_events, missing) of events (stream_id, seq, kind, content, cost, ts).

    Events count by their number seq, from 0, once; of repeats the earliest counts. A stream ends with
    its first `done` or `error`, whose name is the status, and later numbers say nothing; without an end it is a
    `timeout`. answer and thinking join the text_delta and thinking_delta contents, tools lists the tool_call
    contents, cost is that of the last cost_summary, missing counts numbers that never came.
    """
    sound = events.where("stream_id is not null and seq >= 0 and kind is not null")
    once = sound.groupBy("stream_id", "seq").agg(F.min(F.struct("ts", "kind", "content", "cost")).alias("e"))
    rows = once.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "e.kind", "e.content", "e.cost"))).alias("all"))
    rows = rows.selectExpr("stream_id", "all", "get(filter(all, x -> x.kind in ('done', 'error')), 0).seq last")
    rows = rows.selectExpr("stream_id", "last", "if(last is null, all, filter(all, x -> x.seq <= last)) r")
    joined = "array_join(transform(filter(r, x -> x.kind = '{0}'), x -> coalesce(x.content, '')), '')"
    return rows.selectExpr(
        "stream_id", "if(last is null, 'timeout', element_at(r, -1).kind) status", joined.format("text_delta") + " answer",
        joined.format("thinking_delta") + " thinking", "transform(filter(r, x -> x.kind = 'tool_call' and x.content is not null), x -> x.content) tools",
        "try_element_at(filter(r, x -> x.kind = 'cost_summary' and x.cost is not null), -1).cost cost", "cast(size(r) as long) n_events",
        "element_at(r, -1).seq + 1 - size(r) missing",
    )


def spending_guard(costs: DataFrame, limit: float) -> DataFrame:
    """(user_id, accepted, denied, spent): costs (user_id, ord, cents) are added, in order, only while
    the total stays within limit. Whole cents, folded over rows sorted within partitions of users."""
    ship_package(costs.sparkSession)
    rows = costs.repartition("user_id").sortWithinPartitions("user_id", "ord").select("user_id", "cents")

    def fold(batches):
        now, spent, yes, no = None, 0, 0, 0
        for pdf in batches:
            out = []
            for user, cents in zip(pdf["user_id"].tolist(), pdf["cents"].tolist()):
                if user != now:
                    if now is not None:
                        out.append((now, yes, no, spent))
                    now, spent, yes, no = user, 0, 0, 0
                if spent + cents <= limit:
                    spent, yes = spent + cents, yes + 1
                else:
                    no += 1
            yield pd.DataFrame(out, columns=["user_id", "accepted", "denied", "spent"])
        if now is not None:
            yield pd.DataFrame([(now, yes, no, spent)], columns=["user_id", "accepted", "denied", "spent"])

    return rows.mapInPandas(fold, "user_id long, accepted long, denied long, spent long")


def streaks(rows: DataFrame, key: str, order: list[str], failed: str) -> DataFrame:
    """rows with run: how many failures in a row end here; a success has 0."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(F.expr(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_island", island)
    inside = Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run", F.sum(F.when(F.expr(failed), 1).otherwise(0)).over(inside)).drop("_island")


def repeated_failures(rows: DataFrame, key: str, order: list[str], failed: str, last: int = 3, run: int = 2) -> DataFrame:
    """rows with stop: whether so many failures in a row stand among the last rows of the key, this one included."""
    w = Window.partitionBy(key).orderBy(*order)
    before = [F.coalesce(F.lag(F.expr(failed), k).over(w) if k else F.expr(failed), F.lit(False)) for k in range(last)]
    stop = F.lit(False)
    for k in range(last - run + 1):
        own = F.lit(True)
        for flag in before[k : k + run]:
            own = own & flag
        stop = stop | own
    return rows.withColumn("stop", stop)


def quiet_periods(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, first_at, fires_at, n): events with gaps of at most that many seconds run together; each
    run fires once it has been quiet for so long."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.expr("unix_micros(cast(ts as timestamp))") - F.lag(F.expr("unix_micros(cast(ts as timestamp))")).over(w)
    new = F.when(gap.isNull() | (gap > seconds * 1_000_000), 1).otherwise(0)
    rows = events.withColumn("_new", new)
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_run").agg(
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n")
    ).select(key, "first_at", (F.col("last_at") + F.expr(f"interval {seconds} seconds")).alias("fires_at"), "n")
