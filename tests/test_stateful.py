"""Streams with keyed state against their batch forms, on files in shuffled order."""

import random
from datetime import datetime, timedelta

import pytest

from docquarry.operators import state
from docquarry.streaming import jobs, stateful

START = datetime(2024, 1, 1)
REQUESTS = "client string, path string, event_id long, ts timestamp"
TYPED = "stream_id long, seq long, kind string, content string, cost double, ts timestamp"


def as_stream(spark, rows, schema, folder, files):
    """rows as a stream of one file a batch, in the order in which they stand."""
    for k in range(files):
        spark.createDataFrame(rows[k::files] if files > 1 else rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, stream, tmp_path):
    jobs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"), limit=150)
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_buckets(rows, limits):
    """Every request in order of time, a bucket for each client and route."""
    buckets, out = {}, {}
    for client, path, event_id, ts in sorted(rows, key=lambda r: (r[3], r[2])):
        if path in limits.public or path.startswith(limits.public_starts):
            continue
        route = next((r for r in limits.routes if path.startswith(r)), "default")
        rate = limits.routes.get(route, limits.default) / 60
        tokens, last = buckets.get((client, route), (limits.burst, ts))
        tokens = min(limits.burst, tokens + (ts - last).total_seconds() * rate)
        out[event_id] = tokens >= 1
        buckets[client, route] = (tokens - (tokens >= 1), ts)
    return out


def requests(seed, n=120):
    rng = random.Random(seed)
    paths = ["/auth/login", "/auth/register/x", "/chat/stream", "/other", "/health", "/static/a.css", "/"]
    return [(f"c{rng.randrange(3)}", rng.choice(paths), i, START + timedelta(seconds=rng.randrange(60))) for i in range(n)]


def test_buckets_of_routes(spark):
    rows, limits = requests(1), state.Limits(burst=2)
    got = state.limited_by_route(spark.createDataFrame(rows, REQUESTS), limits).collect()
    assert {r.event_id: r.allowed for r in got} == plain_buckets(rows, limits)
    denied = [r for r in got if not r.allowed]
    assert denied and all(r.retry_after >= 1 for r in denied) and all(r.retry_after == 0 for r in got if r.allowed)


def test_stream_of_shuffled_requests_is_the_batch(spark, few, tmp_path):
    rows, limits = requests(2), state.Limits(burst=2)
    random.Random(3).shuffle(rows)
    # a last file moves the watermark past all others, and one row behind it comes too late
    rows_and_end = as_stream(spark, rows, REQUESTS, tmp_path / "in", 3)
    spark.createDataFrame([("end", "/other", 9000, START + timedelta(hours=2))], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", "/other", 9001, START + timedelta(hours=4))], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.event_id: r.allowed for r in run(spark, stateful.rate_limited_by_route(rows_and_end, limits, late="2 minutes"), tmp_path)}
    assert got == plain_buckets(rows, limits) | {9000: True}


def test_an_idle_bucket_is_forgotten(spark, few, tmp_path):
    # six requests empty a bucket that refills by one in an hour
    limits = state.Limits(routes={}, default=1 / 60, burst=5, idle=600)
    first = [("c", "/x", i, START + timedelta(seconds=i)) for i in range(6)]
    for k, part in enumerate([first, [("z", "/x", 50, START + timedelta(minutes=30))], [("z", "/x", 51, START + timedelta(minutes=45))],
                              [("c", "/x", 60 + i, START + timedelta(minutes=46, seconds=i)) for i in range(2)], [("z", "/x", 52, START + timedelta(hours=3))], [("z", "/x", 53, START + timedelta(hours=6))]]):
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.allowed for r in run(spark, stateful.rate_limited_by_route(stream(), limits, late="1 minute"), tmp_path)}
    assert [got[i] for i in range(6)] == [True] * 5 + [False]
    assert got[60] and got[61]  # a new bucket: the old one would have no second token yet
    plain = plain_buckets(first + [("c", "/x", 60 + i, START + timedelta(minutes=46, seconds=i)) for i in range(2)], limits)
    assert not plain[60]
    # what state is left: nothing of the bucket of c
    keys = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "bucket").load()
    assert "c" not in {r.key[0] for r in keys.select("key").collect()}


def typed(stream_id, kinds, at=0, step=1):
    return [(stream_id, i, k, f"{k[0]}{i} ", float(i) if k == "cost_summary" else None, START + timedelta(seconds=at + i * step)) for i, k in enumerate(kinds)]


EVENTS = [
    *typed(1, ["thinking_delta", "text_delta", "tool_call", "text_delta", "cost_summary", "done"]),
    *typed(2, ["text_delta", "error", "text_delta"]),
    *typed(3, ["text_delta", "tool_call"]),  # never ends
    *[e for e in typed(4, ["text_delta", "text_delta", "text_delta", "done"]) if e[1] != 1],  # one is missing
    *typed(5, ["done"]),
]
WANT = {
    1: ("done", "t1 t3 ", "t0 ", ["t2 "], 4.0, 6, 0), 2: ("error", "t0 ", "", [], None, 2, 0), 3: ("timeout", "t0 ", "", ["t1 "], None, 2, 0),
    4: ("done", "t0 t2 ", "", [], None, 3, 1), 5: ("done", "", "", [], None, 1, 0),
}


def values(rows):
    return {r.stream_id: tuple(r[n] for n in state.FOLDED) for r in rows}


def test_folded_events(spark):
    odd = [(None, 0, "done", "", None, START), (6, -1, "done", "", None, START), (6, 0, None, "", None, START)]
    repeats = [(1, 1, "text_delta", "other", None, START + timedelta(hours=1)), (1, 9, "done", "", None, START)]
    frame = spark.createDataFrame(EVENTS + odd + repeats, TYPED)
    assert values(state.folded(frame).collect()) == WANT
    assert state.folded(frame.where("false")).count() == 0
    for stream_id, want in WANT.items():
        own = [(e[1], e[2], e[3], e[4], 0) for e in EVENTS if e[0] == stream_id]
        assert state.fold_events(own) == want


def test_stream_of_late_repeated_and_missing_events(spark, few, tmp_path):
    rows = EVENTS + [e for e in EVENTS if e[0] in (1, 3)]  # repeats
    random.Random(4).shuffle(rows)
    stream = as_stream(spark, rows, TYPED, tmp_path / "in", 3)
    later = [(1, 2, "tool_call", "again", None, START + timedelta(seconds=30)), (9, 0, "text_delta", "end", None, START + timedelta(minutes=30))]
    for part in (later, [(9, 1, "text_delta", "", None, START + timedelta(minutes=60))], [(9, 2, "text_delta", "", None, START + timedelta(minutes=90))]):
        spark.createDataFrame(part, TYPED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run(spark, stateful.folded_streams(stream, quiet="10 minutes", late="1 minute"), tmp_path)
    got = [r for r in got if r.stream_id != 9]
    assert len(got) == len(WANT)  # each once
    assert values(got) == WANT
