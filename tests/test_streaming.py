import shutil
from datetime import timedelta

from pyspark.sql import functions as F

from docquarry.operators import state
from docquarry.sources import table_path
from docquarry.streaming import jobs


def stream(spark, sf_dir, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    events = spark.read.parquet(table_path(sf_dir, "events")).selectExpr(
        "event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props"
    )
    events.repartition(1).write.mode("overwrite").parquet(str(tmp_path / "all"))
    for path in (tmp_path / "all").glob("*.parquet"):
        shutil.copy(path, folder / path.name)
    return events, jobs.event_stream(spark, str(folder))


def test_windowed_counts(spark, sf_dir, tmp_path):
    events, live = stream(spark, sf_dir, tmp_path)
    jobs.run_once(jobs.windowed_counts(live), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    # only windows that the watermark has not passed yet are still open
    closed = events.agg(F.expr("max(ts) - interval 2 hours")).first()[0]
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    want = {(r.w.start, r.event_type, r.n) for r in want.collect() if r.w.end <= closed}
    assert want and {(r.start, r.event_type, r.n) for r in got.collect()} == want


def test_quiet_periods(spark, sf_dir, tmp_path):
    events, live = stream(spark, sf_dir, tmp_path)
    jobs.run_once(jobs.quiet_periods(live, "6 hours", "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"), limit=120)
    got = {(r.user_id, r.first_at, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = events.agg(F.expr("max(ts) - interval 1 minute")).first()[0]
    runs = {}
    for r in events.orderBy("ts").collect():
        own = runs.setdefault(r.user_id, [])
        if own and r.ts < own[-1][1] + timedelta(hours=6):
            own[-1][1:] = [r.ts, own[-1][2] + 1]
        else:
            own.append([r.ts, r.ts, 1])
    want = {(u, first, n) for u, own in runs.items() for first, last, n in own if last + timedelta(hours=6) <= closed}
    assert want and got == want


def test_rate_limit_is_that_of_the_batch(spark, sf_dir, tmp_path):
    events, live = stream(spark, sf_dir, tmp_path)
    jobs.run_once(jobs.rate_limited(live, 2.0, 1 / 43200), str(tmp_path / "out"), str(tmp_path / "state"), limit=120)
    got = {(r.event_id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = state.token_bucket(events.selectExpr("user_id key", "event_id", "ts"), 2.0, 1 / 43200)
    assert got == {(r.event_id, r.allowed) for r in want.collect()}
    assert any(not a for _, a in got)
