"""Time and state on `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import caches, state
from docquarry.plans.registry import query
from docquarry.sources import load


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(key, event_id, n, sec, before) AS (SELECT key, event_id, n, sec, CAST(2.0 AS DOUBLE) FROM e WHERE n = 1 UNION ALL
SELECT e.key, e.event_id, e.n, e.sec, least(2.0, (CASE WHEN f.before >= 1 THEN f.before - 1 ELSE f.before END) + (e.sec - f.sec) / 43200.0) FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
SELECT key, event_id, before >= 1 AS allowed FROM f""")
def token_bucket(spark, sf_dir):
    rows = load(spark, sf_dir, "events").selectExpr("user_id key", "event_id", "ts")
    return state.token_bucket(rows, 2.0, 1 / 43200).select("key", "event_id", "allowed")


@query("""WITH RECURSIVE c AS (SELECT o_custkey AS user_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
f(user_id, n, spent, yes, no) AS (SELECT user_id, n, CASE WHEN cents <= 100000000 THEN cents ELSE 0 END, CASE WHEN cents <= 100000000 THEN 1 ELSE 0 END, CASE WHEN cents <= 100000000 THEN 0 ELSE 1 END FROM c WHERE n = 1
UNION ALL SELECT c.user_id, c.n, CASE WHEN spent + cents <= 100000000 THEN spent + cents ELSE spent END, yes + CASE WHEN spent + cents <= 100000000 THEN 1 ELSE 0 END, no + CASE WHEN spent + cents <= 100000000 THEN 0 ELSE 1 END FROM f JOIN c ON c.user_id = f.user_id AND c.n = f.n + 1)
SELECT user_id, CAST(max(yes) AS BIGINT) AS accepted, CAST(max(no) AS BIGINT) AS denied, CAST(max(spent) AS BIGINT) AS spent FROM f GROUP BY user_id""")
def spending_guard(spark, sf_dir):
    costs = load(spark, sf_dir, "orders").selectExpr("o_custkey user_id", "o_orderkey ord", "cast(round(o_totalprice * 100) as bigint) cents")
    return state.spending_guard(costs, 100_000_000)


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, event_id FROM (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r) WHERE run = 3""")
def failure_streak(spark, sf_dir):
    rows = state.streaks(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type = 'error'")
    return rows.where("run = 3").select("user_id", "event_id")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 300000000 THEN 1 ELSE 0 END AS new FROM (SELECT event_id, ts, user_id % 8 AS shard FROM events)),
g2 AS (SELECT event_id, ts, shard, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 300000000 THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY shard ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY shard ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g2)
SELECT shard, min(ts) AS first_at, max(ts) + INTERVAL 300 SECONDS AS fires_at, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY shard, run""")
def debounce_sessions(spark, sf_dir):
    rows = load(spark, sf_dir, "events").selectExpr("event_id", "ts", "user_id % 8 shard")
    return state.quiet_periods(rows, "shard", 300)


@query("""SELECT date_trunc('hour', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 10000, 6) AS ratio,
CASE WHEN sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 10000 >= 0.95 THEN 'critical' WHEN sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 10000 >= 0.85 THEN 'compact'
WHEN sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / 10000 >= 0.7 THEN 'prune' ELSE 'ok' END AS zone FROM events""")
def budget_zones(spark, sf_dir):
    """How much of a budget is used, and what has to be done at 0.70, 0.85 and 0.95."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = load(spark, sf_dir, "events").select("user_id", "event_id", (F.sum("value").over(w) / 10000).alias("r"))
    zone = F.expr("case when r >= 0.95 then 'critical' when r >= 0.85 then 'compact' when r >= 0.7 then 'prune' else 'ok' end")
    return rows.select("user_id", "event_id", F.round("r", 6).alias("ratio"), zone.alias("zone"))


_REQUESTS = """requests AS (SELECT 'c' || user_id % 40 AS client, event_id, ts, CASE event_type WHEN 'click' THEN '/auth/login' WHEN 'view' THEN '/chat/stream/' || event_id
WHEN 'error' THEN '/citations' WHEN 'purchase' THEN '/documents' ELSE '/health' END AS path FROM events),
routed AS (SELECT *, CASE WHEN starts_with(path, '/auth/login') THEN '/auth/login' WHEN starts_with(path, '/chat/stream') THEN '/chat/stream' WHEN starts_with(path, '/citations') THEN '/citations' ELSE 'default' END AS route FROM requests WHERE path <> '/health')"""


@query(f"""WITH RECURSIVE {_REQUESTS}, e AS (SELECT client, route, event_id, epoch_us(ts) AS us, CASE route WHEN '/auth/login' THEN 10 WHEN '/chat/stream' THEN 30 WHEN '/citations' THEN 300 ELSE 60 END / 60.0 / 3600 AS rate,
row_number() OVER (PARTITION BY client, route ORDER BY ts, event_id) AS n FROM routed),
f(client, route, event_id, n, us, before) AS (SELECT client, route, event_id, n, us, CAST(2 AS DOUBLE) FROM e WHERE n = 1 UNION ALL
SELECT e.client, e.route, e.event_id, e.n, e.us, least(2.0, (CASE WHEN f.before >= 1 THEN f.before - 1 ELSE f.before END) + (e.us - f.us) / 1e6 * e.rate) FROM f JOIN e ON e.client = f.client AND e.route = f.route AND e.n = f.n + 1)
SELECT client, route, event_id, before >= 1 AS allowed FROM f""")
def route_limits(spark, sf_dir):
    """Requests that the buckets of their clients and routes allow; hours stand for seconds, as events are far apart."""
    rows = load(spark, sf_dir, "events").selectExpr(
        "concat('c', user_id % 40) client", "event_id", "ts",
        "case event_type when 'click' then '/auth/login' when 'view' then concat('/chat/stream/', event_id) when 'error' then '/citations' when 'purchase' then '/documents' else '/health' end path",
    )
    return state.limited_by_route(rows, state.Limits(burst=2.0, unit=3600)).drop("retry_after")


@query("""WITH typed AS (SELECT event_id // 10 AS stream_id, (event_id * 7) % 10 AS seq, CASE event_type WHEN 'click' THEN 'text_delta' WHEN 'view' THEN 'tool_call' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'cost_summary' ELSE 'thinking_delta' END AS kind, props AS content, value AS cost FROM events WHERE event_id % 13 <> 5),
ends AS (SELECT stream_id, min(seq) AS last FROM typed WHERE kind IN ('done', 'error') GROUP BY 1), r AS (SELECT typed.*, last FROM typed LEFT JOIN ends USING (stream_id) WHERE last IS NULL OR seq <= last)
SELECT stream_id, CASE WHEN min(last) IS NULL THEN 'timeout' ELSE max_by(kind, seq) END AS status, coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE kind = 'text_delta'), '') AS answer,
coalesce(string_agg(content, '' ORDER BY seq) FILTER (WHERE kind = 'thinking_delta'), '') AS thinking, CAST(count(*) FILTER (WHERE kind = 'tool_call') AS INTEGER) AS n_tools,
max_by(cost, seq) FILTER (WHERE kind = 'cost_summary') AS cost, CAST(count(*) AS BIGINT) AS n_events, CAST(max(seq) + 1 - count(*) AS BIGINT) AS missing FROM r GROUP BY 1""")
def folded_event_streams(spark, sf_dir):
    """Streams of typed events, some with gaps, each as one row."""
    rows = load(spark, sf_dir, "events").where("event_id % 13 <> 5").selectExpr(
        "event_id div 10 stream_id", "event_id * 7 % 10 seq",
        "case event_type when 'click' then 'text_delta' when 'view' then 'tool_call' when 'purchase' then 'done' when 'error' then 'cost_summary' else 'thinking_delta' end kind",
        "props content", "value cost", "ts",
    )
    twice = rows.unionByName(rows.where("seq % 3 = 0"))  # repeats change nothing
    return state.folded(twice).withColumn("n_tools", F.size("tools")).drop("tools")


_ASKED = "(SELECT CAST(user_id % 20 AS VARCHAR) AS cache, CAST(event_id * 7919 % 37 * (1 + event_id % 3) AS VARCHAR) AS key, event_id AS ask_id, ts FROM events)"
_ASKS = "cast(user_id % 20 as string) cache", "cast(event_id * 7919 % 37 * (1 + event_id % 3) as string) key", "event_id ask_id", "ts"


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY ts, ask_id) AS n FROM {_ASKED}), p AS (SELECT *, lag(n) OVER (PARTITION BY cache, key ORDER BY n) AS before FROM a),
h AS (SELECT p.cache, p.ask_id, p.before IS NOT NULL AND count(DISTINCT b.key) FILTER (WHERE b.n > p.before) < 25 AS hit FROM p LEFT JOIN a b ON b.cache = p.cache AND b.n > p.before AND b.n < p.n GROUP BY p.cache, p.ask_id, p.before)
SELECT cache, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 3) AS hit_rate FROM h GROUP BY 1""")
def cache_rates(spark, sf_dir):
    """Hit rates of caches of 25 values that drop what was used longest ago."""
    return caches.hit_rates(caches.cache_hits(load(spark, sf_dir, "events").selectExpr(*_ASKS), 25))


@query(f"""WITH RECURSIVE a AS (SELECT cache, key, ask_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY cache, key ORDER BY ts, ask_id) AS n FROM {_ASKED}),
f(cache, key, n, ask_id, hit, since) AS (SELECT cache, key, n, ask_id, false, us FROM a WHERE n = 1 UNION ALL
SELECT a.cache, a.key, a.n, a.ask_id, a.us < f.since + 86400000000, CASE WHEN a.us < f.since + 86400000000 THEN f.since ELSE a.us END FROM f JOIN a ON a.cache = f.cache AND a.key = f.key AND a.n = f.n + 1)
SELECT cache, ask_id, hit FROM f""")
def cache_lifetimes(spark, sf_dir):
    """What caches answer whose values live for a day."""
    return caches.cache_hits(load(spark, sf_dir, "events").selectExpr(*_ASKS), None, caches.SECONDS)


@query("""WITH c AS (SELECT user_id, event_id, event_type = 'error' AS f, lag(event_type = 'error', 1, false) OVER w AS f1, lag(event_type = 'error', 2, false) OVER w AS f2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM c WHERE (f AND f1) OR (f1 AND f2)""")
def early_stops(spark, sf_dir):
    """Calls at which two failures in a row stand among the last three."""
    rows = load(spark, sf_dir, "events")
    return state.repeated_failures(rows, "user_id", ["ts", "event_id"], "event_type = 'error'").where("stop").select("user_id", "event_id")
