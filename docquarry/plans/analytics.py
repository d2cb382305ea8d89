"""Costs, evaluation counts and spread of measurements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators.evaluation import confusion, ratio, spread
from docquarry.plans.registry import query
from docquarry.sources import load

#: Prices by operation: per million tokens in and out. Reads of the cache cost a tenth, writes a
#: quarter more.
PRICES = {"click": (1.0, 5.0), "view": (3.0, 15.0), "purchase": (2.5, 10.0), "error": (0.15, 0.6)}
_VALUES = ", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in PRICES.items())
_USAGE = f"""usage AS (SELECT event_id, ts, event_type AS operation, CAST(floor(value * 100) AS BIGINT) AS tokens_in,
CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens_out FROM events), price(operation, p_in, p_out) AS (VALUES {_VALUES})"""


def _usage(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "event_type operation", "cast(floor(value * 100) as bigint) tokens_in",
        "cast(get_json_object(props, '$.k') as bigint) tokens_out",
    )


def _prices(spark):
    return F.broadcast(spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "operation string, p_in double, p_out double"))


@query(f"""WITH {_USAGE} SELECT operation, CAST(count(*) AS BIGINT) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
round(sum(tokens_in * coalesce(p_in, 0) + tokens_out * coalesce(p_out, 0)) / 1e6, 6) AS cost FROM usage LEFT JOIN price USING (operation) GROUP BY operation""")
def cost_breakdown(spark, sf_dir):
    rows = _usage(spark, sf_dir).join(_prices(spark), "operation", "left")
    return rows.groupBy("operation").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.expr("round(sum(tokens_in * coalesce(p_in, 0D) + tokens_out * coalesce(p_out, 0D)) / 1e6D, 6) cost"),
    )


@query(f"""WITH {_USAGE} SELECT operation, round(sum(0.9 * p_in * tokens_out) / 1e6, 8) AS saved, CAST(trunc(sum(tokens_out) * 0.1) AS BIGINT) AS billed
FROM usage JOIN price USING (operation) GROUP BY operation""")
def cache_savings(spark, sf_dir):
    rows = _usage(spark, sf_dir).join(_prices(spark), "operation")
    return rows.groupBy("operation").agg(
        F.expr("round(sum(0.9D * p_in * tokens_out) / 1e6D, 8) saved"), F.expr("cast(sum(tokens_out) * 0.1 as bigint) billed")
    )


@query(f"""WITH {_USAGE}, days AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM usage GROUP BY 1),
run AS (SELECT day, CAST(sum(tokens) OVER (ORDER BY day) AS BIGINT) AS total FROM days)
SELECT day, total, CAST(total - coalesce(lag(total) OVER (ORDER BY day), 0) AS BIGINT) AS delta FROM run""")
def session_delta(spark, sf_dir):
    days = _usage(spark, sf_dir).groupBy(F.expr("cast(cast(ts as date) as string) day")).agg(F.sum("tokens_in").alias("tokens"))
    w = Window.partitionBy(F.lit(1)).orderBy("day")  # a row for each day
    run = days.select("day", F.sum("tokens").over(w).alias("total"))
    return run.select("day", "total", (F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))).alias("delta"))


@query(f"""WITH {_USAGE} SELECT DISTINCT operation FROM usage WHERE operation NOT IN (SELECT operation FROM price)""")
def pricing_coverage(spark, sf_dir):
    return _usage(spark, sf_dir).select("operation").distinct().join(_prices(spark), "operation", "left_anti")


_CONF = """count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn,
count(*) FILTER (WHERE NOT e AND NOT p) AS tn, count(*) FILTER (WHERE p IS NULL) AS abstained"""
_JUDGED = "(SELECT quality = 1 AS e, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE toxic = 0 END AS p, doc_id FROM labels)"


@query(f"""SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) AS accuracy FROM (SELECT {_CONF} FROM {_JUDGED})""")
def confusion_matrix(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").selectExpr("quality = 1 e", "if(doc_id % 7 = 0, null, toxic = 0) p")
    return confusion(rows, "e", "p")


@query("""WITH t AS (SELECT lang, source, quality FROM labels JOIN documents USING (doc_id))
SELECT lang, source, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS accuracy FROM t GROUP BY GROUPING SETS ((lang), (source), ())""")
def splits_grouping_sets(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    lang, source = F.col("lang"), F.col("source")
    return rows.groupingSets([[lang], [source], []], lang, source).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"))


@query("""SELECT source, CAST(count(*) FILTER (WHERE quality = 0) AS BIGINT) AS wrong, CAST(count(*) AS BIGINT) AS total
FROM labels JOIN documents USING (doc_id) GROUP BY source ORDER BY wrong DESC, total DESC, source LIMIT 10""")
def worst_k(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    counted = rows.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("wrong"), F.count("*").alias("total"))
    return counted.orderBy(F.desc("wrong"), F.desc("total"), "source").limit(10)


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, round(coalesce(stddev_samp(value), 0), 6) AS std_samp,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def percentile_stats(spark, sf_dir):
    return spread(load(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH g AS (SELECT p_type AS kind, count(*) AS truth, count(*) FILTER (WHERE p_size > 25) AS hit FROM part GROUP BY 1),
p AS (SELECT p_type AS kind, count(*) AS found FROM part WHERE p_size > 20 GROUP BY 1)
SELECT coalesce(g.kind, p.kind) AS kind, round(coalesce(hit / nullif(found, 0), 0), 4) AS precision, round(coalesce(hit / nullif(truth, 0), 0), 4) AS recall FROM g FULL OUTER JOIN p ON g.kind = p.kind""")
def prf_by_type(spark, sf_dir):
    rows = load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(
        F.count("*").alias("truth"), F.count_if(F.col("p_size") > 25).alias("hit"), F.count_if(F.col("p_size") > 20).alias("found")
    )
    return rows.select("kind", ratio(F.col("hit"), F.col("found")).alias("precision"), ratio(F.col("hit"), F.col("truth")).alias("recall"))


@query("""SELECT user_id, round(coalesce(max(value) FILTER (WHERE event_type = 'click'), 0), 6) AS click, round(coalesce(max(value) FILTER (WHERE event_type = 'error'), 0), 6) AS error FROM events GROUP BY user_id""")
def feedback_pivot(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error"]).agg(F.max("value"))
    return rows.select("user_id", F.round(F.coalesce("click", F.lit(0.0)), 6).alias("click"), F.round(F.coalesce("error", F.lit(0.0)), 6).alias("error"))


@query("""SELECT a.event_type AS event_type, round((b.m - a.m) / nullif(a.m, 0) * 100, 4) AS delta_pct FROM
(SELECT event_type, avg(value) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT event_type, avg(value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1) b USING (event_type)""")
def ab_delta(spark, sf_dir):
    a, b = F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value")))
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.round((b - a) / F.nullif(a, F.lit(0.0)) * 100, 4).alias("delta_pct"))


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS errors, round(avg(value), 6) AS mean_value,
round(100.0 * (count(*) - count(*) FILTER (WHERE event_type = 'error')) / count(*), 4) AS success_pct FROM events GROUP BY user_id""")
def tool_stats(spark, sf_dir):
    errors = F.count_if(F.col("event_type") == "error")
    return load(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("calls"), errors.alias("errors"), F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(100.0 * (F.count("*") - errors) / F.count("*"), 4).alias("success_pct"),
    )


@query("""SELECT source, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality = 1 THEN 0.5 WHEN toxic = 0 THEN 0.25 ELSE 0 END), 3) AS score,
CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS BIGINT) AS met FROM labels JOIN documents USING (doc_id) GROUP BY source""")
def compliance_score(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    status = F.expr("case when quality = 1 and toxic = 0 then 'MET' when quality = 1 then 'PARTIAL' when toxic = 0 then 'UNCLEAR' else 'UNMET' end")
    weight = F.expr("case status when 'MET' then 1D when 'PARTIAL' then 0.5D when 'UNCLEAR' then 0.25D else 0D end")
    return rows.withColumn("status", status).groupBy("source").agg(F.round(F.avg(weight), 3).alias("score"), F.count_if(F.col("status") == "MET").alias("met"))


@query("""SELECT p_name, CAST(count(DISTINCT p_type) AS BIGINT) AS docs, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS kinds FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1""")
def cross_document_groups(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy("p_name").agg(
        F.countDistinct("p_type").alias("docs"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds")
    ).where("docs > 1")
