"""Accounts and conversations: customers stand for users, orders for what they own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators import mutation
from docquarry.plans.registry import query
from docquarry.sources import load

_MAIL = "lower(replace(c_name, '#', '.')) || '@example.org'"


@query(f"""SELECT 'mail' AS found_by, c_custkey, c_name FROM customer WHERE {_MAIL} = 'customer.000000007@example.org'
UNION ALL SELECT 'id', c_custkey, c_name FROM customer WHERE c_custkey = 11
UNION ALL SELECT 'active id', c_custkey, c_name FROM customer WHERE c_custkey = 11 AND c_acctbal > 0""")
def user_lookup(spark, sf_dir):
    """One user by mail address, by id, and by id only if active."""
    rows = load(spark, sf_dir, "customer")
    by = {"mail": f"{_MAIL} = 'customer.000000007@example.org'", "id": "c_custkey = 11", "active id": "c_custkey = 11 and c_acctbal > 0"}
    parts = [rows.where(test).select(F.lit(name).alias("found_by"), "c_custkey", "c_name") for name, test in by.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("""SELECT c_custkey, CASE WHEN asked IN ('remote', 'local') THEN asked ELSE coalesce(old, 'remote') END AS variant FROM (
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'local' END AS old, CASE c_custkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'cloudy' END AS asked FROM customer)""")
def agent_variants(spark, sf_dir):
    """Variants after a change: only known ones are taken, and users without one have `remote`."""
    old = F.when(F.col("c_custkey") % 3 == 0, "local")
    asked = F.when(F.col("c_custkey") % 4 == 0, "remote").when(F.col("c_custkey") % 4 == 1, "cloudy")
    taken = F.when(asked.isin("remote", "local"), asked)
    return load(spark, sf_dir, "customer").select("c_custkey", F.coalesce(taken, old, F.lit("remote")).alias("variant"))


@query("""WITH spent AS (SELECT o_custkey AS user_id, sum(o_totalprice) / 10000 AS s FROM orders GROUP BY 1),
asked AS (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT -1 - n_nationkey FROM nation)
SELECT a.user_id AS user_id, coalesce(c.c_custkey IS NOT NULL AND coalesce(s, 0) < 150, false) AS allowed FROM asked a
LEFT JOIN customer c ON c.c_custkey = a.user_id LEFT JOIN spent ON spent.user_id = a.user_id""")
def check_limit(spark, sf_dir):
    """Whether a user may spend more; users that aren't known may not."""
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    strangers = load(spark, sf_dir, "nation").selectExpr("cast(-1 - n_nationkey as bigint) user_id")
    spent = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg((F.sum("o_totalprice") / 10000).alias("s"))
    known = users.withColumn("known", F.lit(True))
    rows = users.unionAll(strangers).join(known, "user_id", "left").join(spent, "user_id", "left")
    return rows.select("user_id", F.coalesce(F.col("known") & (F.coalesce("s", F.lit(0.0)) < 150), F.lit(False)).alias("allowed"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS spent, c_nationkey = 3 AS was_reset FROM customer""")
def reset_spending(spark, sf_dir):
    hit = F.col("c_nationkey") == 3
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(hit, 0.0).otherwise(F.col("c_acctbal")).alias("spent"), hit.alias("was_reset"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0""")
def user_delete_cascade(spark, sf_dir):
    """Messages that are left when users and all they own are deleted, over two levels."""
    gone = load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    owned = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(users, "o_custkey", "left_semi").join(gone, "o_custkey", "left_anti")
    owned = owned.select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(owned, "l_orderkey", "left_semi")


@query("""SELECT c_custkey, c_nationkey, (SELECT count(*) FROM customer o WHERE o.c_nationkey = c.c_nationkey AND o.c_mktsegment = 'MACHINERY' AND o.c_custkey <> c.c_custkey) = 0 AS last_admin
FROM customer c WHERE c_mktsegment = 'MACHINERY'""")
def last_admin(spark, sf_dir):
    """Whether an administrator is the last one of its group."""
    admins = load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_nationkey")
    counts = admins.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return admins.join(counts, "c_nationkey").select("c_custkey", "c_nationkey", (F.col("n") == 1).alias("last_admin"))


@query("SELECT conv_id, turn, role, left(text, 30) AS head FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 50")
def history_of(spark, sf_dir):
    """The first messages of one conversation, oldest first."""
    rows = load(spark, sf_dir, "conversations").where("conv_id = 3")
    return rows.selectExpr("conv_id", "turn", "role", "left(text, 30) head").orderBy("turn").limit(50)


@query("""SELECT user_id, event_type, CAST(arg_min(CASE WHEN value > 100 THEN 1 ELSE 0 END, event_id) AS DOUBLE) AS score FROM events GROUP BY user_id, event_type""")
def feedback_once(spark, sf_dir):
    """The first verdict of a user on a thing counts, later ones are refused; -1 and 1 become 0 and 1."""
    sign = F.when(F.col("value") > 100, 1).otherwise(-1)
    first = F.min_by(sign, "event_id")
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(((first + 1) / 2).alias("score"))


@query("""SELECT c_custkey AS user_id, o_orderkey AS conv_id, o_orderkey IN (SELECT o_orderkey FROM orders x WHERE x.o_custkey = c_custkey) AS owns
FROM customer JOIN orders ON o_custkey % 7 = c_custkey % 7 AND o_orderkey = c_custkey * 5""")
def ownership(spark, sf_dir):
    """Whether the user who asks owns the conversation."""
    asked = load(spark, sf_dir, "customer").selectExpr("c_custkey user_id", "c_custkey * 5 conv_id")
    owners = load(spark, sf_dir, "orders").selectExpr("o_orderkey conv_id", "o_custkey")
    rows = asked.join(owners, "conv_id").where("o_custkey % 7 = user_id % 7")
    return rows.select("user_id", "conv_id", (F.col("o_custkey") == F.col("user_id")).alias("owns"))


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size = 10")
def optional_filters(spark, sf_dir):
    """All of the optional conditions that are given; a brand isn't."""
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    return mutation.matching(rows, p_type=["ECONOMY", "PROMO"], p_size=10, p_brand=None).drop("p_brand")


@query("SELECT doc_id, source FROM documents WHERE doc_id = ANY([1, 5, 9, 144])")
def any_of(spark, sf_dir):
    return mutation.matching(load(spark, sf_dir, "documents").select("doc_id", "source"), doc_id=[1, 5, 9, 144])


@query("SELECT p_partkey, upper(p_type) AS kind FROM part WHERE upper(p_type) IN ('STANDARD', 'LARGE', 'SMALL') AND (lower(p_name) LIKE '%widget%' OR lower(p_brand) LIKE '%#1%')")
def keyword_whitelist(spark, sf_dir):
    """Rows of listed kinds whose name or description holds a keyword, whatever the case."""
    found = F.contains(F.lower("p_name"), F.lit("widget")) | F.contains(F.lower("p_brand"), F.lit("#1"))
    kind = F.upper("p_type").alias("kind")
    return load(spark, sf_dir, "part").select("p_partkey", kind, found.alias("f")).where(F.col("kind").isin("STANDARD", "LARGE", "SMALL") & F.col("f")).drop("f")


@query("""SELECT n_nationkey, n_name FROM nation UNION ALL
SELECT CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name) AS INTEGER), name FROM (SELECT DISTINCT 'LAND ' || c_mktsegment AS name FROM customer)""")
def insert_with_ids(spark, sf_dir):
    """New rows get the ids that follow."""
    base = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = load(spark, sf_dir, "customer").selectExpr("concat('LAND ', c_mktsegment) n_name").distinct()
    return mutation.appended(base, new, "n_nationkey", ["n_name"])


@query("""SELECT n_nationkey, n_name FROM nation UNION ALL SELECT s_suppkey, min(s_name) FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY s_suppkey""")
def insert_or_ignore(spark, sf_dir):
    """The whole table after an insert that ignores keys which are there."""
    base = load(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) n_nationkey", "n_name")
    new = load(spark, sf_dir, "supplier").selectExpr("s_suppkey n_nationkey", "s_name n_name")
    return mutation.inserted(base, new, ["n_nationkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <= 3")
def delete_tail_pages(spark, sf_dir):
    """What is left when pages beyond the new last one go."""
    return load(spark, sf_dir, "lineitem").where("not coalesce(l_linenumber > 3, false)").select("l_orderkey", "l_linenumber")


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE NOT coalesce(o_orderstatus = 'F', false)) AS BIGINT) AS remaining FROM orders")
def counted_delete(spark, sf_dir):
    return mutation.counted_delete(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


@query("""SELECT 'nodes' AS what, p_type AS key, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type UNION ALL SELECT 'edges', p_brand, count(*) FROM part GROUP BY p_brand
UNION ALL SELECT 'per document', CAST(l_suppkey AS VARCHAR), count(DISTINCT l_partkey) FROM lineitem GROUP BY l_suppkey UNION ALL SELECT 'levels', CAST(p_size % 3 AS VARCHAR), count(*) FROM part GROUP BY p_size % 3""")
def graph_overview(spark, sf_dir):
    """Counts by type of node, type of edge, document and level."""
    part, lines = load(spark, sf_dir, "part"), load(spark, sf_dir, "lineitem")
    n = F.count("*").alias("n")
    parts = [
        ("nodes", part.groupBy(F.col("p_type").alias("key")).agg(n)),
        ("edges", part.groupBy(F.col("p_brand").alias("key")).agg(n)),
        ("per document", lines.groupBy(F.col("l_suppkey").cast("string").alias("key")).agg(F.countDistinct("l_partkey").alias("n"))),
        ("levels", part.groupBy((F.col("p_size") % 3).cast("string").alias("key")).agg(n)),
    ]
    out = None
    for what, rows in parts:
        rows = rows.select(F.lit(what).alias("what"), "key", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT source, CASE WHEN regexp_matches(source, '^src[12]') THEN 'legislation' ELSE 'documentation' END AS category, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2""")
def category_by_prefix(spark, sf_dir):
    """Documents by source, with the category that the start of the name gives."""
    category = F.when(F.rlike("source", F.lit("^src[12]")), "legislation").otherwise("documentation")
    return load(spark, sf_dir, "documents").groupBy("source", category.alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT doc_id, page FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, source FROM documents) WHERE source = 'src3' ORDER BY page LIMIT 40""")
def pages_of_document(spark, sf_dir):
    """Pages of one document by number, the first 40: the scan that extraction works through."""
    w = Window.partitionBy("source").orderBy("doc_id")
    rows = load(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", F.row_number().over(w).alias("page"))
    return rows.orderBy("page").limit(40)


@query("""SELECT doc_id, source, CAST(ceil(greatest(length(text), 1) / 4.0) AS INTEGER) AS tokens FROM documents WHERE lang = 'de' ORDER BY doc_id""")
def reembedding_scan(spark, sf_dir):
    """What is to be embedded anew: an optional filter on one column, in order, with no limit."""
    rows = mutation.matching(load(spark, sf_dir, "documents"), lang="de", source=None)
    return rows.select("doc_id", "source", T.estimated_tokens("text").alias("tokens")).orderBy("doc_id")


@query("""SELECT d.source AS source, coalesce(p.pages, 0) AS pages FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN (
SELECT 'src' || CAST(page_id % 7 AS VARCHAR) AS source, CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1) p USING (source)""")
def files_with_pages(spark, sf_dir):
    """Listed files with the number of pages that the tables know of."""
    files = load(spark, sf_dir, "documents").select("source").distinct()
    known = load(spark, sf_dir, "pages").groupBy(F.expr("concat('src', page_id % 7) source")).agg(F.count("*").alias("pages"))
    return files.join(known, "source", "left").select("source", F.coalesce("pages", F.lit(0)).alias("pages"))


@query("""SELECT regexp_extract(line, 'status=(\\d+)', 1) AS status, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'user=' || CAST(user_id AS VARCHAR) || ' status=' || CASE event_type WHEN 'error' THEN '401' WHEN 'signup' THEN '403' ELSE '200' END AS line FROM events) WHERE regexp_matches(line, 'status=(401|403)') GROUP BY 1""")
def denied_requests(spark, sf_dir):
    """Lines of an access log with a denied status, by status."""
    line = F.expr("concat('user=', user_id, ' status=', case event_type when 'error' then '401' when 'signup' then '403' else '200' end)")
    rows = load(spark, sf_dir, "events").select(line.alias("line")).where(F.rlike("line", F.lit("status=(401|403)")))
    return rows.groupBy(F.regexp_extract("line", r"status=(\d+)", 1).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 4 HOURS GROUP BY event_type""")
def log_lookback(spark, sf_dir):
    """Events of the last four hours."""
    rows = load(spark, sf_dir, "events").select("ts", "event_type")
    latest = F.broadcast(rows.agg((F.max("ts") - F.expr("interval 4 hours")).alias("since")))  # one row
    return rows.join(latest, F.col("ts") > F.col("since")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT '{"user":' || user_id || ',"calls":' || count(*) || ',"kinds":"' || string_agg(DISTINCT event_type, ',' ORDER BY event_type) || '"}' AS report FROM events GROUP BY user_id""")
def json_report(spark, sf_dir):
    """One JSON object for each user."""
    rows = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return rows.select(F.to_json(F.struct(F.col("user_id").alias("user"), "calls", "kinds")).alias("report"))
