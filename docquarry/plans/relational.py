"""Relational application queries: conversations, users with spending, documents, upserts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.operators.entities import resolved_edges, upserted
from docquarry.operators.graph import last_rows
from docquarry.plans.registry import query
from docquarry.sources import load


@query("""SELECT c.conv_id AS conv_id, CAST(count(m.turn) AS BIGINT) AS message_count FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN conversations m ON m.conv_id = c.conv_id AND m.role = 'user' GROUP BY c.conv_id""")
def conversation_counts(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    # one pass: counting the matching messages of a group is the left join and its count
    return rows.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("message_count"))


@query("""SELECT c_custkey AS user_id, CAST(count(o_orderkey) AS BIGINT) AS conversations, max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' GROUP BY 1""")
def user_conversations(spark, sf_dir):
    """Users with the number of their conversations, 0 for none, and the latest: counted before the join."""
    own = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("user_id"))
    own = own.agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    users = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return users.join(own, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("conversations"), "latest")


@query("""SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS users, CAST((SELECT count(*) FROM orders) AS BIGINT) AS conversations,
CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS messages,
round((SELECT count(*) FROM orders) / greatest((SELECT count(*) FROM customer), 1), 4) AS per_user,
round((SELECT count(*) FROM lineitem) / greatest((SELECT count(*) FROM orders), 1), 4) AS per_conversation""")
def system_stats(spark, sf_dir):
    names = {"customer": "users", "orders": "conversations", "lineitem": "messages"}
    counted = None
    for table, name in names.items():
        own = load(spark, sf_dir, table).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counted = own if counted is None else counted.unionByName(own)
    row = counted.agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names.values()])
    return row.select(
        "*", F.expr("round(conversations / greatest(users, 1), 4) per_user"),
        F.expr("round(messages / greatest(conversations, 1), 4) per_conversation"),
    )


@query("""SELECT source, coalesce(min(lang), 'none') AS category, CAST(count(*) AS BIGINT) AS pages, min(doc_id) AS first_id,
CAST(count(DISTINCT lang) AS BIGINT) AS langs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source""")
def doc_overview(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(
        F.coalesce(F.min("lang"), F.lit("none")).alias("category"), F.count("*").alias("pages"),
        F.min("doc_id").alias("first_id"), F.countDistinct("lang").alias("langs"), F.sum("n_chars").alias("chars"),
    )


@query("SELECT p_type AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands FROM part GROUP BY p_type")
def type_histogram(spark, sf_dir):
    return load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind")).agg(
        F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands")
    )


@query("SELECT DISTINCT source, lang FROM documents")
def document_list(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100")
def paging(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rows.orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50)


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r > 3""")
def truncate_messages(spark, sf_dir):
    """What goes when a conversation is cut behind its third message."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("r")).where("r > 3").drop("r")


@query("""SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
def last_n_history(spark, sf_dir):
    return last_rows(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", [F.desc("turn")], 6)


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r,
row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 7 OR r = 1 OR d <= 6""")
def keep_first_last(spark, sf_dir):
    up, down, whole = (
        Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn")), Window.partitionBy("conv_id"),
    )
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = rows.withColumns({"r": F.row_number().over(up), "d": F.row_number().over(down), "n": F.count("*").over(whole)})
    return rows.where("n <= 7 or r = 1 or d <= 6").select("conv_id", "turn")


@query("""SELECT conv_id, turn, role = 'assistant' AND d > 2 AS prune, CAST(ceil(greatest(length(text), 1) / 4.0) AS INTEGER) AS tokens FROM (
SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS d FROM conversations)""")
def protect_last_results(spark, sf_dir):
    """Assistant messages but the last two of a conversation may be pruned."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    rows = load(spark, sf_dir, "conversations")
    d = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w)
    return rows.select("conv_id", "turn", ((F.col("role") == "assistant") & (d > 2)).alias("prune"), T.estimated_tokens("text").alias("tokens"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem)
SELECT a.doc AS doc, a.page AS page, b.page AS neighbour, CASE WHEN b.page < a.page THEN 'before' ELSE 'after' END AS side
FROM p a JOIN p b ON a.doc = b.doc AND b.page BETWEEN a.page - 2 AND a.page + 2 AND b.page <> a.page""")
def adjacent_band(spark, sf_dir):
    """Pages of the same document whose numbers are within two: each page asks for four numbers, an equality join."""
    pages = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey doc", "l_linenumber page").distinct()
    asked = pages.selectExpr("doc", "page", "explode(array(page - 2, page - 1, page + 1, page + 2)) neighbour")
    there = pages.withColumnRenamed("page", "neighbour")
    return asked.join(there, ["doc", "neighbour"]).selectExpr("doc", "page", "neighbour", "if(neighbour < page, 'before', 'after') side")


@query("""WITH asked AS (SELECT o_orderkey AS ask, CASE WHEN o_orderkey % 2 = 0 THEN 'part_' || CAST(o_orderkey AS VARCHAR) ELSE 'part_p' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(3, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') END AS cite FROM orders),
pages AS (SELECT p_partkey, p_name, 'part_p' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(3, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS page_id FROM part)
SELECT ask, coalesce(e.p_partkey, f.p_partkey) AS p_partkey, coalesce(e.p_name, f.p_name) AS p_name, CASE WHEN e.page_id IS NOT NULL THEN 'exact' WHEN f.page_id IS NOT NULL THEN 'parsed' END AS found
FROM asked LEFT JOIN pages e ON e.page_id = cite LEFT JOIN pages f ON f.p_partkey = CAST(regexp_extract(cite, '^(.+?)_(?:p)?(\\d+)$', 2) AS BIGINT)""")
def citations_fallback(spark, sf_dir):
    """Page ids in two forms, looked up exactly, or else by their parsed parts."""
    cite = F.expr("if(o_orderkey % 2 = 0, concat('part_', o_orderkey), format_string('part_p%03d', o_orderkey))")
    asked = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask"), cite.alias("cite"))
    pages = load(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "format_string('part_p%03d', p_partkey) page_id")
    asked = asked.withColumn("key", F.expr("cast(regexp_extract(cite, '^(.+?)_(?:p)?(\\\\d+)$', 2) as bigint)"))
    exact = pages.selectExpr("page_id cite", "p_partkey k1", "p_name n1")
    fuzzy = pages.selectExpr("p_partkey key", "p_partkey k2", "p_name n2")
    found = asked.join(exact, "cite", "left").join(fuzzy, "key", "left")
    return found.selectExpr(
        "ask", "coalesce(k1, k2) p_partkey", "coalesce(n1, n2) p_name", "case when k1 is not null then 'exact' when k2 is not null then 'parsed' end found"
    )


@query("""SELECT c_custkey AS user_id, CAST(500 AS DOUBLE) AS spending_limit, round(coalesce(sum(o_totalprice), 0) / 10000, 2) AS spent,
round(greatest(0, 500.0 - coalesce(sum(o_totalprice), 0) / 10000), 2) AS remaining FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def spending_status(spark, sf_dir):
    spent = load(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.sum("o_totalprice") / 10000).alias("s"))
    rows = load(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.selectExpr(
        "c_custkey user_id", "500D spending_limit", "round(coalesce(s, 0D), 2) spent",
        "round(greatest(0D, 500D - coalesce(s, 0D)), 2) remaining",
    )


@query("""SELECT n_nationkey, n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)""")
def insert_ignore(spark, sf_dir):
    """Rows that an insert adds when keys that exist are ignored."""
    there = load(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return load(spark, sf_dir, "nation").join(there, "n_nationkey", "left_anti").select("n_nationkey", "n_name")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name, coalesce(b.descr, a.descr) AS descr,
array_to_string(list_sort(list_distinct(list_concat(coalesce(a.pages, []), coalesce(b.pages, [])))), ',') AS pages
FROM (SELECT p_partkey AS k, p_name AS name, p_brand AS descr, [p_size] AS pages FROM part WHERE p_size <= 35) a
FULL OUTER JOIN (SELECT p_partkey AS k, upper(p_name) AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS descr, [p_size, p_size + 1] AS pages FROM part WHERE p_size > 15) b
ON a.k = b.k""")
def entity_upsert(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    base = part.where("p_size <= 35").selectExpr("p_partkey k", "p_name name", "p_brand descr", "array(p_size) pages")
    new = part.where("p_size > 15").selectExpr(
        "p_partkey k", "upper(p_name) name", "if(p_partkey % 3 = 0, p_type, null) descr", "array(p_size, p_size + 1) pages"
    )
    return upserted(base, new, ["k"], ["name"], ["descr"], ["pages"]).withColumn("pages", F.array_join("pages", ","))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flagged, event_id % 2 = 0 AS patched FROM events""")
def metadata_merge(spark, sf_dir):
    """JSON metadata with a patch laid over it: keys of the patch win."""
    rows = load(spark, sf_dir, "events")
    base = F.from_json("props", "map<string,string>")
    patch = F.create_map(F.lit("flag"), F.when(F.col("event_type") == "error", "1").otherwise("0"), F.lit("patched"), (F.col("event_id") % 2 == 0).cast("string"))
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(patch, k))
    both = F.map_concat(kept, patch)
    return rows.select("event_id", both.alias("m")).selectExpr(
        "event_id", "cast(m['k'] as int) k", "cast(m['flag'] as int) flagged", "cast(m['patched'] as boolean) patched"
    )


@query("""WITH names AS (SELECT p_partkey AS entity_id, p_type AS document_id, p_name AS name FROM part WHERE p_size <= 25),
edges AS (SELECT a.p_partkey AS relationship_id, a.p_type AS document_id, a.p_name AS source_name, CASE WHEN a.p_partkey % 5 = 0 THEN 'nobody' ELSE b.p_name END AS target_name, a.p_brand AS kind
  FROM part a JOIN part b ON b.p_partkey = (a.p_partkey * 7 + 1) % (SELECT count(*) FROM part))
SELECT relationship_id, coalesce(s.own, sa.other) AS source, coalesce(t.own, ta.other) AS target, kind FROM edges e
LEFT JOIN (SELECT document_id, name, min(entity_id) AS own FROM names GROUP BY 1, 2) s ON s.document_id = e.document_id AND s.name = e.source_name
LEFT JOIN (SELECT name, min(entity_id) AS other FROM names GROUP BY 1) sa ON sa.name = e.source_name
LEFT JOIN (SELECT document_id, name, min(entity_id) AS own FROM names GROUP BY 1, 2) t ON t.document_id = e.document_id AND t.name = e.target_name
LEFT JOIN (SELECT name, min(entity_id) AS other FROM names GROUP BY 1) ta ON ta.name = e.target_name
WHERE coalesce(s.own, sa.other) IS NOT NULL AND coalesce(t.own, ta.other) IS NOT NULL""")
def edge_resolution(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    names = part.where("p_size <= 25").selectExpr("p_partkey entity_id", "p_type document_id", "p_name name")
    counted = part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n"))))  # one row
    a = counted.selectExpr("p_partkey relationship_id", "p_type document_id", "p_name source_name", "p_brand kind", "(p_partkey * 7 + 1) % n other")
    b = part.selectExpr("p_partkey other", "p_name target")
    edges = a.join(b, "other").selectExpr("relationship_id", "document_id", "source_name", "if(relationship_id % 5 = 0, 'nobody', target) target_name", "kind")
    return resolved_edges(edges, names)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def delete_cascade(spark, sf_dir):
    """What is left of lineitem when the orders of one status and their lines are deleted."""
    gone = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return load(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""SELECT event_id FROM events WHERE json_extract_string(props, '$.summary') IS NULL AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 10""")
def json_path_missing(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("get_json_object(props, '$.summary') is null and cast(get_json_object(props, '$.k') as int) < 10")
    return rows.select("event_id")


@query("""SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""")
def active_24h(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    seen = rows.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    latest = rows.agg(F.max("ts")).first()[0]
    return seen.where(F.col("last_seen") > F.lit(latest).cast("timestamp_ntz") - F.expr("interval 24 hours"))


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang""")
def corpus_digest(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")
    )


@query("""SELECT conv_id, left(text, 60) AS title FROM conversations c WHERE turn = 0 AND role = 'user' AND (SELECT count(*) FROM conversations m WHERE m.conv_id = c.conv_id) <= 4""")
def title_candidates(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    few = rows.groupBy("conv_id").count().where("count <= 4").select("conv_id")
    return rows.where("turn = 0 and role = 'user'").join(few, "conv_id", "left_semi").selectExpr("conv_id", "left(text, 60) title")


@query("""SELECT c_custkey, c_name, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'VIP' END, c_mktsegment) AS segment,
CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer""")
def partial_update(spark, sf_dir):
    """The state after a patch that sets some columns of some rows."""
    rows = load(spark, sf_dir, "customer")
    patch = rows.selectExpr("c_custkey", "if(c_custkey % 4 = 0, 'VIP', null) segment", "if(c_custkey % 10 = 0, 0D, null) balance").where("segment is not null or balance is not null")
    both = rows.join(patch, "c_custkey", "left")
    return both.selectExpr("c_custkey", "c_name", "coalesce(segment, c_mktsegment) segment", "coalesce(balance, c_acctbal) balance")


@query("""SELECT p_brand, p_partkey, p_name FROM (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 5""")
def top_slice(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice")
    return last_rows(rows, "p_brand", [F.desc("p_retailprice"), "p_partkey"], 5).drop("p_retailprice")


@query("""SELECT 'documents' AS t, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events""")
def index_stats(spark, sf_dir):
    out = None
    for name in ("documents", "pages", "events"):
        own = load(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n")
        out = own if out is None else out.unionByName(own)
    return out
