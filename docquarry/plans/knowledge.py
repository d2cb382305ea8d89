"""Entities, communities and their evaluation: parts stand for entities, embeddings for their vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions.costs import call_cost
from docquarry.functions.vectors import cosine
from docquarry.operators import fulltext, graph
from docquarry.operators.evaluation import ratio
from docquarry.plans.registry import query
from docquarry.plans.shared import PART_COMMUNITIES, part_communities
from docquarry.sources import load


@query("""SELECT p_name AS name, left(array_to_string(list_transform(list_sort(list({'o': o, 'd': d})), lambda x: x.d), ' | '), 2000) AS description FROM (
SELECT p_name, p_brand AS d, min(p_partkey) AS o FROM part GROUP BY p_name, p_brand) GROUP BY p_name""")
def joined_descriptions(spark, sf_dir):
    """Different descriptions of a group in the order of their first row, joined and held to 2000 characters."""
    firsts = load(spark, sf_dir, "part").groupBy("p_name", F.col("p_brand").alias("d")).agg(F.min("p_partkey").alias("o"))
    whole = firsts.groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("o", "d"))).alias("l"))
    return whole.select("name", F.left(F.array_join("l.d", " | "), F.lit(2000)).alias("description"))


_CALLS = "CASE WHEN event_type = 'view' THEN 'tool_view' ELSE 'agent_' || event_type END AS agent, CAST(floor(value) AS BIGINT) AS i, user_id AS o, event_id % 100 AS r, event_id % 7 AS w, event_id % 1000 AS ms"


@query(f"""SELECT regexp_replace(agent, '^agent_', '') AS agent, CAST(count(*) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, CAST(sum(r) AS BIGINT) AS cache_read, CAST(sum(w) AS BIGINT) AS cache_creation,
CAST(sum(ms) AS BIGINT) AS response_ms, round(sum(i * 3.0 + o * 15.0 + r * 3.0 * 0.1 + w * 3.0 * 1.25) / 1e6, 6) AS cost FROM (SELECT {_CALLS} FROM events) WHERE starts_with(agent, 'agent_') GROUP BY 1 ORDER BY cost DESC""")
def agent_breakdown(spark, sf_dir):
    """All sums by agent, the most expensive first: operations with the prefix of agents, named without it."""
    rows = load(spark, sf_dir, "events").selectExpr(*_CALLS.replace("END AS", "END").replace(" AS agent", " agent").split(", "))
    rows = rows.where(F.startswith("agent", F.lit("agent_"))).groupBy(F.regexp_replace("agent", "^agent_", "").alias("agent"))
    cost = call_cost("i", "o", "r", "w", 3.0, 15.0)
    return rows.agg(
        F.count("*").alias("calls"), F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.sum("r").alias("cache_read"), F.sum("w").alias("cache_creation"),
        F.sum("ms").alias("response_ms"), F.round(F.sum(cost), 6).alias("cost"),
    ).orderBy(F.desc("cost"))


@query("""WITH expected AS (SELECT p_name AS name FROM part GROUP BY p_name HAVING count(DISTINCT p_type) > 1), merged AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 45)
SELECT CAST(count(*) AS BIGINT) AS expected, CAST(count(m.name) AS BIGINT) AS found, round(CAST(count(m.name) AS DOUBLE) / greatest(count(*), 1), 4) AS rate FROM expected LEFT JOIN merged m USING (name)""")
def dedup_merge_rate(spark, sf_dir):
    """How many of the groups that should be merged were."""
    part = load(spark, sf_dir, "part").withColumnRenamed("p_name", "name")
    expected = part.groupBy("name").agg(F.countDistinct("p_type").alias("n")).where("n > 1").select("name")
    merged = part.where("p_size > 45").select("name").distinct().withColumn("there", F.lit(1))
    both = expected.join(merged, "name", "left").agg(F.count("*").alias("expected"), F.count("there").alias("found"))
    return both.select("expected", "found", F.round(F.col("found") / F.greatest("expected", F.lit(1)), 4).alias("rate"))


_MATCHED = """CASE WHEN a.p_name = b.s THEN 'exact' WHEN lower(a.p_name) = lower(b.s) THEN 'case' WHEN b.s IS NULL THEN 'none' ELSE 'prefix' END"""


@query(f"""SELECT {_MATCHED} AS method, CAST(count(*) AS BIGINT) AS n FROM part a LEFT JOIN (SELECT p_partkey, CASE WHEN p_size > 30 THEN p_name WHEN p_size > 20 THEN upper(p_name) WHEN p_size > 10 THEN left(p_name, 4) END AS s FROM part) b USING (p_partkey) GROUP BY 1""")
def match_methods(spark, sf_dir):
    """How many rows each rule of matching took, the first rule that fits."""
    part = load(spark, sf_dir, "part")
    named = part.selectExpr("p_partkey", "case when p_size > 30 then p_name when p_size > 20 then upper(p_name) when p_size > 10 then left(p_name, 4) end s")
    method = F.when(F.col("p_name") == F.col("s"), "exact").when(F.lower("p_name") == F.lower("s"), "case").when(F.isnull("s"), "none").otherwise("prefix")
    return part.join(named, "p_partkey", "left").groupBy(method.alias("method")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS succeeded, round(coalesce(avg(value), 0), 4) AS mean_ms,
round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / greatest(count(*), 1), 2) AS success_pct,
round(100.0 * count(*) FILTER (WHERE value > 190) / greatest(count(*), 1), 2) AS invalid_pct FROM events""")
def execution_metrics(spark, sf_dir):
    """Totals, mean time and rates of tool calls; zeros where there are none."""
    ok, n = F.count_if(F.col("event_type") != "error"), F.greatest(F.count("*"), F.lit(1))
    return load(spark, sf_dir, "events").agg(
        F.count("*").alias("total"), ok.alias("succeeded"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean_ms"),
        F.round(100.0 * ok / n, 2).alias("success_pct"), F.round(100.0 * F.count_if(F.col("value") > 190) / n, 2).alias("invalid_pct"),
    )


@query("""SELECT p_partkey, p_name, p_type FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_name), p_type ORDER BY ord, p_partkey) AS r FROM (
SELECT p_partkey, p_name, p_type, 0 AS ord FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, upper(p_name), p_type, 1 FROM part)) WHERE r = 1""")
def first_wins(spark, sf_dir):
    """Two sources one behind the other; of rows of one name, whatever the case, and type the first stays."""
    part = load(spark, sf_dir, "part")
    one = part.where("p_size > 30").select("p_partkey", "p_name", "p_type", F.lit(0).alias("ord"))
    both = one.unionByName(part.select("p_partkey", F.upper("p_name").alias("p_name"), "p_type", F.lit(1).alias("ord")))
    first = F.min(F.struct("ord", "p_partkey", "p_name")).alias("f")
    return both.groupBy(F.lower("p_name").alias("k"), "p_type").agg(first).select("f.p_partkey", "f.p_name", "p_type")


_TWO = """SELECT p_partkey AS id1, p_partkey + 1 AS id2, 'name' AS source, 0 AS ord FROM part WHERE p_size > 20 UNION ALL
SELECT p_partkey, p_partkey + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END, 'words', 1 FROM part"""


@query(f"SELECT id1, id2, arg_min(source, ord) AS source FROM ({_TWO}) GROUP BY id1, id2")
def candidate_union(spark, sf_dir):
    """Candidate pairs of two sources; a pair that both have comes from the first."""
    part = load(spark, sf_dir, "part")
    one = part.where("p_size > 20").selectExpr("p_partkey id1", "p_partkey + 1 id2", "'name' source", "0 ord")
    two = part.selectExpr("p_partkey id1", "p_partkey + if(p_size % 2 = 0, 1, 2) id2", "'words' source", "1 ord")
    return one.unionByName(two).groupBy("id1", "id2").agg(F.min_by("source", "ord").alias("source"))


@query("""(SELECT 'both' AS what, p_name FROM (SELECT p_name FROM part WHERE p_size > 25 INTERSECT SELECT p_name FROM part WHERE p_size <= 25))
UNION ALL (SELECT 'only', p_name FROM (SELECT p_name FROM part WHERE p_size > 25 EXCEPT SELECT p_name FROM part WHERE p_size <= 25))""")
def set_operations(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    big, small = part.where("p_size > 25").select("p_name"), part.where("p_size <= 25").select("p_name")
    both, only = big.intersect(small), big.subtract(small)
    return both.select(F.lit("both").alias("what"), "p_name").unionAll(only.select(F.lit("only").alias("what"), "p_name"))


@query("""SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_type ORDER BY length(p_brand) DESC, length(p_name) DESC, p_partkey) AS INTEGER) AS place FROM part""")
def stable_order(spark, sf_dir):
    """The place of a row by the lengths of description and name, longest first; rows that tie keep their order."""
    w = Window.partitionBy("p_type").orderBy(F.desc(F.length("p_brand")), F.desc(F.length("p_name")), "p_partkey")
    return load(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(w).alias("place"))


@query("""SELECT id1, id2 FROM (SELECT a.p_partkey AS id1, b.p_partkey AS id2, lower(a.p_name) AS x, lower(b.p_name) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
WHERE x <> y AND NOT contains(x, y) AND NOT contains(y, x)""")
def telling_pairs(spark, sf_dir):
    """Candidate pairs without those that are equal after normalising or of which one holds the other."""
    part = load(spark, sf_dir, "part")
    a = part.select(F.col("p_partkey").alias("id1"), T.normalized_name("p_name").alias("x"))
    b = part.select((F.col("p_partkey") - 1).alias("id1"), F.col("p_partkey").alias("id2"), T.normalized_name("p_name").alias("y"))
    pairs = a.join(b, "id1").where("x <> y and not contains(x, y) and not contains(y, x)")
    return pairs.select("id1", "id2")


@query("""WITH g AS (SELECT lower(p_name) AS k, p_type AS t, arg_min(p_name, p_partkey) AS canon, min(p_partkey) AS id FROM (SELECT p_partkey, p_type, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name FROM part) GROUP BY 1, 2)
SELECT DISTINCT g.id AS canonical_id, d.brand AS alias FROM g JOIN (SELECT lower(p_name) AS k, p_type AS t, p_brand AS brand FROM part) d ON d.k = g.k AND d.t = g.t WHERE lower(d.brand) <> lower(g.canon)""")
def aliases(spark, sf_dir):
    """Names of duplicates become aliases of the row that stays, unless they are equal to its name whatever the case."""
    rows = load(spark, sf_dir, "part").selectExpr("p_partkey", "p_type t", "if(p_size > 25, upper(p_name), p_name) name", "p_brand brand")
    rows = rows.withColumn("k", F.lower("name"))
    canon = rows.groupBy("k", "t").agg(F.min_by("name", "p_partkey").alias("canon"), F.min("p_partkey").alias("canonical_id"))
    found = rows.join(canon, ["k", "t"]).where("lower(brand) <> lower(canon)")
    return found.select("canonical_id", F.col("brand").alias("alias")).distinct()


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'First' WHEN 'Brand#2' THEN 'Second' ELSE p_brand END AS brand FROM part""")
def alias_lookup(spark, sf_dir):
    """Aliases give way to their canonical names; the table of a fixed handful of names is broadcast."""
    table = spark.createDataFrame([("First", ["Brand#1"]), ("Second", ["Brand#2"])], "canon string, other array<string>")
    table = table.select("canon", F.explode("other").alias("p_brand"))
    rows = load(spark, sf_dir, "part").select("p_partkey", "p_brand").join(F.broadcast(table), "p_brand", "left")
    return rows.select("p_partkey", F.coalesce("canon", "p_brand").alias("brand"))


@query("""WITH RECURSIVE step AS (SELECT p_partkey AS a, p_partkey - CASE WHEN p_size > 10 THEN 1 ELSE 0 END AS b FROM part), links AS (SELECT a, b FROM step WHERE a <> b AND b >= 0),
walk(node, here) AS (SELECT a, a FROM links UNION ALL SELECT node, b FROM walk JOIN links ON here = a) SELECT node, min(here) AS final FROM walk GROUP BY node""")
def chain_resolve(spark, sf_dir):
    """Where the chain of merges that starts at a row ends; a cycle would end at its smallest member."""
    links = load(spark, sf_dir, "part").where("p_size > 10 and p_partkey > 0").selectExpr("p_partkey a", "p_partkey - 1 b")
    return graph.chain_ends(links)


@query(f"WITH {PART_COMMUNITIES} SELECT level, community, CAST(count(*) AS BIGINT) AS size, array_to_string(list_sort(list(node)), ',') AS nodes FROM members GROUP BY 1, 2 HAVING count(*) >= 2")
def community_listing(spark, sf_dir):
    """Communities by level with their sizes and sorted members."""
    listed = graph.listed(part_communities(spark, sf_dir), 2)
    return listed.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


@query(f"WITH {PART_COMMUNITIES} SELECT level, community, node, p_name, p_type FROM members JOIN part ON p_partkey = node WHERE level = 1")
def community_entities(spark, sf_dir):
    """Entities of the communities of one level."""
    ids = part_communities(spark, sf_dir).where("level = 1")
    return ids.join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_name", "p_type").hint("merge"), "node")


@query(f"WITH {PART_COMMUNITIES} SELECT DISTINCT level, community FROM members WHERE node IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_size > 40)")
def visible_communities(spark, sf_dir):
    """Communities that occur among the nodes that are shown."""
    shown = load(spark, sf_dir, "part").where("p_type = 'ECONOMY' and p_size > 40").select(F.col("p_partkey").alias("node"))
    return part_communities(spark, sf_dir).join(shown.hint("merge"), "node", "left_semi").select("level", "community").distinct()


@query(f"""WITH {PART_COMMUNITIES}, t AS (SELECT level, community, string_agg(p_name, ' ' ORDER BY node) AS title FROM members JOIN part ON p_partkey = node GROUP BY 1, 2)
SELECT level, community FROM t WHERE level = 1 AND contains(' ' || lower(title) || ' ', ' small ') AND contains(' ' || lower(title) || ' ', ' widget ')""")
def community_text_search(spark, sf_dir):
    """Communities of one level whose titles have all words of a query."""
    named = part_communities(spark, sf_dir).where("level = 1").join(load(spark, sf_dir, "part").selectExpr("p_partkey node", "p_name").hint("merge"), "node")
    words = named.select("level", "community", F.explode(T.lexemes("p_name")).alias("lexeme")).distinct()
    return fulltext.match(words, "community", "Small WIDGET", ["level"])


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"""SELECT b.vec_id AS vec_id, round({_DOT}, 6) AS score, CAST(b.vec_id % 3 AS INTEGER) AS level FROM embeddings a, embeddings b
WHERE a.vec_id = 0 AND b.embedding IS NOT NULL AND b.vec_id % 3 = 1 ORDER BY score DESC, vec_id LIMIT 10""")
def community_vector_search(spark, sf_dir):
    """Nearest vectors of one level, those without a vector left out; the query's one row is broadcast."""
    rows = load(spark, sf_dir, "embeddings").where("embedding is not null")
    one = F.broadcast(rows.where("vec_id = 0").select(F.col("embedding").alias("q")))
    scored = rows.withColumn("level", F.expr("cast(vec_id % 3 as int)")).where("level = 1").crossJoin(one)
    return scored.select("vec_id", F.round(cosine("embedding", "q"), 6).alias("score"), "level").orderBy(F.desc("score"), "vec_id").limit(10)


@query("""SELECT md5(lower(event_type)) AS key, min(event_type) AS asked, CAST(count(*) AS BIGINT) AS uses, CAST(count(*) - 1 AS BIGINT) AS hits FROM events GROUP BY 1""")
def query_cache(spark, sf_dir):
    """Queries by the digest of their text: one is computed, its repeats are hits."""
    return load(spark, sf_dir, "events").groupBy(F.md5(F.lower("event_type")).alias("key")).agg(
        F.min("event_type").alias("asked"), F.count("*").alias("uses"), (F.count("*") - 1).alias("hits")
    )


@query(r"""SELECT page_id, 'PART_OF' AS kind, '/' || regexp_extract(url, '^https?://[^/]+/([^/?]+)', 1) AS target FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[^/?]+/')
UNION ALL SELECT page_id, 'REFERENCES', '/' || regexp_extract(href, '^/([^/"]+)', 1) FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[A-Za-z][^"]*)"', 1)) AS href FROM pages)""")
def hierarchy_edges(spark, sf_dir):
    """Edges of a page to the section that its address names and to the places that its links name."""
    pages = load(spark, sf_dir, "pages")
    part = pages.where(F.rlike("url", F.lit("^https?://[^/]+/[^/?]+/"))).select(
        "page_id", F.lit("PART_OF").alias("kind"), F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([^/?]+)", 1)).alias("target")
    )
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[A-Za-z][^"]*)"'), 1)).alias("href"))
    return part.unionByName(links.select("page_id", F.lit("REFERENCES").alias("kind"), F.concat(F.lit("/"), F.regexp_extract("href", '^/([^/"]+)', 1)).alias("target")))


@query("""SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN p_partkey + 1 ELSE p_partkey END AS source, CASE WHEN p_type = 'ECONOMY' THEN p_partkey ELSE p_partkey + 1 END AS target,
CASE WHEN p_type = 'ECONOMY' THEN 'AMENDS' ELSE p_type END AS kind FROM part""")
def flipped_edges(spark, sf_dir):
    """Edges that say `is amended by` turned round."""
    turned = F.col("p_type") == "ECONOMY"
    a, b = F.col("p_partkey"), F.col("p_partkey") + 1
    return load(spark, sf_dir, "part").select(
        a.alias("id"), F.when(turned, b).otherwise(a).alias("source"), F.when(turned, a).otherwise(b).alias("target"),
        F.when(turned, "AMENDS").otherwise(F.col("p_type")).alias("kind"),
    )


@query("""WITH g AS (SELECT p_type AS kind, count(*) AS truth, count(*) FILTER (WHERE p_size > 25) AS hit FROM part WHERE p_size > 10 GROUP BY 1),
p AS (SELECT l_returnflag AS kind, count(*) AS found FROM lineitem GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part WHERE p_size > 20 GROUP BY 1)
SELECT coalesce(g.kind, p.kind) AS kind, round(coalesce(coalesce(hit, 0) / nullif(found, 0), 0), 4) AS precision, round(coalesce(coalesce(hit, 0) / nullif(truth, 0), 0), 4) AS recall FROM g FULL OUTER JOIN p ON g.kind = p.kind""")
def prf_of_both_sides(spark, sf_dir):
    """Precision and recall by type where a type may be on one side only: a full outer join of two counts."""
    part = load(spark, sf_dir, "part")
    truth = part.where("p_size > 10").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("truth"), F.count_if(F.col("p_size") > 25).alias("hit"))
    found = part.where("p_size > 20").select(F.col("p_type").alias("kind")).unionAll(load(spark, sf_dir, "lineitem").select("l_returnflag"))
    both = truth.join(found.groupBy("kind").agg(F.count("*").alias("found")), "kind", "full_outer")
    hit = F.coalesce("hit", F.lit(0))
    return both.select("kind", ratio(hit, F.col("found")).alias("precision"), ratio(hit, F.col("truth")).alias("recall"))


@query("""WITH req AS (SELECT DISTINCT community, kind FROM (SELECT p_partkey % 40 AS community, p_type AS kind, p_size FROM part) WHERE community < 5),
ev AS (SELECT p_type AS kind, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part WHERE p_size > 40),
top AS (SELECT kind, array_to_string(list(p_partkey ORDER BY r), ',') AS evidence, count(*) AS n FROM ev WHERE r <= 3 GROUP BY 1)
SELECT community, kind, coalesce(evidence, '') AS evidence, CASE WHEN n IS NULL THEN 'UNMET' ELSE 'UNCLEAR' END AS status,
round(avg(CASE WHEN n IS NULL THEN 0 ELSE 0.25 END) OVER (PARTITION BY community), 3) AS score FROM req LEFT JOIN top USING (kind)""")
def compliance(spark, sf_dir):
    """Requirements of the first five communities, each once, with their three best pieces of evidence, a status and
    the mean score of the community; without a model a requirement with evidence is unclear."""
    part = load(spark, sf_dir, "part")
    wanted = part.selectExpr("p_partkey % 40 community", "p_type kind").where("community < 5").distinct()
    best = graph.last_rows(part.where("p_size > 40").select("p_type", "p_partkey", "p_retailprice"), "p_type", [F.desc("p_retailprice"), "p_partkey"], 3)
    order = F.array_sort(F.collect_list(F.struct((-F.col("p_retailprice")).alias("minus"), "p_partkey")))
    best = best.groupBy(F.col("p_type").alias("kind")).agg(order.alias("e"))
    rows = wanted.join(best, "kind", "left").select(
        "community", "kind", F.coalesce(F.array_join(F.col("e.p_partkey").cast("array<string>"), ","), F.lit("")).alias("evidence"),
        F.when(F.isnull("e"), "UNMET").otherwise("UNCLEAR").alias("status"),
    )
    weight = F.when(F.col("status") == "UNCLEAR", T.UNREAD).otherwise(0.0)
    return rows.withColumn("score", F.round(F.avg(weight).over(Window.partitionBy("community")), 3))
