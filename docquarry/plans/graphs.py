"""The entity graph: edges from orders to parts of the same line numbers stand for relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import graph
from docquarry.plans.registry import query
from docquarry.plans.shared import PART_COMMUNITIES, part_communities
from docquarry.sources import load

_EDGES = "edges AS (SELECT p_partkey AS relationship_id, p_partkey AS source, (p_partkey * 37 + p_size) % (SELECT count(*) FROM part) AS target, p_brand AS kind, 1.0 + p_size % 4 AS weight FROM part)"


def _edges(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n")))).selectExpr(  # one row
        "p_partkey relationship_id", "p_partkey source", "(p_partkey * 37 + p_size) % n target", "p_brand kind", "cast(1 + p_size % 4 as double) weight"
    )


@query(f"""WITH RECURSIVE {_EDGES}, both_ AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
bfs(node, d) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT b, d + 1 FROM bfs JOIN both_ ON a = node WHERE d < 3),
dist AS (SELECT node, min(d) AS d FROM bfs GROUP BY node)
SELECT relationship_id, source, target, kind, CAST(least(s.d, t.d) + 1 AS INTEGER) AS hop FROM edges LEFT JOIN dist s ON s.node = source LEFT JOIN dist t ON t.node = target
WHERE least(s.d, t.d) + 1 <= 3 AND (source <> target OR source = 5)""")
def traverse_nhop(spark, sf_dir):
    return graph.neighbourhood(_edges(spark, sf_dir), 5, 3).select("relationship_id", "source", "target", "kind", "hop")


@query(f"""WITH {_EDGES}, nodes AS (SELECT p_partkey AS node FROM part WHERE p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 400)
SELECT relationship_id, source, target FROM edges WHERE source IN (SELECT node FROM nodes) AND target IN (SELECT node FROM nodes)""")
def induced_subgraph(spark, sf_dir):
    nodes = load(spark, sf_dir, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("node")).orderBy("node").limit(400)
    return graph.induced(_edges(spark, sf_dir), nodes).select("relationship_id", "source", "target")


@query(f"""WITH {_EDGES} SELECT least(source % 20, target % 20) AS a, greatest(source % 20, target % 20) AS b, round(CAST(sum(weight) AS DOUBLE), 6) AS weight FROM edges WHERE source % 20 <> target % 20 GROUP BY 1, 2""")
def contracted_graph(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    return graph.contracted(edges, ends.withColumn("community", F.col("node") % 20))


@query(f"""WITH {_EDGES}, pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target)
SELECT node, CAST(count(*) AS BIGINT) AS degree, CAST(least(20, greatest(4, 4 + 1.5 * count(*))) AS DOUBLE) AS size FROM (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY node""")
def simple_degrees(spark, sf_dir):
    return graph.simple_degrees(_edges(spark, sf_dir))


@query(f"""WITH {_EDGES} SELECT min(relationship_id) AS relationship_id, source, target FROM (SELECT relationship_id, source % 100 AS source, target % 100 AS target FROM edges) WHERE source <> target GROUP BY source, target""")
def edge_dedup(spark, sf_dir):
    rows = _edges(spark, sf_dir).selectExpr("relationship_id", "source % 100 source", "target % 100 target").where("source <> target")
    return rows.groupBy("source", "target").agg(F.min("relationship_id").alias("relationship_id"))


@query(f"""WITH RECURSIVE {_EDGES}, kept AS (SELECT source, source - source % 8 + CAST(weight AS BIGINT) AS target FROM edges), both_ AS (SELECT source AS a, target AS b FROM kept UNION SELECT target, source FROM kept),
reach(node, seen) AS (SELECT a, a FROM both_ WHERE a <> b UNION SELECT node, b FROM reach JOIN both_ ON a = seen) SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def union_find(spark, sf_dir):
    edges = _edges(spark, sf_dir).selectExpr("source src", "source - source % 8 + cast(weight as bigint) dst")
    return graph.connected_components(edges)


@query()
def communities_labelprop(spark, sf_dir):
    """Communities of three levels; label propagation has no SQL form, the tests hold its rules."""
    return graph.communities(_edges(spark, sf_dir))


@query(f"WITH {PART_COMMUNITIES} SELECT level, community, node FROM members")
def communities_modularity(spark, sf_dir):
    """Communities of all levels by modularity, on a graph whose communities its columns give."""
    return part_communities(spark, sf_dir)


@query(f"""WITH {_EDGES} SELECT source AS node, min(target % 50) AS community FROM edges GROUP BY source""")
def node_first_community(spark, sf_dir):
    members = _edges(spark, sf_dir).selectExpr("source node", "target % 50 community")
    return graph.first_community(members)


@query(f"""WITH {_EDGES}, n AS (SELECT source AS node, relationship_id, target AS other, 'out' AS direction FROM edges UNION ALL SELECT target, relationship_id, source, 'in' FROM edges WHERE source <> target)
SELECT node, relationship_id, other, direction FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY relationship_id) AS r FROM n) WHERE r <= 10""")
def entity_neighbours(spark, sf_dir):
    e = _edges(spark, sf_dir)
    out = e.selectExpr("source node", "relationship_id", "target other", "'out' direction")
    both = out.unionByName(e.where("source <> target").selectExpr("target node", "relationship_id", "source other", "'in' direction"))
    return graph.last_rows(both, "node", [F.col("relationship_id")], 10)
