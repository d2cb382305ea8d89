"""The composed rebuild on vectors: labels stand for kinds, and some names come again."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators.rebuild import rebuild
from docquarry.plans.registry import query
from docquarry.sources import load

_COS = """round(list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(b.embedding, b.embedding))), 6)"""


def _merged(rows: str, mapping: str, out: str) -> str:
    """SQL of `out`, the entities of `rows` after a merge by `mapping` (entity_id, canonical_id)."""
    return f"""{out}_m AS (SELECT r.*, coalesce(m.canonical_id, r.entity_id) AS home FROM {rows} r LEFT JOIN {mapping} m USING (entity_id)),
{out}_d AS (SELECT home, left(string_agg(description, ' | ' ORDER BY other, first), 2000) AS description FROM (SELECT home, description, min((entity_id <> home, entity_id))[1] AS other, min((entity_id <> home, entity_id))[2] AS first
  FROM {out}_m WHERE coalesce(description, '') <> '' GROUP BY 1, 2) GROUP BY 1),
{out} AS (SELECT home AS entity_id, max(name) FILTER (WHERE entity_id = home) AS name, max(kind) FILTER (WHERE entity_id = home) AS kind, any_value(d.description) AS description,
  list_sort(list_distinct(flatten(list(pages)))) AS pages, CASE WHEN count(*) = 1 THEN any_value(embedding) END AS embedding FROM {out}_m LEFT JOIN {out}_d d USING (home) GROUP BY home)"""


_REBUILT = f"""WITH RECURSIVE e AS (SELECT vec_id AS entity_id, CASE WHEN vec_id % 2 = 0 THEN 'N' ELSE 'n' END || vec_id * 7 % 180 AS name, 'k' || label AS kind, repeat('d', CAST(1 + vec_id % 4 AS INTEGER)) AS description, [vec_id % 5] AS pages, embedding::DOUBLE[] AS embedding FROM embeddings),
x AS (SELECT entity_id, first_value(entity_id) OVER (PARTITION BY lower(name), kind ORDER BY length(description) DESC, entity_id) AS canonical_id FROM e), {_merged("e", "x", "e1")},
p AS (SELECT * FROM (SELECT a.entity_id AS id1, b.entity_id AS id2, {_COS} AS sim, row_number() OVER (PARTITION BY a.entity_id ORDER BY {_COS} DESC, b.entity_id) AS r FROM e1 a JOIN e1 b ON a.kind = b.kind AND a.entity_id < b.entity_id
  WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL) WHERE r <= 3 AND sim >= 0.3 ORDER BY sim DESC, id1, id2 LIMIT 500),
links AS (SELECT id1 AS u, id2 AS v FROM p WHERE sim >= 0.4 UNION SELECT id2, id1 FROM p WHERE sim >= 0.4), reach(node, seen) AS (SELECT u, u FROM links UNION SELECT reach.node, links.v FROM reach JOIN links ON reach.seen = links.u),
y AS (SELECT node AS entity_id, min(seen) AS canonical_id FROM reach GROUP BY 1), {_merged("e1", "y", "e2")}"""


def _run(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    entities = rows.selectExpr(
        "vec_id entity_id", "concat(if(vec_id % 2 = 0, 'N', 'n'), vec_id * 7 % 180) name", "concat('k', label) kind", "repeat('d', cast(1 + vec_id % 4 as int)) description",
        "array(vec_id % 5) pages", "cast(embedding as array<double>) embedding",
    )
    counted = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    edges = counted.selectExpr("vec_id relationship_id", "vec_id source", "(vec_id * 7 + 3) % n target", "concat('r', label % 3) kind", "cast(1 + vec_id % 3 as double) weight")
    return rebuild(entities, edges, levels=0, least=0.3, unasked=0.4)  # communities have queries of their own


@query(_REBUILT + " SELECT entity_id, name, kind, description, array_to_string(pages, ',') AS pages, embedding IS NOT NULL AS embedded FROM e2")
def rebuilt_entities(spark, sf_dir):
    """Entities after exact and semantic merges, one behind the other."""
    found = _run(spark, sf_dir).entities
    return found.select("entity_id", "name", "kind", "description", F.array_join("pages", ",").alias("pages"), F.isnotnull("embedding").alias("embedded"))


@query(_REBUILT + """, both_ AS (SELECT x.entity_id, coalesce(y.canonical_id, x.canonical_id) AS home FROM x LEFT JOIN y ON y.entity_id = x.canonical_id),
r AS (SELECT vec_id AS relationship_id, vec_id AS source, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS target, 'r' || label % 3 AS kind, CAST(1 + vec_id % 3 AS DOUBLE) AS weight FROM embeddings)
SELECT relationship_id, s.home AS source, t.home AS target, r.kind, weight FROM r JOIN both_ s ON s.entity_id = source JOIN both_ t ON t.entity_id = target WHERE s.home <> t.home
QUALIFY row_number() OVER (PARTITION BY s.home, t.home, r.kind ORDER BY relationship_id) = 1""")
def rebuilt_edges(spark, sf_dir):
    """Edges after both merges."""
    return _run(spark, sf_dir).edges.select("relationship_id", "source", "target", "kind", "weight")
