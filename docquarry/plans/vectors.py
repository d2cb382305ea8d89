"""Vector search on `embeddings`; label stands for the document or type of a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions.vectors import l2_normalized
from docquarry.operators import similarity
from docquarry.operators.entities import merge_map, remapped_edges
from docquarry.operators.matching import greedy_vectors
from docquarry.operators.vector import AdaptiveK, adaptive_k, neighbours, retrieve, top_k
from docquarry.plans.registry import query
from docquarry.sources import load

_COS = """round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
  / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"""


def _vector(spark, sf_dir, vec_id):
    return load(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _near(where: str, k: int = 10) -> str:
    return f"""SELECT b.vec_id AS vec_id, {_COS} AS score FROM embeddings a, embeddings b
WHERE a.vec_id = 0 AND b.vec_id <> 0 AND {where} ORDER BY score DESC, vec_id LIMIT {k}"""


@query(_near("true"))
def vector_topk(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").where("vec_id <> 0")
    return top_k(rows, _vector(spark, sf_dir, 0), 10)


@query(_near("b.label = 3"))
def vector_topk_label(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").where("vec_id <> 0 and label = 3")
    return top_k(rows, _vector(spark, sf_dir, 0), 10)


@query(_near("b.label IN (SELECT CAST(substr(source, 4) AS INTEGER) FROM documents WHERE lang = 'de' AND n_chars > 3000 AND CAST(substr(source, 4) AS INTEGER) % 2 = 1)"))
def vector_topk_semijoin(spark, sf_dir):
    wanted = load(spark, sf_dir, "documents").where("lang = 'de' and n_chars > 3000")
    wanted = wanted.selectExpr("cast(substr(source, 4) as int) label").where("label % 2 = 1").distinct()
    rows = load(spark, sf_dir, "embeddings").where("vec_id <> 0").join(wanted, "label", "left_semi")
    return top_k(rows, _vector(spark, sf_dir, 0), 10)


@query("""SELECT vec_id, round(list_dot_product(e, e), 6) AS len2, round(e[1], 6) AS first, round(e[64], 6) AS last FROM (
SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings)""")
def l2_normalize(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings").select("vec_id", l2_normalized("embedding").alias("e"))
    return rows.selectExpr("vec_id", "round(aggregate(e, 0D, (s, x) -> s + x * x), 6) len2", "round(e[0], 6) first", "round(e[63], 6) last")


_KNN = f"""SELECT id1, id2, sim FROM (
SELECT a.vec_id AS id1, b.vec_id AS id2, {_COS} AS sim,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id) WHERE r <= 3 AND sim >= 0.3"""


@query(_KNN)
def vector_batch_knn(spark, sf_dir):
    return neighbours(load(spark, sf_dir, "embeddings"), 3, 0.3)


@query(f"""WITH pairs AS ({_KNN}) SELECT id1, id2, sim, CASE WHEN sim >= 0.4 THEN 'auto' ELSE 'ask' END AS zone
FROM pairs ORDER BY sim DESC, id1, id2 LIMIT 500""")
def semantic_candidates(spark, sf_dir):
    pairs = neighbours(load(spark, sf_dir, "embeddings"), 3, 0.3)
    zone = F.when(F.col("sim") >= 0.4, "auto").otherwise("ask")
    return pairs.withColumn("zone", zone).orderBy(F.desc("sim"), "id1", "id2").limit(500)


_MERGED = f"""WITH RECURSIVE pairs AS ({_KNN}), links AS (SELECT id1 AS a, id2 AS b FROM pairs UNION SELECT id2, id1 FROM pairs),
reach(node, seen) AS (SELECT a, a FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a),
mapping AS (SELECT node AS entity_id, min(seen) AS canonical_id FROM reach GROUP BY node)"""


@query(_MERGED + " SELECT entity_id, canonical_id FROM mapping")
def semantic_components(spark, sf_dir):
    return merge_map(neighbours(load(spark, sf_dir, "embeddings"), 3, 0.3))


@query(_MERGED + """, edges AS (SELECT vec_id AS relationship_id, vec_id AS source, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS target, label % 3 AS kind FROM embeddings),
moved AS (SELECT relationship_id, coalesce(s.canonical_id, source) AS source, coalesce(t.canonical_id, target) AS target, kind
FROM edges LEFT JOIN mapping s ON s.entity_id = source LEFT JOIN mapping t ON t.entity_id = target)
SELECT min(relationship_id) AS relationship_id, source, target, kind FROM moved WHERE source <> target GROUP BY source, target, kind""")
def merge_poststate(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    counted = rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    edges = counted.selectExpr("vec_id relationship_id", "vec_id source", "(vec_id * 7 + 3) % n target", "label % 3 kind")
    return remapped_edges(edges, merge_map(neighbours(rows, 3, 0.3)))


def _adaptive(queries: str, fetch: int, max_k: int, method: str = "otsu", score: str = _COS, where: str = "true") -> str:
    """SQL of the adaptive cut-off for several queries (score, cut and bounds of a list by its query_id)."""
    if method == "otsu":
        bound = """SELECT query_id, (score + next) / 2 AS bound FROM v WHERE i < n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY between_ DESC, i) = 1"""
    else:
        bound = "SELECT query_id, round(avg(score), 9) AS bound FROM ranked GROUP BY 1"
    return f"""WITH ranked AS (SELECT query_id, vec_id, score FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {score} AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS r
  FROM embeddings a, embeddings b WHERE {queries} AND a.vec_id <> b.vec_id AND {where}) WHERE r <= {fetch}),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
  row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id DESC) AS i,
  sum(score) OVER (PARTITION BY query_id ORDER BY score, vec_id DESC ROWS UNBOUNDED PRECEDING) AS below,
  lead(score) OVER (PARTITION BY query_id ORDER BY score, vec_id DESC) AS next,
  sum(score) OVER (PARTITION BY query_id) AS total, count(*) OVER (PARTITION BY query_id) AS n, min(score) OVER (PARTITION BY query_id) AS least_,
  round(max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id), 9) AS spread FROM ranked),
v AS (SELECT *, CASE WHEN i < n THEN round(i * (n - i) * pow(below / i - (total - below) / (n - i), 2), 12) END AS between_ FROM s), c AS ({bound})
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank,
  round(CASE WHEN n < 3 THEN 0 WHEN spread < 0.05 THEN least_ ELSE bound END, 4) AS threshold,
  CASE WHEN n < 3 THEN 'passthrough' WHEN spread < 0.05 THEN 'unimodal_fallback' ELSE '{method}' END AS method
FROM v LEFT JOIN c USING (query_id)
WHERE CASE WHEN n < 3 THEN rank <= {max_k} WHEN spread < 0.05 THEN rank <= 1 ELSE rank <= {max_k} AND (score >= bound OR rank <= 1) END"""


@query(_adaptive("a.vec_id IN (0, 1, 2)", 20, 20))
def adaptive_k_otsu(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    found = similarity.nearest(rows, 20, queries=rows.where("vec_id in (0, 1, 2)"), group=None)
    found = found.selectExpr("id1 query_id", "id2 vec_id", "sim score")
    return adaptive_k(found, "query_id", "vec_id", AdaptiveK(max_k=20))


@query(_adaptive("a.vec_id % 20 = 0", 20, 10, "gmm"))
def adaptive_k_gmm(spark, sf_dir):
    """The cut by a mixture of two normal distributions, for all queries at once."""
    rows = load(spark, sf_dir, "embeddings")
    found = similarity.nearest(rows, 20, queries=rows.where("vec_id % 20 = 0"), group=None)
    return adaptive_k(found.selectExpr("id1 query_id", "id2 vec_id", "sim score"), "query_id", "vec_id", AdaptiveK(method="gmm"))


_PAGES = "concat('doc', label) document_id", "vec_id page_id", "cast(1 + vec_id % 97 as int) page_number", "embedding"


def _retrieved(fetch: int, max_k: int, where: str = "true") -> str:
    found = _adaptive("a.vec_id % 10 = 0", fetch, max_k, score=f"greatest(0, least(1, {_COS}))", where=where)
    return f"""SELECT query_id, vec_id AS page_id, 'doc' || label AS document_id, CAST(1 + vec_id % 97 AS INTEGER) AS page_number, score, rank, threshold, method
FROM ({found}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)"""


@query(_retrieved(20, 8))
def retrieved_pages(spark, sf_dir):
    """Pages for each of a table of queries: fetch, clamp, adaptive cut."""
    rows = load(spark, sf_dir, "embeddings").selectExpr(*_PAGES)
    return retrieve(rows, rows.where("page_id % 10 = 0"), 8)


@query(_retrieved(24, 10, "b.label % 2 = 1"))
def retrieved_pages_of_category(spark, sf_dir):
    """The same within the documents of one category."""
    rows = load(spark, sf_dir, "embeddings").selectExpr(*_PAGES, "label")
    categories = rows.selectExpr("document_id", "if(label % 2 = 1, 'odd', 'even') category").distinct()
    return retrieve(rows.drop("label"), rows.where("page_id % 10 = 0"), 24, AdaptiveK(), category="odd", categories=categories)


@query(f"""WITH pairs AS (SELECT a.label AS label, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(sim), 4) AS mean_sim, max(sim) AS max_sim FROM pairs GROUP BY label""")
def similarity_bands(spark, sf_dir):
    found = similarity.bands(load(spark, sf_dir, "embeddings"))
    return found.selectExpr("label", "n", "round(total / n, 4) mean_sim", "top max_sim")


_GREEDY = f"""WITH p AS (SELECT a.vec_id AS l, b.vec_id AS r, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.label = 1 AND b.label = 2),
walk AS (SELECT list_reduce(list([{{'l': l, 'r': r, 's': s}}] ORDER BY s DESC, l, r),
  lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.l = x[1].l OR y.r = x[1].r)) = 0 THEN list_concat(acc, x) ELSE acc END) AS taken FROM p WHERE s >= 0.1)
SELECT t.l AS "left", t.r AS "right", t.s AS score FROM (SELECT unnest(taken) AS t FROM walk)"""


@query(_GREEDY)
def greedy_match(spark, sf_dir):
    """Labels 1 and 2 matched one to one by falling similarity."""
    rows = load(spark, sf_dir, "embeddings")
    return greedy_vectors(rows.where("label = 1"), rows.where("label = 2"), 0.1)
