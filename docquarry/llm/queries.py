"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import align, audit, bpe, chat, exact, langid, lines, packing, pii, quality, simhash, suffix, topk
from docquarry.sources import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(load(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(load(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(load(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(load(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(load(spark, sf_dir, "documents"), every=True)


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", "'</s>[INST] ok [/INST]' text")
    return chat.digests(chat.format_conversations(rows.unionByName(own)))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interaction_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(load(spark, sf_dir, "documents"))


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
WHERE rank <= 5
"""

OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

OP12_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM docs
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN known USING (doc_id)
), orders(filter_order, before, step, f, mask_before) AS (
  SELECT CAST(l AS VARCHAR), '', 1, i, 0 FROM (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) v(l, i)
  UNION ALL
  SELECT filter_order || l, filter_order, step + 1, i, mask_before | (1 << f) FROM orders, (VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) v(l, i)
  WHERE instr(filter_order, l) = 0
), steps AS (
  SELECT o.filter_order, s.step, s.f, s.mask_before FROM orders o JOIN orders s ON o.step = 5 AND starts_with(o.filter_order, s.filter_order)
), counted AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), found AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (mask_before | (1 << f)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & (1 << f) <> 0 AND mask & mask_before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & (1 << f) <> 0 AND mask & mask_before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & (1 << f) <> 0 AND mask & mask_before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & (1 << f) <> 0 AND mask & mask_before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM found
"""


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_topk": op2_topk,
        "op3_suffix": op3_suffix,
        "op4_pii": op4_pii,
        "op5_packing": op5_packing,
        "op6_bpe": op6_bpe,
        "op7_quality": op7_quality,
        "op8_langid": op8_langid,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_line_dedup": op10_line_dedup,
        "op11_chat": op11_chat,
        "op12_audit": op12_audit,
        "op13_align": op13_align,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op12_audit": OP12_SQL}
