"""Vector search on DataFrames: exact top-k, nearest neighbours within a type, adaptive cut-off."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.vectors import clamped, cosine
from docquarry.operators import similarity
from docquarry.operators.mixture import mixtures


def top_k(rows: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(id, score): the k rows of highest cosine similarity to one query vector, ties to the smaller id.

    The vector is a literal, so the plan is a scan, a projection and a bounded sort in every task.
    Filters of rows run before the scores. Null vectors take no part.
    """
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).select(id_col, F.round(cosine(F.col(vector), literal), digits).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def neighbours(rows: DataFrame, k: int, least: float, kind: str = "label", digits: int = 6) -> DataFrame:
    """(id1, id2, sim): for each row its k nearest of the same kind with a larger id; the bound on
    similarity applies to those k."""
    return similarity.nearest(rows, k, least, group=kind, digits=digits)


@dataclass(frozen=True)
class AdaptiveK:
    """Settings of the adaptive cut-off; method is otsu or gmm."""

    enabled: bool = True
    method: str = "otsu"
    fetch_k: int = 20
    min_k: int = 1
    max_k: int = 10
    gap: float = 0.05
    min_samples: int = 3

    def __post_init__(self):
        if self.method not in ("otsu", "gmm"):
            raise ValueError(f"no method called {self.method}")


def _otsu(rows: DataFrame, group: str, id_col: str) -> DataFrame:
    """rows with bound: midway between the neighbours whose parting gives the most variance between the two classes;
    the first maximum counts."""
    up, whole = Window.partitionBy(group).orderBy("score", F.desc(id_col)), Window.partitionBy(group)
    rows = rows.withColumns(
        {
            "i": F.row_number().over(up),
            "below": F.sum("score").over(up.rowsBetween(Window.unboundedPreceding, 0)),
            "next": F.lead("score").over(up),
            "total": F.sum("score").over(whole),
        }
    )
    between = F.expr("round(i * (n - i) * pow(below / i - (total - below) / nullif(n - i, 0), 2), 12)")
    rows = rows.withColumn("between", F.when(F.col("i") < F.col("n"), between))
    best = F.max_by(F.expr("(score + next) / 2"), F.struct("between", (-F.col("i")).alias("first"))).over(whole)
    return rows.withColumn("bound", best)


def adaptive_k(ranked: DataFrame, group: str, id_col: str, config: AdaptiveK = AdaptiveK()) -> DataFrame:
    """ranked (group, id, score) with rank, threshold and method, cut where the scores of a group part.

    Few scores pass through up to max_k, with threshold 0; scores that lie close together give the first
    min_k, with their minimum as the threshold; others those that reach the threshold of Otsu or of a mixture of two
    normal distributions, at least min_k and at most max_k. Thresholds are shown to four digits and
    applied unrounded.
    """
    down, whole = Window.partitionBy(group).orderBy(F.desc("score"), id_col), Window.partitionBy(group)
    rows = ranked.select(
        group,
        id_col,
        "score",
        F.row_number().over(down).alias("rank"),
        F.count("*").over(whole).alias("n"),
        F.min("score").over(whole).alias("least"),
        F.round(F.max("score").over(whole) - F.min("score").over(whole), 9).alias("spread"),
    )
    if config.enabled:
        method = F.expr(
            f"case when n < {config.min_samples} then 'passthrough' when spread < {config.gap} then 'unimodal_fallback' else '{config.method}' end"
        )
        if config.method == "otsu":
            rows = _otsu(rows, group, id_col)
        else:
            fitted = mixtures(ranked, group).select(group, F.round("threshold", 9).alias("bound"))
            rows = rows.join(fitted, group)
    else:
        method, rows = F.lit("passthrough"), rows.withColumn("bound", F.lit(0.0))
    rows = rows.withColumn("method", method)
    keep = F.expr(
        f"""case method when 'passthrough' then rank <= {config.max_k}
            when 'unimodal_fallback' then rank <= {config.min_k}
            else rank <= {config.max_k} and (score >= bound or rank <= {config.min_k}) end"""
    )
    threshold = F.expr("round(case method when 'passthrough' then 0D when 'unimodal_fallback' then least else bound end, 4)")
    return rows.where(keep).select(group, id_col, "score", "rank", threshold.alias("threshold"), "method")


def retrieve(
    pages: DataFrame, queries: DataFrame, k: int = 5, config: AdaptiveK = AdaptiveK(), document: str | None = None,
    category: str | None = None, categories: DataFrame | None = None, id_col: str = "page_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, <id>, document_id, page_number, score, rank, threshold, method): the pages for each of a table of queries.

    pages has an id, document_id, page_number and a vector, queries an id of the same name and a vector. The search
    fetches the larger of k and fetch_k pages for every query in one plan, clamps scores to 0 and 1 and
    cuts off adaptively, at the smaller of max_k and k. document keeps the pages of one document, category
    those of the documents that categories (document_id, category) names; a category that it doesn't name is
    an error, and so is a page number under 1. A page is never found by itself.
    """
    if category is not None:
        named = categories.where(F.col("category") == category).select("document_id").distinct()
        if named.isEmpty():
            raise ValueError(f"no category called {category}")
        pages = pages.join(named, "document_id", "left_semi")
    if document is not None:
        pages = pages.where(F.col("document_id") == document)
    fetch = max(config.fetch_k, k) if config.enabled else k
    found = similarity.nearest(pages, fetch, queries=queries, group=None, id_col=id_col, vector=vector)
    found = found.select(F.col("id1").alias("query_id"), F.col("id2").alias(id_col), clamped(F.col("sim")).alias("score"))
    kept = adaptive_k(found, "query_id", id_col, replace(config, max_k=min(config.max_k, k)))
    number = F.expr("if(page_number < 1, raise_error(concat('page_number must be 1 at least, not ', page_number)), page_number) page_number")
    return kept.join(pages.select(id_col, "document_id", number), id_col).select(
        "query_id", id_col, "document_id", "page_number", "score", "rank", "threshold", "method"
    )
