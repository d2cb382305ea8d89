"""Exact duplicates by two passes over a Bloom filter, with built-in functions only.

The first pass counts, for each of two bits that a row's hash selects, whether two rows or more set
it. The bits that were set twice form the filter. In the second pass a row is possibly repeated only
if both its bits are in the filter. Only such rows are grouped by digest; all others pass straight
through without a shuffle. False positives cost a shuffled row, never a wrong result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import cut
from docquarry.llm import filters
from docquarry.operators.skew import spread_join

_TEXT = "coalesce(text, '')"


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal if they are identical; null counts as empty. Of equal texts the row with the
    largest doc_id stays: keep_id is that id and kept says whether the row has it. Ids that are null
    rank below all others. Rows that repeat both text and doc_id are one document and share its
    verdict. An empty table gives no rows.
    """
    words = filters.filter_words(docs.count())
    seen = filters.build(docs.selectExpr(f"xxhash64({_TEXT}) h"), words, least=2)
    rows = docs.selectExpr("doc_id", f"xxhash64({_TEXT}) h", f"sha2({_TEXT}, 256) text_sha256")
    rows = filters.tested(rows, "h", words, seen)
    rows = cut(rows)
    alone = rows.where("not maybe").selectExpr(
        "doc_id", "doc_id keep_id", "1L group_size", "true kept", "text_sha256"
    )
    maybe = rows.where("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    grouped = spread_join(maybe, groups, "text_sha256").selectExpr(
        "doc_id", "keep_id", "group_size", "doc_id <=> keep_id kept", "text_sha256"
    )
    return alone.unionByName(grouped)
