"""A corpus in five stages: quality, line dedup, near-duplicate documents, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.lineage import CLEANUP, ensure_checkpoint_dir, remove, settings
from docquarry.llm import lines, packing, pii, quality, simhash
from docquarry.sources import load


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are near copies of each other one stays; the others leave their texts."""
    return lines.remove_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links one stays."""
    return simhash.keep_representatives(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", first_lines),
    ("simhash", one_of_each_group),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: No SQL: the stages fit models and hash shingles. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them is written to the shared checkpoint
    folder, and deleted when the next stage has been written, but for the last."""
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with settings(spark, {CLEANUP: "true"}):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
