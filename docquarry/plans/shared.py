"""Tables that several queries of one application read: made once, in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.lineage import NO_BROADCAST, ensure_checkpoint_dir, settings
from docquarry.operators import fulltext
from docquarry.operators.modularity import community_levels
from docquarry.sources import load

_made: dict[tuple[str, str, str], tuple[str, object]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], DataFrame]) -> DataFrame:
    """The table that write(place) makes of the tables of sf_dir, read back; made by the first query that asks."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        place = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made[key] = place, write(place).schema
    place, schema = _made[key]
    return spark.read.schema(schema).parquet(place)


def document_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index of the texts of documents."""

    def write(place):
        docs = load(spark, sf_dir, "documents").where("doc_id is not null")
        return fulltext.write_index(fulltext.postings(docs, "doc_id", {"D": "text"}), place, "doc_id")

    return once(spark, sf_dir, "document-index", write)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, weight): parts of one brand and parity of size around the first of them, and these weakly
    around the first of five bundles of brands. What communities there are follows from the columns."""
    part = load(spark, sf_dir, "part").selectExpr("p_partkey node", "p_brand", "p_size % 2 half")
    groups = part.groupBy("p_brand", "half").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n >= 3")
    spokes = part.join(groups, ["p_brand", "half"]).where("node <> hub").selectExpr("hub source", "node target", "1D weight")
    bundled = groups.selectExpr("hub", "cast(substr(p_brand, 7) as int) % 5 bundle")
    tops = bundled.groupBy("bundle").agg(F.min("hub").alias("top"))
    return spokes.unionByName(bundled.join(tops, "bundle").where("hub <> top").selectExpr("top source", "hub target", "0.01D weight"))


def part_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, community, node): the communities that modularity finds among parts."""

    def write(place):
        # graphs and memberships of every round would pass through the driver
        with settings(spark, NO_BROADCAST):
            found = community_levels(part_edges(spark, sf_dir))
            found.write.parquet(place)
        return found

    return once(spark, sf_dir, "part-communities", write)


#: The same communities by the columns that their edges come from.
PART_COMMUNITIES = """g AS (SELECT p_brand, p_size % 2 AS half, min(p_partkey) AS community FROM part GROUP BY 1, 2 HAVING count(*) >= 3),
b AS (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) % 5 AS bundle FROM g), s AS (SELECT bundle, min(community) AS above FROM b GROUP BY 1 HAVING count(*) >= 2),
inside AS (SELECT p_partkey AS node, community, bundle FROM part JOIN b ON b.p_brand = part.p_brand AND b.half = p_size % 2),
members AS (SELECT CAST(0 AS INTEGER) AS level, community, node FROM inside UNION ALL SELECT 1, above, node FROM inside JOIN s USING (bundle))"""
