"""The graph after new documents came: duplicates merged, edges moved, communities found, as one run.

Entities have entity_id, name, kind, description, pages (an array) and embedding; edges have relationship_id,
source, target, kind and weight.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import stored
from docquarry.operators import similarity
from docquarry.operators.entities import merge_map
from docquarry.operators.modularity import community_levels
from docquarry.operators.resolution import LONGEST

# Similarity from which entities of one kind are merged unasked, the least one that is asked about, how many
# neighbours and pairs are looked at, and how many entities communities need.
UNASKED, ASKED, NEIGHBOURS, MOST_PAIRS, FEWEST = 0.95, 0.75, 3, 500, 3


def exact_mapping(entities: DataFrame) -> DataFrame:
    """(entity_id, canonical_id) of entities whose name, whatever its case, occurs again in their kind: that of the longest description
    stays, the smallest id of several."""
    key = [F.lower("name"), F.col("kind")]
    long = F.struct((-F.length(F.coalesce("description", F.lit("")))).alias("long"), "entity_id")
    groups = entities.groupBy(key[0].alias("k"), key[1].alias("t")).agg(F.min(long).alias("m"), F.count("*").alias("n")).where("n > 1")
    found = entities.select("entity_id", key[0].alias("k"), key[1].alias("t")).join(groups, ["k", "t"])
    return found.selectExpr("entity_id", "m.entity_id canonical_id")


def semantic_mapping(entities: DataFrame, least: float = ASKED, unasked: float = UNASKED, agrees: Callable | None = None) -> DataFrame:
    """(entity_id, canonical_id) of entities of one kind with near embeddings: pairs of `unasked` and more, and those of
    `least` and more that agrees, a function of (id1, id2, sim) pairs to those that are meant, confirms. Chains
    end at their smallest id."""
    near = similarity.nearest(entities, NEIGHBOURS, least, group="kind", id_col="entity_id")
    near = stored(near.orderBy(F.desc("sim"), "id1", "id2").limit(MOST_PAIRS))
    pairs = near.where(F.col("sim") >= unasked).select("id1", "id2")
    if agrees is not None:
        pairs = pairs.unionByName(agrees(near.where(F.col("sim") < unasked)).select("id1", "id2"))
    return merge_map(pairs)


def merged_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """entities after a merge by mapping (entity_id, canonical_id): the canonical one's name and kind, the pages of all, their different
    descriptions joined in the order of ids, and no embedding where others came in, as that is to be made anew."""
    rows = entities.join(mapping, "entity_id", "left").withColumn("at", F.coalesce("canonical_id", "entity_id"))
    own = F.col("entity_id") == F.col("at")
    said = rows.where("coalesce(description, '') <> ''").groupBy("at", "description").agg(F.min(F.struct((~own).alias("other"), "entity_id")).alias("o"))
    said = said.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("o", "description"))).alias("d"))
    whole = rows.groupBy("at").agg(
        F.any_value(F.when(own, F.col("name")), True).alias("name"), F.any_value(F.when(own, F.col("kind")), True).alias("kind"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"), F.count("*").alias("n"),
        F.any_value(F.when(own, F.col("embedding")), True).alias("embedding"),
    )
    return whole.join(said, "at", "left").select(
        F.col("at").alias("entity_id"), "name", "kind", F.left(F.array_join("d.description", " | "), F.lit(LONGEST)).alias("description"),
        "pages", F.when(F.col("n") == 1, F.col("embedding")).alias("embedding"),
    )


def moved_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges after a merge: ends replaced, no self-loops, and of edges of one kind between the same two the one with the smallest id and
    its weight."""
    out = edges
    for end in ("source", "target"):
        out = out.join(mapping.select(F.col("entity_id").alias(end), F.col("canonical_id").alias("_to")), end, "left")
        out = out.withColumn(end, F.coalesce("_to", end)).drop("_to")
    first = out.where("source <> target").groupBy("source", "target", "kind").agg(F.min(F.struct("relationship_id", "weight")).alias("r"))
    return first.select("r.relationship_id", "source", "target", "kind", "r.weight")


@dataclass
class Rebuilt:
    """What a run leaves: the tables, and for each stage its counts or its error."""

    entities: DataFrame
    edges: DataFrame
    communities: DataFrame | None = None
    stats: dict[str, dict] = field(default_factory=dict)


def rebuild(
    entities: DataFrame, edges: DataFrame, dedup: bool = True, semantic: bool = True, embed: Callable | None = None, agrees: Callable | None = None,
    save: Callable | None = None, levels: int = 3, least: float = ASKED, unasked: float = UNASKED,
) -> Rebuilt:
    """Exact merges, embedding, semantic merges, embedding of what changed, communities, saving.

    embed is a function of entities to entities with their missing embeddings, save one of the communities (level,
    community, title, nodes). A merging or embedding stage that fails leaves the tables as the one before left them, and the
    others go on; without communities nothing is saved. Every stage's tables are written before the next
    one reads them.
    """
    done = Rebuilt(entities, edges)

    def stage(name: str, work: Callable[[], dict]) -> bool:
        try:
            done.stats[name] = work()
            return True
        except (PySparkException, ValueError, OSError) as e:
            done.stats[name] = {"error": str(e)}
            return False

    def merge(mapping_of: Callable[[DataFrame], DataFrame]) -> dict:
        mapping = stored(mapping_of(done.entities).where("entity_id <> canonical_id"))
        after = stored(merged_entities(done.entities, mapping)), stored(moved_edges(done.edges, mapping))
        done.entities, done.edges = after
        return {"merged": mapping.select("canonical_id").distinct().count(), "removed": mapping.count()}

    def embedded() -> dict:
        missing = done.entities.where("embedding is null").count()
        if missing:
            done.entities = stored(embed(done.entities))
        return {"embedded": missing}

    if dedup:
        stage("exact", lambda: merge(exact_mapping))
    if embed:
        stage("embed", embedded)
    if dedup and semantic:
        stage("semantic", lambda: merge(lambda rows: semantic_mapping(rows, least, unasked, agrees)))
        if embed:
            stage("embed again", embedded)
    if not stage("total", lambda: {"entities": done.entities.count(), "edges": done.edges.count()}):
        return done
    if done.stats["total"]["entities"] < FEWEST:
        done.stats["communities"] = {"found": 0}
        return done

    def detect() -> dict:
        members = community_levels(done.edges, levels)
        listed = members.groupBy("level", "community").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        done.communities = stored(listed.withColumn("title", F.concat(F.lit("Community L"), "level")))
        return {"found": done.communities.count()}

    if stage("communities", detect) and done.stats["communities"]["found"] and save:
        stage("save", lambda: {"saved": done.stats["communities"]["found"]} if save(done.communities) is None else {})
    return done
