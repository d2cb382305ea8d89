"""Entity graphs: neighbourhoods, subgraphs, contraction, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.lineage import cut, stored
from docquarry.operators.components import connected_components


def _undirected(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("source").alias("at"), F.col("target").alias("to"))
    return a.unionByName(a.select(F.col("to").alias("at"), F.col("at").alias("to"))).where("at <> to")


def distances(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, distance) of nodes within `depth` undirected steps of any root (node): one join of the
    frontier for each step, each node once."""
    seen = roots.select("node", F.lit(0).alias("distance")).distinct()
    both, frontier = _undirected(edges), seen
    for step in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("node").alias("at")), "at").select(F.col("to").alias("node")).distinct()
        frontier = reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(step))
        seen = cut(seen.unionByName(frontier))
        frontier = seen.where(F.col("distance") == step)
    return seen


#: Hops that a neighbourhood takes at most.
DEEPEST = 5


def neighbourhood(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """edges (relationship_id, source, target, ...) within `depth` hops of root, with hop; a depth
    under 1 counts as 1 and one over DEEPEST as that. A self-loop belongs only if it is on the root."""
    depth = min(max(depth, 1), DEEPEST)
    roots = edges.sparkSession.createDataFrame([(root,)], "node long")
    near = distances(edges, roots, depth)
    source = near.select(F.col("node").alias("source"), F.col("distance").alias("d1"))
    target = near.select(F.col("node").alias("target"), F.col("distance").alias("d2"))
    found = edges.join(source, "source", "left").join(target, "target", "left")
    hop = F.least("d1", "d2") + 1  # least passes over nulls
    keep = (F.col("hop") <= depth) & ((F.col("source") != F.col("target")) | (F.col("source") == root))
    return found.withColumn("hop", hop).where(keep).drop("d1", "d2")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    return edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(
        nodes.select(F.col("node").alias("target")), "target", "left_semi"
    )


def contracted(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b, weight): summed weights between different communities, a < b; membership is (node,
    community) and edges have a weight."""
    a = membership.select(F.col("node").alias("source"), F.col("community").alias("c1"))
    b = membership.select(F.col("node").alias("target"), F.col("community").alias("c2"))
    between = edges.join(a, "source").join(b, "target").where("c1 <> c2")
    return between.groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b")).agg(
        F.round(F.sum("weight"), 6).alias("weight")
    )


def simple_degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, size) of the simple undirected graph; size is 4 + 1.5 * degree, within 4 and 20."""
    pairs = edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).selectExpr(
        "node", "degree", "cast(least(20, greatest(4, 4 + 1.5 * degree)) as double) size"
    )


def label_communities(edges: DataFrame, rounds: int = 8, min_size: int = 3) -> DataFrame:
    """(node, community, size): synchronous label propagation by weight.

    Every node takes the label of most weight around it, its own counting once more than nothing so
    that ties are stable, the smaller label winning. Rounds are joins and grouped sums; no community
    is gathered anywhere. Communities under min_size are left out.
    """
    weighted = edges.where("source <> target").groupBy(
        F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    ).agg(F.sum("weight").alias("w"))
    both = cut(
        weighted.select(F.col("a").alias("at"), F.col("b").alias("to"), "w").unionByName(
            weighted.select(F.col("b").alias("at"), F.col("a").alias("to"), "w")
        )
    )
    labels = both.select(F.col("at").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("at", "label").agg(F.sum("w").alias("w"))
        around = around.unionByName(labels.select(F.col("node").alias("at"), "label", F.lit(1e-9).alias("w")))
        around = around.groupBy("at", "label").agg(F.round(F.sum("w"), 9).alias("w"))
        best = around.groupBy("at").agg(F.max(F.struct("w", (-F.col("label")).alias("minus"))).alias("m"))
        labels = cut(best.select(F.col("at").alias("node"), (-F.col("m.minus")).alias("label")))
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("community"))
    return labels.join(sizes.where(F.col("size") >= min_size), "label").select("node", "community", "size")


def communities(edges: DataFrame, levels: int = 3) -> DataFrame:
    """(level, community, node): communities of the graph, of its contraction, and so on.

    Level 0 keeps communities of three nodes or more, higher ones of two communities or more; it ends
    where a level has one community at most.
    """
    current, members, out = edges.select("source", "target", "weight"), None, None
    for level in range(levels):
        found = cut(label_communities(current, min_size=3 if level == 0 else 2).select("node", "community"))
        if members is None:
            members = found.select("node", "community")
        else:
            step = found.select(F.col("node").alias("community"), F.col("community").alias("above"))
            members = members.join(step, "community").select("node", F.col("above").alias("community"))
        members = cut(members)
        own = members.select(F.lit(level).alias("level"), "community", "node")
        out = own if out is None else out.unionByName(own)
        if members.select("community").distinct().limit(2).count() < 2:
            break
        current = cut(contracted(current, found).select(F.col("a").alias("source"), F.col("b").alias("target"), "weight"))
    return out


def first_community(membership: DataFrame) -> DataFrame:
    """(node, community): of the communities that hold a node the first by id."""
    return membership.groupBy("node").agg(F.min("community").alias("community"))


def last_rows(rows: DataFrame, key: str, order: list, keep: int) -> DataFrame:
    """The last `keep` rows of each key in that order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def listed(members: DataFrame, least: int) -> DataFrame:
    """(level, community, size, nodes): communities of at least so many of members (level, community, node), with
    their sorted nodes."""
    whole = members.groupBy("level", "community").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("nodes"))
    return whole.where(F.col("size") >= least)


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, final): where the walk along links (a, b), of which each a has one, ends; walks that run into a
    cycle end at its smallest node. Each round doubles the steps taken."""
    links = stored(links.selectExpr("a node", "b at", "b low"))
    walks = links
    for _ in range(links.count().bit_length() + 1):
        ahead = walks.selectExpr("node at", "at then", "low lower")
        walks = stored(walks.join(ahead, "at", "left").selectExpr("node", "coalesce(then, at) at", "least(low, lower) low"))
        if not walks.join(links.selectExpr("node at"), "at", "left_semi").limit(1).count():
            return walks.selectExpr("node", "at final")
    round_ = walks.selectExpr("node at", "low")
    return walks.drop("low").join(round_, "at", "left").selectExpr("node", "coalesce(low, at) final")
