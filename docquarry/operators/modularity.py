"""Communities by modularity: local moving, connected refinement, contraction, levels.

Every step is a join or a grouped sum of the edges; no community is gathered anywhere. In a round every
node looks for the community around it that it gains most from. Rounds alternate between moves to
smaller and to larger community ids, so that two nodes can't change places for ever, and a round that
lowers the modularity is taken back and tried again with fewer of its moves. Communities that fall apart
are split into their connected parts, which never lowers the modularity, and contracted; moving goes on
on the smaller graph until it gains nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import discard, stored, tidied
from docquarry.operators.components import LINKS, connected_components

#: Gains and losses of modularity below this count as none.
LEAST = 1e-9


@dataclass
class _Graph:
    """both: (at, to, w) in both directions, without self-loops; nodes: (node, k, own): the strength of a node
    and its share of it that lies within; total is the sum of k, twice the weight of the graph."""

    both: DataFrame
    nodes: DataFrame
    total: float
    parts: int


def _weighted(edges: DataFrame) -> DataFrame:
    """(at, to, w) in both directions of edges (source, target, weight): parallel edges added up, without
    self-loops, null ends and weights that aren't positive."""
    sound = edges.where("source is not null and target is not null and source <> target and weight > 0")
    pairs = sound.groupBy(F.least("source", "target").alias("at"), F.greatest("source", "target").alias("to")).agg(F.sum("weight").alias("w"))
    return pairs.unionByName(pairs.selectExpr("to at", "at to", "w"))


def _graph(both: DataFrame, own: DataFrame | None = None) -> _Graph:
    both = stored(both)
    parts = 1 + both.count() // LINKS
    both = both.coalesce(parts)
    strength = both.groupBy("at").agg(F.sum("w").alias("k")).withColumnRenamed("at", "node")
    if own is None:
        nodes = strength.selectExpr("node", "k", "0D own")
    else:
        nodes = own.join(strength, "node", "left").selectExpr("node", "coalesce(k, 0D) + own k", "own")
    nodes = stored(nodes.coalesce(parts))
    return _Graph(both, nodes, nodes.agg(F.sum("k")).first()[0] or 0.0, parts)


def _looked(graph: _Graph, state: DataFrame, resolution: float) -> DataFrame:
    """(node, k, own, c, inside, best, gain) of state (node, k, own, c): the weight to a node's own community, the
    community it gains most from and how much (in weight); its own one, if there is none."""
    around = graph.both.join(state.selectExpr("node to", "c near"), "to").groupBy("at", "near").agg(F.sum("w").alias("w"))
    sizes = state.groupBy("c").agg(F.sum("k").alias("size"))
    met = around.join(sizes.withColumnRenamed("c", "near"), "near")
    met = met.join(state.selectExpr("node at", "k", "c"), "at")
    worth = f"round(w - {resolution!r} * k * (size - if(near = c, k, 0D)) / {graph.total!r}, 9)"
    best = met.selectExpr("at node", "near", "near = c stays", "w", f"{worth} worth").groupBy("node").agg(
        F.max(F.expr("if(stays, null, struct(worth, -near far))")).alias("other"), F.max(F.expr("if(stays, struct(w, worth), null)")).alias("here")
    )
    rows = state.join(best, "node", "left").join(sizes, "c")
    alone = f"round(-{resolution!r} * k * (size - k) / {graph.total!r}, 9)"  # worth of a community without a neighbour in it
    return rows.selectExpr(
        "node", "k", "own", "c", "coalesce(here.w, 0D) inside", "coalesce(-other.far, c) best",
        f"coalesce(other.worth - coalesce(here.worth, {alone}), 0D) gain", f"coalesce(here.worth, {alone}) worth",
    )


def _quality(graph: _Graph, looked: DataFrame, resolution: float) -> tuple[float, int, int]:
    """(modularity, nodes that gain by a move to a smaller id, to a larger one)."""
    by = looked.groupBy("c").agg(
        F.sum("k").alias("size"), F.sum(F.col("inside") + F.col("own")).alias("inside"),
        F.sum(F.expr(f"int(gain > {LEAST} and best < c)")).alias("down"), F.sum(F.expr(f"int(gain > {LEAST} and best > c)")).alias("up"),
    )
    inside, squares, down, up = by.agg(F.sum("inside"), F.sum(F.col("size") * F.col("size")), F.sum("down"), F.sum("up")).first()
    return inside / graph.total - resolution * squares / graph.total**2, down, up


def _moved(graph: _Graph, start: DataFrame, resolution: float, rounds: int) -> tuple[DataFrame, float]:
    """((node, c), modularity) after local moving from start (node, c)."""
    state = graph.nodes.join(start, "node")
    kept = stored(_looked(graph, state, resolution).coalesce(graph.parts))
    quality, down, up = _quality(graph, kept, resolution)
    share, smaller = 1, True
    for salt in range(rounds):
        if not down and not up:
            break
        smaller = bool(down) if not (down and up) else smaller
        moves = f"gain > {LEAST} and best {'<' if smaller else '>'} c and pmod(xxhash64(node, {salt}), {share}) = 0"
        state = kept.selectExpr("node", "k", "own", f"if({moves}, best, c) c")
        looked = stored(_looked(graph, state, resolution).coalesce(graph.parts))
        then, *moves_left = _quality(graph, looked, resolution)
        if then > quality + LEAST:
            discard(kept)
            kept, quality, (down, up), share = looked, then, moves_left, 1
        else:
            discard(looked)
            if share > 64:
                break
            share *= 4
        smaller = not smaller
    return kept.select("node", "c"), quality


def _connected(graph: _Graph, membership: DataFrame) -> DataFrame:
    """(node, c): the connected parts of all communities, named after their smallest node."""
    a, b = membership.selectExpr("node at", "c ca"), membership.selectExpr("node to", "c cb")
    within = graph.both.where("at < to").join(a, "at").join(b, "to").where("ca = cb")
    parts = connected_components(within.selectExpr("at src", "to dst"))
    return membership.select("node").join(parts, "node", "left").selectExpr("node", "coalesce(component, node) c")


def _contracted(graph: _Graph, membership: DataFrame) -> _Graph:
    """The graph of the communities; weight within them stays as their own."""
    a, b = membership.selectExpr("node at", "c ca"), membership.selectExpr("node to", "c cb")
    met = graph.both.join(a, "at").join(b, "to").groupBy("ca", "cb").agg(F.sum("w").alias("w"))
    met = stored(met.coalesce(graph.parts))
    inner = met.where("ca = cb").selectExpr("ca node", "w")
    own = graph.nodes.join(membership, "node").groupBy("c").agg(F.sum("own").alias("own")).withColumnRenamed("c", "node")
    own = own.join(inner, "node", "left").selectExpr("node", "own + coalesce(w, 0D) own")
    return _graph(met.where("ca <> cb").selectExpr("ca at", "cb to", "w"), own)


@tidied
def modularity_communities(edges: DataFrame, resolution: float = 1.0, iterations: int = 10, rounds: int = 40) -> DataFrame:
    """(node, community) of every node that a link of positive weight to another touches; community is its smallest node.

    edges are (source, target, weight), undirected. The result is connected, and no contraction, and no
    move of a single node, raises its modularity any more, unless `iterations` or `rounds` end it first.
    The same edges give the same communities. Without links the result is empty.
    """
    graph = _graph(_weighted(edges))
    membership, best = graph.nodes.selectExpr("node", "node c"), None
    if not graph.total:
        return membership.selectExpr("node", "c community")
    for _ in range(iterations):
        found, quality = _moved(graph, membership, resolution, rounds)
        found = stored(_connected(graph, found))
        small = _contracted(graph, found)
        while True:
            start = small.nodes.selectExpr("node", "node c")
            above, then = _moved(small, start, resolution, rounds)
            if then <= quality + LEAST:
                quality = max(quality, then)
                break
            quality = then
            above = stored(_connected(small, above))
            found = stored(found.join(above.selectExpr("node c", "c up"), "c").selectExpr("node", "up c"))
            small = _contracted(small, above)
        if best is not None and quality <= best + LEAST:
            break
        membership, best = found, quality
    names = membership.groupBy("c").agg(F.min("node").alias("community"))
    return stored(membership.join(names, "c").select("node", "community"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> float:
    """The modularity of membership (node, community) of all nodes of edges (source, target, weight)."""
    both = _weighted(edges)
    a, b = membership.selectExpr("node at", "community ca"), membership.selectExpr("node to", "community cb")
    met = both.join(a, "at").join(b, "to").groupBy("ca").agg(F.sum("w").alias("size"), F.sum(F.expr("if(ca = cb, w, 0D)")).alias("inside"))
    total, inside, squares = met.agg(F.sum("size"), F.sum("inside"), F.sum(F.col("size") * F.col("size"))).first()
    return inside / total - resolution * squares / total**2


def community_levels(
    edges: DataFrame, levels: int = 3, resolution: float = 1.0, min_size: int = 3, coarser: float = 1.5
) -> DataFrame:
    """(level, community, node): communities of the graph, of the graph of these communities, and so on.

    The resolution of a level is `resolution` divided by `coarser` for each level below it. Level 0 keeps
    communities of min_size nodes or more, higher ones those of two communities or more; the others go,
    and are not part of higher levels. It ends before a level whose graph has at most min_size nodes or
    whose communities are fewer than two, and behind one whose communities no edge joins. A community
    is named after its smallest node, at higher levels after its smallest community.
    """
    current, members, out = edges.select("source", "target", F.col("weight").cast("double").alias("weight")), None, None
    empty = edges.selectExpr("0 level", "source community", "source node").where("false")
    count = _weighted(current).select("at").distinct().count()
    for level in range(levels):
        if count <= min_size:
            break
        found = modularity_communities(current, resolution / coarser**level)
        sizes = found.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= (min_size if level == 0 else 2))
        found = stored(found.join(sizes.select("community"), "community", "left_semi").select("node", "community"))
        count = found.select("community").distinct().count()
        if count <= 1:
            break
        if members is None:
            members = found
        else:
            members = stored(members.join(found.selectExpr("node community", "community above"), "community").selectExpr("node", "above community"))
        own = members.select(F.lit(level).alias("level"), "community", "node")
        out = own if out is None else out.unionByName(own)
        a, b = found.selectExpr("node source", "community ca"), found.selectExpr("node target", "community cb")
        between = current.join(a, "source").join(b, "target").where("ca <> cb")
        current = stored(between.groupBy(F.least("ca", "cb").alias("source"), F.greatest("ca", "cb").alias("target")).agg(F.sum("weight").alias("weight")))
        if current.isEmpty():
            break
    return empty if out is None else out
