"""Connected components by alternating large-star and small-star steps.

A step is a grouped minimum, which combines before the shuffle, and an equality join of the links with
these minima. Both sides of the join are read from plain shuffles, so adaptive execution splits the
links of a hub over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.lineage import cut, drop, tidied

#: Links in a partition between rounds; so few tasks work on a graph of few links.
LINKS = 250_000


def _with_least(links: DataFrame, parts: int) -> DataFrame:
    """links with the smallest dst of their src as `low`."""
    least = links.groupBy("src").agg(F.min("dst").alias("low"))
    if parts > 1:
        # dealt anew, so that the minima come from a shuffle of their own
        least = least.hint("rebalance")
    return links.join(least, "src")


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Links each larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.selectExpr("dst src", "src dst")).coalesce(parts)
    met = _with_least(both, parts).where("dst > src")
    return met.selectExpr("dst src", "least(src, low) dst").distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """Links u and its smaller neighbours to the smallest of them; edges have src > dst."""
    met = _with_least(edges, parts)
    # the smallest neighbour itself stays linked to u
    moved = met.selectExpr("if(dst > low, dst, src) src", "low dst")
    return moved.distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first()


@tidied
def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link to another; component is its smallest node.

    edges has columns src and dst, both long; rows with a null end and self-links say nothing.
    No edges give an empty table.
    """
    edges = edges.where("src is not null and dst is not null and src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    edges = cut(edges.distinct())
    before = _mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        parts = 1 + before[0] // LINKS
        large = _large_star(edges.coalesce(parts), parts).coalesce(parts)
        then = cut(_small_star(large, parts).coalesce(parts))
        drop(edges)
        edges, after = then, _mark(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return members.unionByName(roots)
