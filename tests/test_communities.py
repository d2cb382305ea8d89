"""Communities by modularity against all partitions, label propagation and the rules of levels."""

import random

import pytest

from docquarry.operators import graph
from docquarry.operators.modularity import community_levels, modularity, modularity_communities

EDGES = "source long, target long, weight double"


def quality(edges, part, resolution=1.0):
    total, inside, size = 0.0, 0.0, {}
    for a, b, w in edges:
        if a != b:
            total += 2 * w
            inside += 2 * w * (part[a] == part[b])
            for x in (a, b):
                size[part[x]] = size.get(part[x], 0) + w
    return inside / total - resolution * sum(k * k for k in size.values()) / total**2


def partitions(n):
    def grow(labels, used):
        if len(labels) == n:
            yield labels
            return
        for c in range(used + 1):
            yield from grow([*labels, c], max(used, c + 1))

    return grow([], 0)


def clique(nodes, weight=1.0):
    nodes = list(nodes)
    return [(a, b, weight) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


def found(spark, edges, resolution=1.0):
    return {r.node: r.community for r in modularity_communities(spark.createDataFrame(edges, EDGES), resolution).collect()}


def connected(edges, part):
    for c in set(part.values()):
        own = {n for n in part if part[n] == c}
        seen, todo = set(), [min(own)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b if a == n else a for a, b, _ in edges if n in (a, b) and {a, b} <= own]
        if seen != own:
            return False
    return True


RNG = random.Random(5)
GRAPHS = {
    "triangles": clique(range(3)) + clique(range(3, 6)) + [(0, 3, 0.5)],
    "path": [(i, i + 1, 1.0) for i in range(6)],
    "ring of triangles": clique(range(3)) + clique(range(3, 6)) + clique(range(6, 9)) + [(2, 3, 1.0), (5, 6, 1.0), (8, 0, 1.0)],
    "star with loops and repeats": [(0, i, 1.0) for i in range(1, 7)] + [(0, 0, 5.0), (1, 0, 1.0), (2, 2, 1.0)],
    "random": [(a, b, float(RNG.randrange(1, 4))) for a in range(8) for b in range(a + 1, 8) if RNG.random() < 0.4],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_best_of_all_partitions(spark, name):
    edges = GRAPHS[name]
    part = found(spark, edges)
    nodes = 1 + max(max(a, b) for a, b, _ in edges)
    assert quality(edges, part) == pytest.approx(max(quality(edges, dict(enumerate(p))) for p in partitions(nodes)), abs=1e-9)
    assert connected(edges, part)
    assert all(c == min(n for n in part if part[n] == c) for c in part.values())
    frame = spark.createDataFrame(edges, EDGES)
    own = spark.createDataFrame(sorted(part.items()), "node long, community long")
    assert modularity(frame, own) == pytest.approx(quality(edges, part))
    plain = {r.node: r.community for r in graph.label_communities(frame, min_size=1).collect()}
    assert quality(edges, part) >= quality(edges, {n: plain.get(n, n) for n in part}) - 1e-9


def test_a_larger_graph_is_no_worse_than_labels(spark):
    rng = random.Random(1)
    edges = [(a, b, 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.5 if a // 12 == b // 12 else 0.05)]
    part, frame = found(spark, edges), spark.createDataFrame(edges, EDGES)
    plain = {r.node: r.community for r in graph.label_communities(frame, min_size=1).collect()}
    assert connected(edges, part)
    assert quality(edges, part) >= quality(edges, plain)
    assert quality(edges, part) >= quality(edges, {n: n // 12 for n in part}) - 1e-9


def test_odd_edges(spark):
    assert found(spark, [(1, 1, 1.0), (None, 2, 1.0), (3, 4, 0.0), (5, 6, -1.0), (7, 8, None)]) == {}
    assert found(spark, [(1, 2, 1.0), (None, 2, 1.0)]) == {1: 1, 2: 1}


def levels(spark, edges, **more):
    out = {}
    for r in community_levels(spark.createDataFrame(edges, EDGES), **more).collect():
        out.setdefault(r.level, {}).setdefault(r.community, set()).add(r.node)
    return out


def test_levels_and_their_stop_rules(spark):
    # four pairs of cliques: cliques at level 0, pairs of them above, then nothing joins the pairs
    cliques = [range(10 * k, 10 * k + 4) for k in range(8)]
    edges = [e for c in cliques for e in clique(c, 10.0)] + [(20 * k, 20 * k + 10, 1.0) for k in range(4)]
    got = levels(spark, edges)
    assert got[0] == {10 * k: set(c) for k, c in enumerate(cliques)}
    assert got[1] == {20 * k: set(cliques[2 * k]) | set(cliques[2 * k + 1]) for k in range(4)}
    assert set(got) == {0, 1}
    assert set(levels(spark, edges, levels=1)) == {0}
    # small communities go and are not part of higher levels
    small = edges + [(500, 501, 10.0), (500, 0, 0.1)]
    assert all(500 not in m and 501 not in m for level in levels(spark, small).values() for m in level.values())
    # one community alone gives no level, nor does a graph of too few nodes
    assert levels(spark, clique(range(5))) == {}
    assert levels(spark, clique(range(2)) + clique(range(5, 6))) == {}
    assert levels(spark, [(1, 1, 1.0)]) == {}


def test_no_table_of_communities_is_broadcast(spark, sf_dir, monkeypatch):
    """Tables of the rounds stay off the driver, small files or not."""
    from docquarry.operators import modularity
    from docquarry.plans import catalogue, shared

    plans, stored = [], modularity.stored

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(modularity, "stored", watched)
    monkeypatch.setattr(shared, "_made", {})
    for name in ("community_entities", "community_text_search", "visible_communities"):
        plans.append(catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)
