import random

from docquarry.operators import entities, graph, state
from docquarry.operators.components import connected_components
from docquarry.operators.skew import spread_join
from docquarry.operators.vector import AdaptiveK, adaptive_k


def test_components_on_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(500, k) for k in range(200, 260)] + [(None, 1), (3, 3)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: find(k) for k in parent}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_spread_join_is_an_inner_join(spark):
    rows = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) k")
    facts = spark.createDataFrame([(7, "hot"), (8, "eight"), (99, "none")], "k long, name string")
    a = spread_join(rows, facts, "k").select("id", "k", "name")
    b = rows.join(facts, "k").select("id", "k", "name")
    assert sorted(a.collect()) == sorted(b.collect())


def cut_at(spark, scores, **config):
    rows = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(scores)], "g long, id long, score double")
    out = adaptive_k(rows, "g", "id", AdaptiveK(**config)).collect()
    return len(out), {r.method for r in out}


def test_adaptive_cut(spark):
    # fixed values: lists of scores and how many of them stay
    assert cut_at(spark, [0.85, 0.82, 0.78, 0.30, 0.25, 0.20], max_k=10) == (3, {"otsu"})
    assert cut_at(spark, [0.95, 0.90, 0.88, 0.10, 0.08, 0.05], max_k=10) == (3, {"otsu"})
    assert cut_at(spark, [0.90, 0.89, 0.88, 0.87, 0.86], min_k=2) == (2, {"unimodal_fallback"})
    assert cut_at(spark, [0.12, 0.11, 0.10, 0.09]) == (1, {"unimodal_fallback"})
    assert cut_at(spark, [0.9, 0.8]) == (2, {"passthrough"})
    assert cut_at(spark, [0.9, 0.5, 0.48, 0.1, 0.08], min_k=3)[0] >= 3
    assert cut_at(spark, [0.9, 0.5, 0.1, 0.05], enabled=False, max_k=3) == (3, {"passthrough"})


def test_neighbourhood_against_paths(spark):
    rng = random.Random(4)
    edges = [(i, rng.randrange(6), rng.randrange(6)) for i in range(9)]
    for depth in (0, 1, 2, 3):
        frame = spark.createDataFrame(edges, "relationship_id long, source long, target long")
        got = {r.relationship_id: r.hop for r in graph.neighbourhood(frame, 0, depth).collect()}
        distance, step = {0: 0}, 0
        while step < 6:
            step += 1
            for _, a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if distance.get(x) == step - 1 and y not in distance:
                        distance[y] = step
        want = {}
        for i, a, b in edges:
            hop = min(distance.get(a, 99), distance.get(b, 99)) + 1
            if hop <= max(depth, 1) and (a != b or a == 0):
                want[i] = hop
        assert got == want


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(0, 10, 0.1)]
    found = graph.label_communities(spark.createDataFrame(edges, "source long, target long, weight double"))
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]


def test_streaks(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("fffsff")], "k long, i long, r string")
    got = [r.run for r in state.streaks(rows, "k", ["i"], "r = 'f'").orderBy("i").collect()]
    assert got == [1, 2, 3, 0, 1, 2]


def test_chains_end_and_cycles_end_at_their_smallest(spark):
    links = [(i, i + 1) for i in range(1, 9)] + [(20, 21), (21, 22), (22, 20), (30, 21)]
    got = {r.node: r.final for r in graph.chain_ends(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 9 for i in range(1, 9)}, 20: 20, 21: 20, 22: 20, 30: 20}


def test_upserts_of_null_keys_and_maps(spark):
    schema = "k long, name string, m map<string,string>"
    base = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (None, "b", None), (3, "c", {"z": "1"})], schema)
    new = spark.createDataFrame([(1, "A", {"y": "3"}), (None, "B", {"n": "1"}), (4, "D", None)], schema)
    got = {r.k: (r.name, r.m) for r in entities.upserted(base, new, ["k"], ["name"], patch=["m"]).collect()}
    assert got == {1: ("A", {"x": "1", "y": "3"}), None: ("B", {"n": "1"}), 3: ("c", {"z": "1"}), 4: ("D", {})}
    assert {r.k: r.name for r in entities.upserted(base, new.where("k is null"), ["k"], ["name"]).collect()}[None] == "B"


def test_depth_is_bounded(spark):
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(9)], "relationship_id long, source long, target long")
    assert {r.relationship_id for r in graph.neighbourhood(edges, 0, 8).collect()} == set(range(graph.DEEPEST))
