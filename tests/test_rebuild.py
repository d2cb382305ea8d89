"""The composed rebuild of a graph, and what caches answer."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docquarry.operators import caches, rebuild, state
from docquarry.sources import files

ENTITIES = "entity_id long, name string, kind string, description string, pages array<int>, embedding array<double>"
EDGES = "relationship_id long, source long, target long, kind string, weight double"


@pytest.fixture
def graph(spark):
    axis = lambda i, more=0.0: [1.0 if k == i else more for k in range(6)]
    rows = [(i, f"e{i}", "A", f"d{i}", [i, 1], axis(i % 6)) for i in range(6)]
    rows += [(10, "E0", "A", "longer", [7], axis(0)), (11, "e0", "B", None, None, None), (12, "near1", "A", "d1", [9], axis(1, 0.01)), (13, "half", "A", None, [3], axis(2, 0.4))]
    rows += [(20 + i, f"f{i}", "C", None, [], None) for i in range(4)]
    links = [(i, a, b, "r", 1.0) for i, (a, b) in enumerate([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (20, 21), (21, 22), (22, 23), (20, 22), (2, 3)])]
    links += [(50, 10, 1, "r", 9.0), (51, 0, 10, "r", 1.0), (52, 12, 2, "s", 1.0)]
    return spark.createDataFrame(rows, ENTITIES), spark.createDataFrame(links, EDGES)


def embed(entities):
    new = F.expr("transform(sequence(0, 5), k -> if(k = if(entity_id = 10, 0, entity_id % 6), 5D, cast(entity_id as double) / 100))")
    return entities.withColumn("embedding", F.coalesce("embedding", new))


def test_a_whole_run(spark, graph, tmp_path):
    path = str(tmp_path / "communities")
    done = rebuild.rebuild(*graph, embed=embed, save=lambda c: files.replace_table(c, path))
    assert done.stats["exact"] == {"merged": 1, "removed": 1}
    assert done.stats["embed"] == {"embedded": 6}  # 10, which took in 0, 11 and four of kind C
    assert done.stats["semantic"]["removed"] >= 1 and done.stats["embed again"]["embedded"] == done.stats["semantic"]["merged"]
    rows = {r.entity_id: r for r in done.entities.collect()}
    assert 0 not in rows and 12 not in rows
    assert rows[10].name == "E0" and rows[10].description == "longer | d0" and rows[10].pages == [0, 1, 7]
    assert rows[1].description == "d1" and rows[1].pages == [1, 9] and rows[1].embedding is not None
    edges = {(r.source, r.target, r.kind): (r.relationship_id, r.weight) for r in done.edges.collect()}
    assert edges[10, 1, "r"] == (0, 1.0) and edges[1, 2, "s"] == (52, 1.0) and (10, 10, "r") not in edges
    assert done.stats["total"] == {"entities": len(rows), "edges": len(edges)}
    saved = spark.read.parquet(path).collect()
    assert len(saved) == done.stats["communities"]["found"] == done.stats["save"]["saved"]
    assert {tuple(r.nodes) for r in saved if r.level == 0} == {(1, 2, 10), (3, 4, 5), (20, 21, 22, 23)}
    assert {r.title for r in saved if r.level == 0} == {"Community L0"}


def test_a_stage_that_fails_stops_no_other(spark, graph):
    def broken(entities):
        return entities.withColumn("embedding", F.expr("if(entity_id > 0, raise_error('no embedder'), embedding)"))

    done = rebuild.rebuild(*graph, embed=broken)
    assert "no embedder" in done.stats["embed"]["error"]
    assert done.stats["exact"]["removed"] == 1 and done.stats["total"]["entities"] == done.entities.count()
    assert done.stats["communities"]["found"] > 0 and done.communities is not None

    def fails(_):
        raise OSError("no room")

    done = rebuild.rebuild(*graph, dedup=False, save=fails)
    assert done.stats["save"] == {"error": "no room"} and set(done.stats) == {"total", "communities", "save"}


def test_pairs_that_are_asked_about(spark, graph):
    entities, edges = graph
    confirmed = rebuild.semantic_mapping(entities, 0.7, agrees=lambda pairs: pairs.where("id1 = 2"))
    assert {(r.entity_id, r.canonical_id) for r in confirmed.collect()} >= {(13, 2), (12, 1)}
    assert 13 not in {r.entity_id for r in rebuild.semantic_mapping(entities, 0.7).collect()}
    few = rebuild.rebuild(entities.limit(2), edges.where("false"), semantic=False)
    assert few.stats["communities"] == {"found": 0} and few.communities is None


def asked(seed, n=300):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(rng.choice("ab"), f"k{int(rng.paretovariate(0.6)) % 30}", i, start + timedelta(seconds=rng.randrange(400))) for i in range(n)]


@pytest.mark.parametrize(("size", "ttl"), [(5, None), (1, None), (None, 30), (6, 60), (100, 1)])
def test_caches(spark, size, ttl):
    rows = asked(size or 0)
    want, held = {}, {}
    for cache, key, i, ts in sorted(rows, key=lambda r: (r[3], r[2])):
        own = held.setdefault(cache, {})  # key: (used or None, expires)
        hit = key in own and (ttl is None or ts < own[key][1])
        want[i] = hit
        if hit:
            own[key] = (i, own[key][1], ts)
            continue
        own.pop(key, None)
        if size and len(own) >= size:
            if ttl:
                for old in [k for k, v in own.items() if v[1] <= ts]:
                    del own[old]
            if len(own) >= size:
                del own[_oldest(own, ttl)]
        own[key] = (i, ts + timedelta(seconds=ttl or 0), ts)
    frame = spark.createDataFrame(rows, "cache string, key string, ask_id long, ts timestamp")
    hits = caches.cache_hits(frame, size, ttl)
    assert {r.ask_id: r.hit for r in hits.collect()} == want
    for r in caches.hit_rates(hits).collect():
        own = [want[i] for c, _, i, _ in rows if c == r.cache]
        assert (r.hits, r.misses, r.hit_rate) == (sum(own), len(own) - sum(own), round(sum(own) / len(own), 3))


def _oldest(own, ttl):
    """The key that expires first, or the one used longest ago."""
    return min(own, key=lambda k: (own[k][1], own[k][0]) if ttl else (own[k][2], own[k][0]))


def test_repeated_failures(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("fsffssfsfff")] + [(2, 0, "f"), (2, 1, "f")], "k long, i long, r string")
    got = {(r.k, r.i) for r in state.repeated_failures(rows, "k", ["i"], "r = 'f'").where("stop").collect()}
    assert got == {(1, 3), (1, 4), (1, 9), (1, 10), (2, 1)}
