"""Blocked similarity, matching, mixtures and retrieval against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import similarity
from docquarry.operators.matching import greedy_pairs, greedy_vectors
from docquarry.operators.mixture import SETTLED, SLACK, STEPS, mixtures
from docquarry.operators.vector import AdaptiveK, adaptive_k, retrieve


@pytest.fixture(scope="module")
def vectors(spark):
    """A hot label, copies of one vector, and rows that take no part."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5)], 0 if i % 3 else int(i) % 4) for i in rng.permutation(90)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0], 0) for i in range(200, 216)]
    odd = [(300, None, 0), (301, [], 0), (302, [0.0] * 5, 0), (303, [1.0, float("nan"), 0.0, 0.0, 0.0], 0), (304, [None, 1.0, 0.0, 0.0, 0.0], 0), (305, [1.0, 2.0], 0), (None, [1.0] * 5, 0), (306, [1.0] * 5, None)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    sound = {i: (v, g) for i, v, g in rows if any(v)} | {305: ([1.0, 2.0], 0)}
    return frame, sound


def scores(sound, same_label=True):
    out = {}
    for a, (u, g) in sound.items():
        for b, (v, h) in sound.items():
            if a != b and len(u) == len(v) and (g == h or not same_label):
                out[a, b] = round(float(np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v))), 6)
    return out


def best(found, k, least=-2.0):
    """The k highest of each first id, ties to the smaller second one."""
    by = {}
    for (a, b), s in found.items():
        by.setdefault(a, []).append((-s, b))
    return {(a, b, -s) for a, row in by.items() for s, b in sorted(row)[:k] if -s >= least}


def close(got, want):
    key = {(a, b): s for a, b, s in want}
    assert {(a, b) for a, b, _ in got} == set(key)
    assert all(abs(s - key[a, b]) < 2e-6 for a, b, s in got)


@pytest.mark.parametrize("size", [4096, 16])
def test_nearest_of_each_row(vectors, size):
    frame, sound = vectors
    got = similarity.nearest(frame, 3, 0.2, size=size).collect()
    close(got, best({p: s for p, s in scores(sound).items() if p[0] < p[1]}, 3, 0.2))


@pytest.mark.parametrize("size", [4096, 16])
def test_nearest_of_queries(vectors, size):
    frame, sound = vectors
    got = similarity.nearest(frame, 5, queries=frame.where("vec_id % 7 = 0"), group=None, size=size).collect()
    close(got, best({p: s for p, s in scores(sound, False).items() if p[0] % 7 == 0}, 5))


@pytest.mark.parametrize("size", [4096, 16])
def test_pairs_and_bands(vectors, size):
    frame, sound = vectors
    all_pairs = {p: s for p, s in scores(sound).items() if p[0] < p[1]}
    close(similarity.pairs_above(frame, 0.9, size=size).collect(), {(a, b, s) for (a, b), s in all_pairs.items() if s >= 0.9})
    across = similarity.pairs_above(frame.where("label = 1"), 0.3, frame.where("label = 0"), group=None, size=size).collect()
    close(across, {(a, b, s) for (a, b), s in scores(sound, False).items() if sound[a][1] == 1 and sound[b][1] == 0 and s >= 0.3})
    for r in similarity.bands(frame, size=size).collect():
        own = [s for (a, _), s in all_pairs.items() if sound[a][1] == r.label]
        assert (r.n, round(r.total, 4), r.top) == (len(own), round(sum(own), 4), max(own))


def test_no_vectors(vectors):
    frame, _ = vectors
    none = frame.where("vec_id < 0")
    assert similarity.nearest(none, 3).count() == similarity.pairs_above(none, 0.1).count() == similarity.bands(none).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_greedy_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b, round(rng.random(), 1)) for a in range(12) for b in range(12) if rng.random() < 0.5] + [(None, 1, 1.0), (1, None, 1.0), (1, 2, None)]
    pairs += pairs[:5] if seed else [(a, a + d, 1 - a / 50 - d / 100) for a in range(20, 30) for d in (0, 1)]  # a chain
    lefts, rights, want = set(), set(), []
    for a, b, s in sorted((p for p in pairs if None not in p), key=lambda p: (-p[2], p[0], p[1])):
        if a not in lefts and b not in rights:
            want.append((a, b, s))
            lefts.add(a)
            rights.add(b)
    frame = spark.createDataFrame(pairs, "left long, right long, score double")
    assert sorted(map(tuple, greedy_pairs(frame).collect())) == sorted(want)
    assert greedy_pairs(frame.where("score > 5")).count() == 0


def test_greedy_vectors_hold_a_few_pairs_of_each_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(48, 4))
    v[40:46] = v[10]  # copies, all with the same neighbours
    sides = [[(i, x.tolist()) for i, x in enumerate(v) if i % 2 == side] + [(900 + side, None), (902 + side, [0.0] * 4)] for side in (0, 1)]
    left, right = (spark.createDataFrame(rows, "vec_id long, embedding array<double>") for rows in sides)
    u = v / np.sqrt((v * v).sum(1))[:, None]
    pairs = [(round(float(u[a] @ u[b]), 6), a, b) for a in range(0, 48, 2) for b in range(1, 48, 2)]
    lefts, rights, want = set(), set(), []
    for s, a, b in sorted((p for p in pairs if p[0] >= 0.1), key=lambda p: (-p[0], p[1], p[2])):
        if a not in lefts and b not in rights:
            want.append((a, b))
            lefts.add(a)
            rights.add(b)
    sizes, real = [], similarity.best_partners
    monkeypatch.setattr(similarity, "best_partners", lambda q, r, k, *rest: sizes.append((k, (found := real(q, r, k, *rest, size=16)).count())) or found)
    got = greedy_vectors(left, right, 0.1, kept=1, few=8)
    assert sorted((r.left, r.right) for r in got.collect()) == sorted(want)
    assert all(k == 8 and n <= 8 * 24 for k, n in sizes)
    assert greedy_vectors(left, right, 1.5).count() == 0


def plain_mixture(x):
    x = np.array(sorted(x))
    w, m, v = 0.5, np.array([x[0], x[-1]]), np.full(2, x.var() + SLACK)
    for _ in range(STEPS):
        p = np.stack([np.log(w) - 0.5 * np.log(v[0]) - (x - m[0]) ** 2 / (2 * v[0]), np.log(1 - w) - 0.5 * np.log(v[1]) - (x - m[1]) ** 2 / (2 * v[1])])
        r = 1 / (1 + np.exp(p[1] - p[0]))
        r = np.stack([r, 1 - r])
        n = np.maximum(r.sum(1), 1e-12)
        new = (r @ x) / n
        v = np.maximum((r @ (x * x)) / n - new**2, 0) + SLACK
        w, moved, m = min(max(n[0] / len(x), 1e-12), 1 - 1e-12), np.abs(new - m).max(), new
        if moved < SETTLED:
            break
    return (m[0], m[1], w) if m[0] <= m[1] else (m[1], m[0], 1 - w)


def test_mixtures_are_those_of_numpy(spark):
    rng = random.Random(9)
    lists = {g: [rng.gauss(0.8 if i % (2 + g) == 0 else 0.3, 0.05) for i in range(4 + 3 * g)] for g in range(6)}
    lists[7], lists[8] = [0.5, 0.5, 0.9], [0.4] * 5
    frame = spark.createDataFrame([(g, s) for g, x in lists.items() for s in x] + [(7, None)], "g int, score double")
    for r in mixtures(frame, "g").collect():
        low, high, w = plain_mixture(lists[r.g])
        assert r.n == len(lists[r.g])
        assert (r.low, r.high, r.low_weight) == pytest.approx((low, high, w), abs=1e-6)
        assert r.threshold == pytest.approx(np.mean(lists[r.g]), abs=1e-6) and r.low - 1e-9 <= r.threshold <= r.high + 1e-9


def test_adaptive_cut_by_mixture(spark):
    rows = [(1, i, s) for i, s in enumerate([0.9, 0.88, 0.87, 0.2, 0.18, 0.15])] + [(2, 1, 0.5), (2, 2, 0.4)] + [(3, i, 0.5 + i / 1000) for i in range(5)]
    got = adaptive_k(spark.createDataFrame(rows, "g int, id int, score double"), "g", "id", AdaptiveK(method="gmm", max_k=2)).collect()
    assert sorted((r.g, r.id, r.method) for r in got) == [(1, 0, "gmm"), (1, 1, "gmm"), (2, 1, "passthrough"), (2, 2, "passthrough"), (3, 4, "unimodal_fallback")]
    assert {r.g: r.threshold for r in got} == {1: 0.53, 2: 0.0, 3: 0.5}
    with pytest.raises(ValueError):
        AdaptiveK(method="other")


def test_retrieval(spark, vectors):
    frame, sound = vectors
    pages = frame.where("label is not null").selectExpr("vec_id page_id", "concat('d', label) document_id", "cast(vec_id % 9 + 1 as int) page_number", "embedding")
    asked = pages.where("page_id in (1, 2, 200)")
    got = retrieve(pages, asked, 4).collect()
    assert {r.query_id for r in got} == {1, 2, 200} and max(r.rank for r in got) <= 4
    want = {(a, b): max(0.0, min(1.0, s)) for a, b, s in best(scores(sound, False), 20) if a in (1, 2, 200)}
    assert all(abs(want[r.query_id, r.page_id] - r.score) < 2e-6 for r in got)
    assert {r.document_id for r in retrieve(pages, asked, 4, document="d1").collect()} == {"d1"}
    categories = spark.createDataFrame([("d1", "a"), ("d2", "a"), ("d0", "b")], "document_id string, category string")
    assert {r.document_id for r in retrieve(pages, asked, 9, category="a", categories=categories).collect()} <= {"d1", "d2"}
    with pytest.raises(ValueError, match="no category"):
        retrieve(pages, asked, 4, category="c", categories=categories)
    with pytest.raises(Exception, match="page_number must be 1"):
        retrieve(pages.withColumn("page_number", F.lit(0)), asked, 4).collect()
