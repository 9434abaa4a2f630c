"""Nearest points by a descent through cells, against brute force on clusters with outliers, ties and copies."""

import random

import pytest

from stratavox.operators import spatial


def clusters(seed, n=260):
    rnd = random.Random(seed)
    rows = []
    for _ in range(3):
        at, size = [rnd.uniform(-5, 5) for _ in range(3)], rnd.choice([1e-4, 0.01, 0.5])
        rows += [tuple(a + rnd.gauss(0, size) for a in at) for _ in range(n // 4)]
    rows += [tuple(rnd.uniform(-400, 400) for _ in range(3)) for _ in range(6)]
    rows += [rows[0]] * 90 + [(float(i % 4), float(i // 4 % 4), 0.0) for i in range(48)]
    return rows


def frame(spark, rows, key):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"{key} long, x double, y double, z double").repartition(3)


def brute(queries, points, k):
    out = {}
    for q, a in enumerate(queries):
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), p) for p, b in enumerate(points))[:k]
        out[q] = [p for _, p in near]
    return out


@pytest.mark.parametrize(("seed", "k", "split"), [(1, 4, 64), (2, 11, 8), (3, 1, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, k, split):
    monkeypatch.setattr(spatial, "SPLIT", split)
    points = clusters(seed)
    queries = points[::7] + [(1e4, -1e4, 3.0), (0.5, 0.5, 0.0)]
    found = {}
    for r in spatial.k_nearest(frame(spark, queries, "qid"), frame(spark, points, "pid"), k).collect():
        found.setdefault(r.qid, {})[r.rank] = r.pid
    assert {q: [x[i] for i in range(1, len(x) + 1)] for q, x in found.items()} == brute(queries, points, k)


def test_few_points_none_and_wrong_ones(spark):
    two, nan, inf = [(0, 0, 0), (1, 1, 1)], [(float("nan"), 0, 0)], [(float("inf"), 0, 0)]
    found = spatial.k_nearest(frame(spark, [(0.1, 0, 0), *nan], "qid"), frame(spark, two + nan, "pid"), 5).collect()
    assert [(r.qid, r.pid, r.rank) for r in found] == [(0, 0, 1), (0, 1, 2)]
    assert spatial.k_nearest(frame(spark, two, "qid"), frame(spark, nan, "pid"), 5).count() == 0
    assert spatial.k_nearest(frame(spark, nan, "qid"), frame(spark, two, "pid"), 5).count() == 0
    for queries, points in ((inf, two), (two, inf + two)):
        with pytest.raises(ValueError, match="infinite"):
            spatial.k_nearest(frame(spark, queries, "qid"), frame(spark, points, "pid"), 2)
