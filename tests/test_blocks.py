"""Nearest points by blocks: equal to brute force, and no plan lists pairs that are not among the nearest."""

import math
import random

import numpy as np
import pytest

from stratavox.operators import spatial
from tests.test_nearest import clusters, frame


def most_rows(spark, run):
    """What ``run`` gives, and the most rows that any operator of its plans put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    idle = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    idle()
    done = store.executionsCount()
    out = run()
    idle()
    most, every = 0, store.executionsList()
    assert every.size() > done
    for k in range(done, every.size()):
        values = store.executionMetrics(every.apply(k).executionId())
        metrics = every.apply(k).metrics()
        for m in map(metrics.apply, range(metrics.size())):
            found = values.get(m.accumulatorId())
            if m.name() == "number of output rows" and found.isDefined():
                most = max(most, int(found.get().replace(",", "")))
    return out, most


def cloud(seed, n):
    rnd = np.random.default_rng(seed)
    return [tuple(map(float, p)) for p in rnd.normal(scale=0.12, size=(n, 3))]


def squared(a, b):
    x, y, z = (v - u for u, v in zip(a, b, strict=True))
    return x * x + y * y + z * z  # sum() would round otherwise


def brute(queries, points, k, radius):
    out = set()
    for q, a in enumerate(queries):
        near = sorted((d, p) for p, b in enumerate(points) if (d := squared(a, b)) < radius * radius)[:k]
        out |= {(q, p, d, i) for i, (d, p) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize(("k", "radius", "split"), [(3, 0.05, 512), (20, 1.0, 8), (500, 1.5, 16)])
def test_radius_top_equals_brute_force(spark, monkeypatch, k, radius, split):
    monkeypatch.setattr(spatial, "SPLIT", split)
    points = clusters(5)
    queries = points[::5] + [(1e4, -1e4, 3.0), (0.5, 0.5, 0.0)]
    odd = [(math.nan, 0, 0), (math.inf, 0, 0), (0, -math.inf, 0)]
    found = spatial.radius_top(frame(spark, queries + odd, "qid"), frame(spark, points + odd, "pid"), radius, k).collect()
    assert {(r.qid, r.pid, r.d2, r["rank"]) for r in found} == brute(queries, points, k, radius)
    assert all((r.qx, r.qy, r.qz) == tuple(map(float, queries[r.qid])) and (r.x, r.y, r.z) == tuple(map(float, points[r.pid])) for r in found)


def test_leaves_are_even_on_planes_lines_and_copies(spark):
    rnd = random.Random(2)
    for rows in ([(rnd.random(), 0.0, rnd.random() * 3) for _ in range(400)], [(1.0, 2.0, float(i % 7)) for i in range(400)], [(0.0, 0.0, 0.0)] * 400):
        dealt = spatial.Packed.of(frame(spark, rows, "id"), 10, "rows").rows.groupBy("leaf").count().collect()
        assert sum(r["count"] for r in dealt) == 400 and 10 <= min(r["count"] for r in dealt) and max(r["count"] for r in dealt) <= 30


def test_normals_do_not_list_all_pairs_within_the_radius(spark):
    points = cloud(1, 1500)
    found, most = most_rows(spark, lambda: spatial.estimate_normals(frame(spark, points, "pid"), 16, 2.0).collect())
    assert most < 60 * len(points)  # 1,500 for each point before
    at = np.array(points)
    assert len(found) == len(points)
    for r in found[::100]:
        near = at[np.argsort(((at - at[r.pid]) ** 2).sum(axis=1), kind="stable")[1:16]]
        assert r.n == 15 and abs(abs(np.linalg.eigh(np.cov(near.T))[1][:, 0] @ (r.nx, r.ny, r.nz)) - 1) < 1e-6


def test_the_nearest_within_a_radius_do_not_list_all_pairs_within_it(spark):
    points = cloud(2, 1500)
    found, most = most_rows(spark, lambda: spatial.radius_top(frame(spark, points, "qid"), frame(spark, points, "pid"), 2.0, 8).collect())
    assert most < 60 * len(points)  # 1,500 for each point before
    assert len(found) == 8 * len(points) and {(r.qid, r.pid, r.d2, r["rank"]) for r in found if r.qid < 20} == brute(points[:20], points, 8, 2.0)


def test_copies_meet_only_as_many_as_are_asked_for(spark):
    points = cloud(3, 40) * 30
    found, most = most_rows(spark, lambda: spatial.radius_top(frame(spark, points, "qid"), frame(spark, points, "pid"), 2.0, 5).collect())
    assert most < 60 * len(points)
    assert {(r.qid, r.pid, r["rank"]) for r in found} == {(q, q % 40 + 40 * i, i + 1) for q in range(len(points)) for i in range(5)}


def test_votes_of_the_sampler_keep_few_rows_a_sample(spark):
    points, samples = cloud(4, 2500), cloud(5, 2500)
    surface = spark.createDataFrame([(i, *p, *p) for i, p in enumerate(points)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    found, most = most_rows(spark, lambda: spatial.vote_sdf(frame(spark, samples, "qid"), surface, 3, 0.06).collect())
    assert most < 60 * len(samples)  # cells to descend through were some hundreds for each sample before
    assert len(found) == len(samples)
    for r in found[::50]:
        near = sorted((squared(samples[r.qid], p), i) for i, p in enumerate(points))[:3]
        sides = [sum(n * (s - p) for n, s, p in zip(points[i], samples[r.qid], points[i], strict=True)) for _, i in near]
        if len({s > 0 for s in sides}) == 2:
            assert math.isnan(r.sdf)
        else:
            size = math.sqrt(near[0][0])
            assert r.sdf == pytest.approx((abs(sides[0]) if size < 0.06 else size) * (1 if sides[0] > 0 else -1))
