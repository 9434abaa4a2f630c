"""Operators on small inputs: boundaries, ties, empty tables, brute force and known shapes."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.functions import geometry as geo
from stratavox.functions import mlp, pose
from stratavox.operators import grid, image, mesh, reduce, sample, scan, spatial, track
from stratavox.plans.catalogue import EPTS, PTS

NAN = float("nan")


def cloud(spark, rows, key="pid"):
    return spark.createDataFrame(rows, f"{key} long, x double, y double, z double")


def test_cells_are_open_below_and_closed_above(spark):
    rows = [(0.5, 0.5, 0.5), (0.5000001, 0.1, 0.1), (0.0, 1.0, 1.0), (NAN, 1.0, 1.0), (5.0, 5.0, 5.0), (5.1, 1.0, 1.0)]
    found = PTS.cells(spark.createDataFrame(rows, "x double, y double, z double")).select("x", "lin_id").collect()
    assert {(r.x, r.lin_id) for r in found} == {(0.5, 0), (0.5000001, 100), (5.0, 999)}


def test_linear_ids_come_back(spark):
    ids = spark.range(1000).select(F.col("id").alias("lin_id"))
    gx, gy, gz = PTS.axes(F.col("lin_id"))
    assert ids.where(PTS.linear(gx, gy, gz) != F.col("lin_id")).count() == 0


def test_prune_keeps_strictly_more(spark):
    rows = [(0.1, 0.1, 0.1)] * 16 + [(0.9, 0.1, 0.1)] * 17
    points = spark.createDataFrame(rows, "x double, y double, z double")
    assert grid.prune(points, PTS, 16).count() == 17
    assert grid.prune(points, PTS, 0).count() == 33


def test_dilate_clamps(spark):
    found = grid.dilate(spark.createDataFrame([(0,)], "lin_id long"), PTS)
    assert {r.lin_id for r in found.collect()} == {0, 1, 10, 100}


def test_scatter_keeps_clamped_repeats(spark):
    points = spark.createDataFrame([(0.1, 0.1, 0.1)], "x double, y double, z double")
    every = spark.range(1000).select(F.col("id").alias("lin_id"))
    assert Counter(r.lin_id for r in grid.scatter8(points, PTS, every).collect()) == {0: 8}


def test_downsample_of_an_empty_cloud(spark):
    assert grid.downsample(spark.createDataFrame([], "x double, y double, z double"), 0.5).count() == 0


def test_downsampled_means_are_those_of_exact_sums_in_any_order(spark):
    rnd = random.Random(3)
    tenths = [k / 10 for k in range(1, 50)] * 13 + [4.6, 4.7, 0.3]  # 640 rows
    rows = [(x, 0.1, 3.0 * rnd.random() - 1.5, 1e9 * (rnd.random() - 0.5)) for x in tenths]
    wanted = [math.fsum(r[i] for r in rows) / len(rows) for i in range(4)]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        cloud = spark.createDataFrame(rows, "x double, y double, z double, w double").repartition(1 + seed)
        (found,) = grid.downsample(cloud, 100.0, ("w",)).collect()
        assert (found.n, [found.mx, found.my, found.mz, found.mw]) == (640, wanted)


def test_downsampled_means_without_finite_values(spark):
    inf = float("inf")
    rows = [(0.0, 0.0, 1.0, None, 0.0, NAN, inf, inf, 1.0), (0.0, 0.0, 3.0, None, 0.0, 1.0, 1.0, -inf, None), (0.0, 0.0, 5.0, None, 0.0, 1.0, 2.0, 1.0, 2.5)]
    cloud = spark.createDataFrame(rows, "x double, y double, z double, a double, b double, c double, d double, e double, f double")
    (found,) = grid.downsample(cloud, 100.0, tuple("abcdef")).collect()
    assert (found.mx, found.mz, found.ma, found.mb, found.md, found.mf) == (0.0, 3.0, None, 0.0, inf, 1.75)
    assert math.isnan(found.mc) and math.isnan(found.me)


def brute_nearest(queries, points, k):
    out = set()
    for q, *a in queries:
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), p) for p, *b in points)
        out |= {(q, p, r + 1) for r, (_, p) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("k", [1, 4, 50])
def test_nearest_equals_brute_force(spark, k):
    rnd = random.Random(k)
    rows = [(i, rnd.choice((0.0, 0.25, rnd.random())), rnd.random() * 3, 0.5) for i in range(40)] + [(90, 0.1, 0.1, 0.1), (91, 0.1, 0.1, 0.1)]
    found = spatial.k_nearest(cloud(spark, rows, "qid"), cloud(spark, rows), k, 0.2).collect()
    assert {(r.qid, r.pid, r["rank"]) for r in found} == brute_nearest(rows, rows, min(k, len(rows)))


def test_range_join_includes_its_edge(spark):
    q = cloud(spark, [(1, 0.0, 0.0, 0.0)], "qid")
    p = cloud(spark, [(1, 0.5, -0.5, 0.5), (2, 0.51, 0.0, 0.0), (3, NAN, 0.0, 0.0)])
    assert [r.pid for r in spatial.near_pairs(q, p, 0.5, chebyshev=True).collect()] == [1]
    assert spatial.near_pairs(q, cloud(spark, [(1, 0.5, 0.0, 0.0)]), 0.5).count() == 0


def test_normals_of_a_plane(spark):
    rows = [(5 * i + j, i * 0.1, j * 0.1, 1.0) for i in range(5) for j in range(5)] + [(99, 9.0, 9.0, 9.0)]
    found = {r.pid: r for r in spatial.estimate_normals(cloud(spark, rows), 9, 0.25).collect()}
    assert abs(found[12].nz + 1) < 1e-9 and abs(found[12].nx) < 1e-9
    assert math.isnan(found[99].nx)


def test_eigenvector_equals_numpy(spark):
    rnd = np.random.default_rng(1)
    made = [(lambda a: a @ a.T)(rnd.normal(size=(3, 3))) for _ in range(30)]
    rows = [tuple(float(m[a, b]) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))) for m in made]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    found = geo.with_smallest_eigenvector(df, [F.col(c) for c in "abcdef"], ["x", "y", "z"]).collect()
    by = {tuple(r[:6]): np.array([r.x, r.y, r.z]) for r in found}
    for row, m in zip(rows, made, strict=True):
        assert abs(abs(by[row] @ np.linalg.eigh(m)[1][:, 0]) - 1) < 1e-6


def test_votes(spark):
    surface = spark.createDataFrame([(i, 0.01 * i, 0.0, 0.0, 0.0, 0.0, 1.0 if i < 11 else -1.0) for i in range(12)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    samples = cloud(spark, [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, -1.0), (3, 0.11, 0.0, 1.0)], "qid")
    found = {r.qid: r.sdf for r in spatial.vote_sdf(samples, surface, 11, 0.05, 0.5).collect()}
    assert found[1] == 1.0 and found[2] == -1.0 and math.isnan(found[3])


def test_prefix_sums_over_blocks(spark):
    df = spark.range(1, 101).select(F.col("id"), (F.col("id") % 3).alias("g"))
    found = scan.prefix_sum(df, "id", "id", ["g"], block=7).collect()
    assert all(r.running == sum(k for k in range(1, r.id + 1) if k % 3 == r.g) for r in found)
    assert [r.place for r in scan.numbered(df, [], "id", block=9).orderBy("id").collect()] == list(range(1, 101))


def test_area_of_a_right_and_of_a_flat_triangle(spark):
    names = "ax ay az bx by_ bz cx cy cz".split()
    rows = [(0, *map(float, (0, 0, 0, 3, 0, 0, 0, 4, 0))), (1, *map(float, (0, 0, 0, 1, 1, 1, 2, 2, 2))), (2, *[1.0] * 9)]
    found = sample.areas(spark.createDataFrame(rows, "tri_id long, " + ", ".join(f"{n} double" for n in names)))
    a, b, c = (r.area for r in found.orderBy("tri_id").collect())
    assert abs(a - 6) < 1e-9 and b < 0.03 and c == 0  # rounding may put the cosine just outside, where it is kept off 1


def test_surface_samples_follow_area(spark):
    names = "ax ay az bx by_ bz cx cy cz".split()
    rows = [(0, *map(float, (0, 0, 0, 3, 0, 0, 0, 3, 0))), (1, *map(float, (0, 0, 1, 1, 0, 1, 0, 1, 1)))]
    found = sample.surface_samples(spark.createDataFrame(rows, "tri_id long, " + ", ".join(f"{n} double" for n in names)), 2000).collect()
    assert len(found) == 2000 and 0.85 < sum(r.tri_id == 0 for r in found) / 2000 < 0.95


def test_strata_draws(spark):
    df = spark.range(10).select(F.col("id").alias("k"), (F.col("id") > 6).alias("s"))
    found = sample.with_replacement(df, "s", "k", 20).collect()
    assert Counter(r.s for r in found) == {True: 20, False: 20} and all((r.k > 6) == r.s for r in found)


def test_merge_does_not_depend_on_the_split(spark):
    rows = [(i % 3, float(i), float(i * i)) for i in range(12)]
    state = spark.createDataFrame([], "k long, latent array<double>, obs_count double")
    for part in (rows[:5], rows[5:6], rows[6:]):
        df = spark.createDataFrame(part, "k long, a double, b double")
        state = reduce.running_mean_merge(state, df.groupBy("k").agg(F.array(F.sum("a"), F.sum("b")).alias("total"), F.count("*").alias("n")), "k")
    for r in state.collect():
        mine = [x for x in rows if x[0] == r.k]
        assert r.obs_count == len(mine) and np.allclose(r.latent, [np.mean([x[1] for x in mine]), np.mean([x[2] for x in mine])])


def test_merge_freezes_before_and_overshoots(spark):
    state = spark.createDataFrame([(1, [1.0], 599.0), (2, [1.0], 600.0)], "k long, latent array<double>, obs_count double")
    delta = spark.createDataFrame([(1, [5.0], 5), (2, [5.0], 5), (3, [4.0], 2)], "k long, total array<double>, n long")
    found = {r.k: (r.obs_count, r.latent[0]) for r in reduce.running_mean_merge(state, delta, "k", 600).collect()}
    assert found[1][0] == 604 and found[2] == (600.0, 1.0) and found[3] == (2.0, 2.0)


def test_ema_skips_what_is_missing(spark):
    rows = [(1, 1.0), (2, NAN), (3, 2.0), (4, None), (5, 3.0)]
    df = spark.createDataFrame(rows, "i long, v double").withColumn("k", F.lit("a"))
    found = reduce.ordered_ema(df, "k", "i", "v", 0.3).first()
    assert abs(found.ema - (0.3 * (0.3 * 1 + 0.7 * 2) + 0.7 * 3)) < 1e-12 and found.n == 3


def test_replaced_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "B")], "k long, v string")
    remade = spark.createDataFrame([(2,), (3,)], "k long")
    assert {tuple(r) for r in reduce.replace_by_key(old, new, "k").collect()} == {(1, "a"), (3, "c"), (2, "B")}
    assert {tuple(r) for r in reduce.replace_by_key(old, new, "k", remade).collect()} == {(1, "a"), (2, "B")}


def test_gradient_of_a_ramp(spark):
    rows = [(0, v, u, float(u), 1.0) for v in range(4) for u in range(4)]
    found = image.sobel(spark.createDataFrame(rows, "frame_id long, v long, u long, intensity double, depth double")).collect()
    for r in found:
        inner = 0 < r.v < 3 and 0 < r.u < 3
        assert (r.gx == 1.0 and r.gy == 0.0) if inner else math.isnan(r.gx)


def test_pyramid(spark):
    rows = [(0, v, u, float(v * 2 + u), float(10 * v + u)) for v in range(2) for u in range(2)]
    found = image.half(spark.createDataFrame(rows, "frame_id long, v long, u long, intensity double, depth double")).first()
    assert found.intensity == 1.5 and found.depth == 0.0


vectors = st.tuples(*[st.floats(-1.5, 1.5)] * 6)


@settings(max_examples=60, deadline=None)
@given(vectors)
def test_twists_come_back(xi):
    made = pose.se3_exp(np.array(xi))
    assert np.allclose(pose.se3_log(made), xi, atol=1e-6)
    assert np.allclose(made @ pose.inverse(made), np.eye(4), atol=1e-9)
    assert np.allclose(pose.nearest_rotation(made[:3, :3] * 1.7), made[:3, :3], atol=1e-9)


def test_network_gradient_is_numeric():
    layers = mlp.synthetic([5, 16, 12, 16, 2], (2,))
    x = np.random.default_rng(3).normal(size=(8, 5))
    found = mlp.gradient(layers, x)
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        numeric = (mlp.forward(layers, x + step)[0][:, 0] - mlp.forward(layers, x - step)[0][:, 0]) / 2e-6
        assert np.allclose(found[:, k], numeric, atol=1e-5)


def _sphere_residuals(points, radius):
    def residuals(p):
        m = geo.transform(geo.vec("x", "y", "z"), p[:3, :3].tolist(), p[:3, 3].tolist())
        rows = points.select(*[c.alias(n) for c, n in zip(m, "xyz", strict=True)])
        n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 / 4 + F.col("z") ** 2 / 9)
        g = (F.col("x") / n, F.col("y") / (4 * n), F.col("z") / (9 * n))
        return rows.select((n - radius).alias("f"), *[x.alias(f"j{k}") for k, x in enumerate([*g, *geo.cross(geo.vec("x", "y", "z"), g)])])

    return residuals


@pytest.mark.parametrize("solver", [track.gauss_newton, track.levenberg_marquardt])
def test_pose_is_found_again(spark, solver):
    rnd = np.random.default_rng(5)
    s = rnd.normal(size=(200, 3))
    s = s / np.linalg.norm(s, axis=1)[:, None] * [1.0, 2.0, 3.0]
    truth = pose.se3_exp(np.array([0.05, -0.04, 0.03, 0.04, -0.05, 0.06]))
    moved = (s - truth[:3, 3]) @ truth[:3, :3]
    points = spark.createDataFrame(moved.tolist(), "x double, y double, z double").cache()
    found = solver(_sphere_residuals(points, 1.0), np.eye(4), 10)
    assert found.tracked and found.energies[-1] < 1e-12 and np.allclose(found.pose, truth, atol=1e-6)


def test_nothing_to_track(spark):
    empty = spark.createDataFrame([], "f double, " + ", ".join(f"j{k} double" for k in range(6)))
    assert not track.gauss_newton(lambda p: empty, np.eye(4), 3).tracked


def test_all_cube_cases_close():
    table = mesh.triangle_table()
    assert len(table) == 256 and not table[0] and not table[255]
    for case, triangles in enumerate(table):
        crossed = {k for k, (a, b) in enumerate(mesh.EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert {e for t in triangles for e in t} == crossed


def test_sphere_is_watertight(spark):
    r = 12
    field = mesh.lattice(spark, r, -1.0, 1.0).withColumn("sdf", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 0.7)
    vertices, edges, area, n = {}, Counter(), 0.0, 0
    for row in mesh.march(field, 2 / (r - 1), (-1.0, -1.0, -1.0)).collect():
        ids = [vertices.setdefault(tuple(round(v, 9) for v in (p.x, p.y, p.z)), len(vertices)) for p in row.v]
        a, b, c = (np.array([p.x, p.y, p.z]) for p in row.v)
        area += np.linalg.norm(np.cross(b - a, c - a)) / 2
        edges.update((ids[k], ids[(k + 1) % 3]) for k in range(3))
        n += 1
    assert all(edges[b, a] == 1 == k for (a, b), k in edges.items())
    assert len(vertices) - len(edges) // 2 + n == 2
    assert abs(area / (4 * math.pi * 0.49) - 1) < 0.03


def test_marching_skips_holes_and_uncertain_triangles(spark):
    field = mesh.lattice(spark, 2).withColumn("sdf", F.when(F.col("id") == 0, -1.0).otherwise(1.0)).withColumn("std", F.lit(0.2))
    assert mesh.march(field, 1.0).count() == 1
    assert mesh.march(field, 1.0, most_std=0.1).count() == 0
    assert mesh.march(field.where("id != 7"), 1.0).count() == 0


def test_weights_and_schedules(spark):
    df = spark.createDataFrame([(0.5,), (4.0,), (-4.0,)], "x double")
    rows = df.select(geo.huber_weight(F.col("x"), 1.0).alias("h"), geo.tukey_weight(F.col("x"), 1.0).alias("t")).collect()
    assert [r.h for r in rows] == [1.0, 0.25, 0.25] and [r.t for r in rows] == [0.5625, 0.0, 0.0]
    assert EPTS.shape == (8, 8, 8) and grid.Grid.over((-3.5, -0.5, -2.5), (4.5, 3.5, 5.5), 0.1).shape[1] == 40


def test_nearest_points_are_found_however_small_the_first_radius(spark):
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(6)], "pid long, x double, y double, z double")
    queries = spark.createDataFrame([(1, 0.2, 0.0, 0.0), (2, 900.0, 0.0, 0.0), (3, float("nan"), 0.0, 0.0)], "qid long, x double, y double, z double")
    found = sorted((r.qid, r.pid, r.rank) for r in spatial.k_nearest(queries, points, 2, 1e-9, grow=64.0).collect())
    assert found == [(1, 0, 1), (1, 1, 2), (2, 4, 2), (2, 5, 1)]
    with pytest.raises(ValueError):
        spatial.k_nearest(queries, points, 2, 0.0)


def test_a_shared_folder_is_made_up_on_one_machine_only():
    from types import SimpleNamespace

    from stratavox.sources import shared

    conf = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared.shared_dir(session)
    session.sparkContext.master = "local[4]"
    assert shared.shared_dir(session) == conf["spark.checkpoint.dir"]
