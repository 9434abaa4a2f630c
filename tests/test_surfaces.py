"""Rasterised views against brute force over all pixels, and as the reference of the sampler."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions.pose import from_quaternion
from stratavox.operators import raster
from stratavox.operators.grid import Grid
from stratavox.operators.sample import Sampler
from tests.test_sampler import sphere

NAMES = "tri_id long, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double"
VIEWS = "view long, matrix array<double>"


def brute(triangles, views, camera):
    """{(view, u, v): (face, depth)} by looking at every pixel of every triangle."""
    best = {}
    for view, m in views:
        m = np.reshape(m, (4, 4))
        for face, *c in triangles:
            if not all(x is not None and math.isfinite(x) for x in c):
                continue
            p = np.reshape(c, (3, 3)) @ m[:3, :3].T + m[:3, 3]
            s = np.stack([(p[:, 0] / camera.half + 1) / 2 * camera.width, (1 - p[:, 1] / camera.half) / 2 * camera.height], 1)
            area = (s[1, 0] - s[0, 0]) * (s[2, 1] - s[0, 1]) - (s[1, 1] - s[0, 1]) * (s[2, 0] - s[0, 0])
            if area == 0:
                continue
            for u in range(camera.width):
                for v in range(camera.height):
                    d = s - (u + 0.5, v + 0.5)
                    w = np.array([d[(k + 1) % 3, 0] * d[(k + 2) % 3, 1] - d[(k + 1) % 3, 1] * d[(k + 2) % 3, 0] for k in range(3)])
                    if (np.sign(area) * w >= 0).all():
                        depth = float(-(w @ p[:, 2]) / w.sum())
                        if camera.near <= depth <= camera.far:
                            best[view, u, v] = min(best.get((view, u, v), (math.inf, 0)), (depth, face))
    return best


def turns(n):
    rnd = np.random.default_rng(5)
    return [(k, from_quaternion(*rnd.normal(size=4), np.array([0.0, 0.0, -2.0])).ravel().tolist()) for k in range(n)]


@pytest.mark.parametrize("few", [4096, 2])
def test_nearest_faces_equal_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(raster, "FEW_VIEWS", few)  # views by broadcast, and in blocks
    rnd = np.random.default_rng(1)
    triangles = [(k, *rnd.normal(size=9).tolist()) for k in range(12)]
    triangles += [(20, *[9.0 * x for x in triangles[0][1:]])]  # far beyond the image on all sides
    triangles += [(30, *[0.0] * 9), (31, math.nan, *[1.0] * 8), (32, None, *[1.0] * 8), (33, math.inf, *[1.0] * 8)]
    camera, views = raster.Camera(1.2, 0.5, 3.0, 37, 21), turns(5)
    rows = raster.rasterised(spark.createDataFrame(triangles, NAMES), spark.createDataFrame(views, VIEWS), camera).collect()
    expected = brute(triangles, views, camera)
    assert {(r.view, r.u, r.v): r.face for r in rows} == {k: f for k, (_, f) in expected.items()}
    assert all(r.depth == pytest.approx(expected[r.view, r.u, r.v][0], abs=1e-9) for r in rows)
    for r in rows:
        m = np.reshape(dict(views)[r.view], (4, 4))
        assert -(m @ [r.x, r.y, r.z, 1.0])[2] == pytest.approx(r.depth, abs=1e-9)
        assert (m[:3, :3] @ [r.nx, r.ny, r.nz])[2] > -1e-9 and math.hypot(r.nx, r.ny, r.nz) == pytest.approx(1)


def test_a_plane_has_no_cracks_ties_and_edge_on_faces(spark):
    flat = [(1, -1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 1.0, 1.0, 0.0), (2, -1.0, -1.0, 0.0, 1.0, 1.0, 0.0, -1.0, 1.0, 0.0), (3, -1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 1.0, 1.0, 0.0)]
    steep = [(4, 0.0, -1.0, 1.0, 0.0002, -1.0, 0.5, 0.0, 1.0, 1.0)]  # an edge along the middle of pixels
    eye = spark.createDataFrame([(0, np.eye(4).ravel().tolist())], VIEWS)
    camera = raster.Camera(1.0, -2.0, 2.0, 9, 9)
    rows = raster.rasterised(spark.createDataFrame(flat + steep, NAMES), eye, camera).collect()
    assert len(rows) == 81 and {r.face for r in rows} == {1, 2, 4}
    assert {r.u for r in rows if r.face == 4} == {4} == {r.u for r in rows if not r.valid}
    points = raster.seen_points(spark.createDataFrame(flat + steep, NAMES), eye, camera)
    assert points.count() == 72 == points.select("pid").distinct().count()
    assert {tuple(r) for r in raster.face_tallies(points).collect()} == {(1, 40, 40), (2, 32, 32)}  # the diagonal is a tie, its middle pixel is face 4
    assert raster.rasterised(spark.createDataFrame([], NAMES), eye, camera).count() == 0
    assert raster.rasterised(spark.createDataFrame(flat, NAMES), eye.limit(0), camera).count() == 0


def test_files_store_matrices_by_columns(spark):
    triangles, views = spark.createDataFrame([(k, *np.random.default_rng(k).normal(size=9).tolist()) for k in range(5)], NAMES), turns(2)
    stored = [(k, np.reshape(m, (4, 4)).T.ravel().tolist()) for k, m in views]
    one, two = (raster.rasterised(triangles, spark.createDataFrame(v, VIEWS), raster.Camera(2.0, 0.0, 9.0, 16, 16, by)) for v, by in ((views, False), (stored, True)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_the_sides_of_normals(spark):
    rows = spark.createDataFrame([(1, -0.1, 9.0, 9.0), (1, 1e-7, 0.5, -9.0), (1, 0.0, -1e-7, -0.2), (2, 0.0, 0.0, 0.3)], "face long, nx double, ny double, nz double")
    assert {tuple(r) for r in raster.face_tallies(rows).collect()} == {(1, 3, -1), (2, 1, 1)}


def test_seen_points_are_a_reference_of_the_sampler(spark):
    triangles, _ = sphere(spark)
    axes = [(0, 0, 0, 1), (1, 0, 0, 0), (0, 1, 0, 1), (0, -1, 0, 1), (1, 0, 0, 1), (-1, 0, 0, 1)]
    views = [(k, from_quaternion(*q, np.array([0.0, 0.0, -2.0])).ravel().tolist()) for k, q in enumerate(axes)]
    seen = raster.seen_points(triangles, spark.createDataFrame(views, VIEWS), raster.Camera(1.1, 0.1, 4.0, 24, 24)).cache()
    for r in seen.collect():
        assert 0.95 < math.hypot(r.x, r.y, r.z) < 1.001 and r.x * r.nx + r.y * r.ny + r.z * r.nz > 0.9  # outwards, however faces are wound
    sampler = Sampler(Grid((-3.0, -3.0, -3.0), 0.5, (12, 12, 12)), 400, variance=0.01, votes=5, least=2, radius=0.3)
    made = sampler.samples(triangles, seen).collect()
    assert len(made) > 250
    assert all(abs(r.sdf - (math.hypot(r.x, r.y, r.z) - 1)) < 0.1 for r in made)
    records, around = sampler.records(triangles, seen)
    assert records.where(F.abs("x") > 1.0 + 1e-9).count() == 0 < around.count()
