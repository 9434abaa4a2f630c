"""The sampler from triangles to training records, on a sphere."""

import math

import pytest
from pyspark.sql import functions as F

from stratavox.operators.grid import Grid
from stratavox.operators.sample import Sampler, in_box

GRID = Grid((-3.0, -3.0, -3.0), 0.5, (12, 12, 12))


def sphere(spark, n=10):
    """Triangles of a unit sphere, and points on it with their normals, two of them NaN."""
    at = lambda i, j: (math.sin(math.pi * i / n) * math.cos(math.pi * j / n), math.sin(math.pi * i / n) * math.sin(math.pi * j / n), math.cos(math.pi * i / n))
    faces = []
    for i in range(n):
        for j in range(2 * n):
            a, b, c, d = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            faces += [(*a, *b, *c), (*a, *c, *d)]
    triangles = spark.createDataFrame([(k, *f) for k, f in enumerate(faces)], "tri_id long, ax double, ay double, az double, bx double, by_ double, bz double, cx double, cy double, cz double")
    golden = math.pi * (3 - math.sqrt(5))
    points = []
    for k in range(800):
        z = 1 - (2 * k + 1) / 800
        p = (math.sqrt(1 - z * z) * math.cos(golden * k), math.sqrt(1 - z * z) * math.sin(golden * k), z)
        points.append((k, *p, *p))
    points += [(800, 0.0, 0.0, 0.0, float("nan"), 0.0, 0.0), (801, 0.0, 0.0, 0.0, 0.0, 0.0, float("nan"))]
    return triangles, spark.createDataFrame(points, "pid long, x double, y double, z double, nx double, ny double, nz double")


@pytest.mark.parametrize("scale", [1.0, 2.0])
def test_records_of_a_sphere(spark, scale):
    triangles, surface = sphere(spark)
    sampler = Sampler(GRID, 600, variance=0.01, votes=5, least=2, radius=0.3, scale=scale)
    made = sampler.samples(triangles, surface.where("pid < 800")).collect()
    assert len(made) > 450 and len({r.sid for r in made}) == len(made) and max(r.sid for r in made) > 480
    for r in made:
        away = math.sqrt(r.x**2 + r.y**2 + r.z**2) / scale - 1
        assert abs(r.sdf / scale - away) < 0.08 and (r.sdf > 0) == (away > 0) or abs(away) < 0.02
    records, around = sampler.records(triangles, surface)
    rows, by_id = records.collect(), {r.sid: r for r in made}
    assert rows and all(max(abs(r.x), abs(r.y), abs(r.z)) <= 1 + 1e-9 for r in rows)
    for r in rows[:50]:
        g = [r.lin_id // 144, r.lin_id // 12 % 12, r.lin_id % 12]
        s = by_id[r.sid]
        assert r.sdf == pytest.approx(s.sdf / 0.5) and [r.x, r.y, r.z] == pytest.approx([(v - (-3 + (k + 0.5) * 0.5)) / 0.5 for v, k in zip((s.x, s.y, s.z), g, strict=True)])
    assert {r.lin_id for r in around.select("lin_id").distinct().collect()} == {r.lin_id for r in rows}
    assert around.where(F.isnan("nx") | F.isnan("nz")).count() == 0


def test_a_box_is_filled_evenly(spark):
    box = spark.createDataFrame([(0.0, 1.0, 5.0, 7.0, -1.0, -1.0)], "min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    rows = in_box(box, 2000, 10).toPandas()
    assert sorted(rows["sid"]) == list(range(10, 2010))
    assert abs(rows["x"].mean() - 0.5) < 0.03 and abs(rows["y"].mean() - 6) < 0.06 and (rows["z"] == -1).all()
