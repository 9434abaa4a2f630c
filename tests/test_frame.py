"""Frames made ready: thinning by hand, and a plane with holes and a stray point."""

import math

import pytest

from stratavox.operators import frame

PIXELS = "frame_id long, v long, u long, depth double, r double, g double, b double"


@pytest.mark.parametrize(("step", "middle"), [(1, [0]), (2, [0, 1]), (3, [1]), (4, [1, 2])])
def test_thinning(spark, step, middle):
    height, width = 9, 14
    rows = [(0, v, u, 100.0 * v + u, float(v), float(u), float(v * u)) for v in range(height) for u in range(width)]
    found = {(r.v, r.u): r for r in frame.thinned(spark.createDataFrame(rows, PIXELS), step, height, width).collect()}
    assert set(found) == {(v, u) for v in range(height // step) for u in range(width // step)}
    for (v, u), r in found.items():
        at = [(step * v + a, step * u + b) for a in middle for b in middle]
        assert r.depth == 100.0 * step * v + step * u
        assert (r.r, r.g, r.b) == pytest.approx(tuple(sum(f(*p) for p in at) / len(at) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a * b)))


def test_a_plane_is_prepared(spark):
    rows = [(0, v, u, 1.0, 0.2, 0.4, 0.6) for v in range(24) for u in range(24)]
    holes = {(4, 4): math.nan, (6, 6): None, (20, 20): 3.0}  # no depth, and a point far behind
    rows = [(f, v, u, holes.get((v, u), d), *c) for f, v, u, d, *c in rows]
    ready = frame.Preparation((48.0, 48.0, 12.0, 12.0), 24, 24, crowd=6, crowd_radius=0.1, normal_radius=0.12, cell=0.1)
    pixels = spark.createDataFrame(rows, PIXELS)
    points = ready.points(pixels)
    assert points.count() == 142 and points.where("pid = 12 * 2 + 2 OR pid = 12 * 3 + 3").count() == 0
    made = ready.coloured(pixels).cache()
    assert 0 < made.count() < 142 and made.where("pid = 12 * 10 + 10").count() == 0
    for r in made.collect():
        v, u = divmod(r.pid, 12)
        assert (r.x, r.y, r.z) == pytest.approx(((u - 6) / 24, (v - 6) / 24, 1.0)) and (r.nx, r.ny, r.nz) == pytest.approx((0, 0, -1), abs=1e-9)
        assert (r.r, r.g, r.b) == pytest.approx((0.2, 0.4, 0.6))
    cells = ready.processed(made).collect()
    assert sum(c.n for c in cells) == made.count() and all((c.mz, c.mnz) == pytest.approx((1.0, -1.0)) for c in cells)
    assert ready.processed(ready.coloured(pixels.limit(0))).count() == 0
