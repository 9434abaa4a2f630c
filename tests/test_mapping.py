"""Lattices at the grid's edge, twist Jacobians, and schedules of terms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import pose
from stratavox.operators import track, volume
from stratavox.operators.grid import Grid


def test_left_jacobian_is_the_derivative_of_the_exponential():
    rnd = np.random.default_rng(1)
    for size in (0.0, 1e-9, 0.1, 1.0, 2.5):
        xi = rnd.normal(size=6) * size
        jacobian = pose.se3_left_jacobian(xi)
        for k in range(6):
            d = np.zeros(6)
            d[k] = 1e-6
            moved = pose.se3_exp(xi + d) @ pose.inverse(pose.se3_exp(xi))
            assert np.allclose(pose.se3_log(moved) / 1e-6, jacobian[:, k], atol=1e-4)
        assert np.allclose(pose.se3_inverse_left_jacobian(xi) @ jacobian, np.eye(6), atol=1e-8)


@pytest.mark.parametrize("r", [3, 4])
def test_stitched_linear_field_is_linear_and_repeats_at_the_upper_faces(spark, r):
    grid = Grid((0.0, 0.0, 0.0), 1.0, (2, 2, 2))
    voxels = spark.range(8).select(F.col("id").alias("lin_id"))

    def decode(rows):
        gx, gy, gz = grid.axes(F.col("lin_id"))
        return rows.withColumns({"sdf": (gx + F.col("x")) + 2 * (gy + F.col("y")) - (gz + F.col("z")), "std": F.lit(0.5)})

    for gate in (None, 0.05):
        found = volume.stitch(volume.decode_lattice(voxels, r, decode, gate), grid, r).collect()
        assert {(x.i, x.j, x.k) for x in found} == {(i, j, k) for i in range(2 * r + 1) for j in range(2 * r + 1) for k in range(2 * r + 1)}
        for x in found:
            i, j, k = (min(v, 2 * r - 1) / r - 0.5 for v in (x.i, x.j, x.k))
            assert abs(x.sdf - (i + 2 * j - k)) < 1e-9 and abs(x.std - 0.5) < 1e-9


def test_a_schedule_reverts_hands_on_and_counts_late_stops(spark):
    points = np.random.default_rng(2).normal(size=(40, 3))

    def residuals(at):
        moved = points @ at[:3, :3].T + at[:3, 3]
        rows = []
        for p, m in zip(points, moved, strict=True):
            for axis in range(3):
                g = np.eye(3)[axis]
                rows.append([float(v) for v in (m[axis] - p[axis], *g, *np.cross(m, g))])
        return spark.createDataFrame(rows, "f double, " + ", ".join(f"j{k} double" for k in range(6)))

    start = pose.se3_exp(np.array([0.2, -0.1, 0.05, 0.1, 0.05, -0.1]))
    terms = {"a": track.Term(residuals), "b": track.Term(residuals, 3.0)}
    found = track.scheduled([(2, ["a"]), (3, ["a", "b"])], terms, start)
    assert found.tracked and np.allclose(found.pose, np.eye(4), atol=1e-6)
    noted = track.Stability("b")
    for stopped in (10, -1, 12, 9, 11):
        noted.note(stopped, terms)
    assert noted.events == 3 and terms["b"].weight == 500.0
    empty = track.Term(lambda at: residuals(at).limit(0))
    assert not track.scheduled([(2, ["a"])], {"a": empty}, start).tracked
