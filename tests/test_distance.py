"""The distance term: numeric derivatives, and a pose found again from three walls."""

import numpy as np
import pytest

from stratavox.functions import geometry as geo
from stratavox.functions.heads import Decoder
from stratavox.functions.mlp import Layer, synthetic
from stratavox.functions.pose import se3_exp
from stratavox.operators.distance import Field, track
from stratavox.operators.grid import Grid

GRID = Grid((0.0, 0.0, 0.0), 0.5, (8, 8, 8))


def walls(spark):
    """Voxels along three walls; a wall's latent opens the decoder's pair of units for its own axis."""
    body = np.zeros((6, 6))
    for axis in range(3):
        for k, sign in enumerate((1, -1)):
            body[2 * axis + k, axis], body[2 * axis + k, 3 + axis] = 100, sign
    units = Layer(body, np.full(6, -100.0))
    decoder = Decoder([units], Layer(np.array([[1.0, -1, 1, -1, 1, -1]]), np.zeros(1)), Layer(np.zeros((1, 6)), np.zeros(1)))
    rows = []
    for axis in range(3):
        for a in range(1, 8):
            for b in range(1, 8):
                g = [0, 0, 0]
                g[(axis + 1) % 3], g[(axis + 2) % 3] = a, b
                rows.append((g[2] + 8 * g[1] + 64 * g[0], [float(k == axis) for k in range(3)], 5.0))
    return Field(GRID, spark.createDataFrame([*rows, (0, [1.0, 0.0, 0.0], 1.0)], "lin_id long, latent array<double>, obs_count double"), decoder, 2)


def on_walls(n=60):
    rnd = np.random.default_rng(4)
    points = rnd.uniform(0.9, 3.4, (3 * n, 3))
    for axis in range(3):
        points[axis * n : (axis + 1) * n, axis] = 0.25
    return points


def frame(spark, points):
    return spark.createDataFrame(points.tolist(), "x double, y double, z double")


def test_a_pose_is_found_again(spark):
    world = on_walls()
    truth = se3_exp(np.array([0.3, -0.2, 0.4, 0.2, -0.1, 0.3]))
    previous = se3_exp(np.array([-0.05, 0.04, -0.06, 0.02, 0.03, -0.02])) @ truth
    seen = (np.linalg.inv(truth) @ np.c_[world, np.ones(len(world))].T).T[:, :3]
    field = walls(spark)
    found = track(field, frame(spark, seen), previous, previous, [(3, ["sdf"]), (4, ["sdf"])], lambda f: geo.huber_weight(f, 1.0))
    assert found.tracked and np.allclose(found.pose, truth, atol=1e-5)
    assert found.energies[-1] < 1e-8 < found.energies[0]


def test_the_jacobian_is_the_derivative(spark):
    rnd = np.random.default_rng(6)
    ends = synthetic([7, 2])[0]
    decoder = Decoder(synthetic([6, 9, 7], (1,)), Layer(ends.weight[:1], ends.bias[:1]), Layer(ends.weight[1:], ends.bias[1:]))
    voxels = spark.createDataFrame([(k, rnd.normal(size=3).tolist(), 9.0) for k in range(512)], "lin_id long, latent array<double>, obs_count double")
    field = Field(GRID, voxels, decoder, chunk=7)
    # places in the middle of their cells, so that small motions don't leave them
    world = (rnd.integers(1, 7, (25, 3)) + rnd.uniform(0.3, 0.7, (25, 3))) * 0.5
    previous, delta = se3_exp(rnd.normal(size=6) * 0.4), se3_exp(rnd.normal(size=6) * 0.1)
    seen = (np.linalg.inv(previous @ delta) @ np.c_[world, np.ones(len(world))].T).T[:, :3]
    points = frame(spark, seen).coalesce(1)
    at = lambda d: field.residuals(points, previous, d).toPandas().sort_values(["j0", "j1"]).to_numpy()
    std = field.sample(frame(spark, world)).toPandas()

    def values(d):
        moved = (previous @ d @ np.c_[seen, np.ones(len(seen))].T).T[:, :3]
        rows = field.sample(frame(spark, moved).coalesce(1)).toPandas().sort_values(["x", "y"])
        return rows["sdf"].to_numpy()

    base, found = values(delta), at(delta)
    assert len(found) == len(std) == 25
    sums = []
    for k in range(6):
        xi = np.zeros(6)
        xi[k] = 1e-6
        sums.append((values(se3_exp(xi) @ delta) - base).sum() / 1e-6)
    rows = field.residuals(points, previous, delta).toPandas()
    assert np.allclose(np.sort(rows["f"]), np.sort(std["sdf"] / std["std"]))
    unscaled = field.sample(frame(spark, world)).toPandas()
    turned = unscaled[["gx", "gy", "gz"]].to_numpy() @ previous[:3, :3]
    near = (delta @ np.c_[seen, np.ones(len(seen))].T).T[:, :3]
    order = np.lexsort(world.T[::-1])
    by_place = unscaled.sort_values(["x", "y", "z"])[["gx", "gy", "gz"]].to_numpy() @ previous[:3, :3]
    assert np.allclose(np.r_[turned.sum(0), np.cross(near[order], by_place).sum(0)], sums, atol=1e-3)


def test_points_outside_known_voxels_give_nothing(spark):
    field = walls(spark)
    none = frame(spark, np.array([[0.1, 0.1, 0.1], [9.0, 1.0, 1.0], [float("nan"), 1.0, 1.0], [2.2, 2.2, 2.2]]))
    assert field.sample(none).count() == 0
    assert not track(field, none, np.eye(4), np.eye(4), [(2, ["sdf"])]).tracked


@pytest.mark.parametrize("as_original", [False, True])
def test_both_forms_agree_without_a_turn(spark, as_original):
    field = walls(spark)
    previous = np.eye(4)
    rows = field.residuals(frame(spark, on_walls(5)), previous, np.eye(4), as_original=as_original).toPandas()
    assert len(rows) == 15 and np.allclose(rows["f"], 0)
