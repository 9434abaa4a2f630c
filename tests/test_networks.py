"""Networks, latents under optimisation, names, settings, snapshots and pose forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import heads, mlp, named, pose
from stratavox.operators import image, latent, mesh
from stratavox.sources import settings


def small_decoder():
    body = mlp.synthetic([5, 8, 8], (1,))
    ends = mlp.synthetic([8, 2])[0]
    return heads.Decoder(body, mlp.Layer(ends.weight[:1] / 8, ends.bias[:1]), mlp.Layer(ends.weight[1:] / 8, ends.bias[1:]))


def test_batch_norm_folds_into_its_layer():
    layer, i = mlp.synthetic([3, 4])[0], np.arange(4)
    gain, shift, mean, variance = 1 + i / 5, i / 3, i / 7, 2.0 + i
    x = np.random.default_rng(1).normal(size=(6, 3))
    plain = x @ layer.weight.T + layer.bias
    folded = heads.batch_normed(layer, gain, shift, mean, variance)
    assert np.allclose(x @ folded.weight.T + folded.bias, (plain - mean) / np.sqrt(variance + 1e-5) * gain + shift)


def test_weight_norm_sets_row_lengths():
    layer = heads.weight_normed(mlp.synthetic([3, 4])[0], np.array([1.0, 2, 3, 4]))
    assert np.allclose(np.linalg.norm(layer.weight, axis=1), [1, 2, 3, 4])


def test_gradient_of_likelihood_is_the_numeric_one():
    decoder, made = small_decoder(), np.random.default_rng(2)
    x, sdf = made.normal(size=(20, 5)), made.normal(scale=0.1, size=20)
    _, g = latent.likelihood_gradient(decoder, x, sdf, 5.0)
    for k in range(5):
        step = np.zeros(5)
        step[k] = 1e-6
        up, down = (latent.likelihood_gradient(decoder, x + s * step, sdf, 5.0)[0] for s in (1, -1))
        assert np.allclose((up - down) / 2e-6, g[:, k], atol=1e-5, rtol=1e-4)


def test_latents_follow_adam_on_all_samples(spark):
    decoder, made = small_decoder(), np.random.default_rng(3)
    place, sdf = made.normal(size=(40, 3)), made.normal(scale=0.05, size=40)
    owner = np.where(np.arange(40) < 30, 1, 2)  # one voxel holds most samples
    rows = [(int(o), *map(float, p), float(s)) for o, p, s in zip(owner, place, sdf, strict=True)] + [(99, 0.0, 0.0, 0.0, 0.0)]
    samples = spark.createDataFrame(rows, "lin_id long, x double, y double, z double, sdf double").repartition(5)
    start = {1: [0.1, 0.2], 2: [0.3, -0.1], 3: [0.0, 0.0]}
    latents = spark.createDataFrame(list(start.items()), "lin_id long, latent array<double>")
    found, losses = latent.optimise(samples, latents, decoder, 2, 4, decay=0.5)

    value, m, v = np.array([start[k] for k in (1, 2, 3)]), 0.0, 0.0
    expected = []
    for step in range(1, 5):
        loss, g = latent.likelihood_gradient(decoder, np.concatenate([value[owner - 1], place], axis=1), sdf, 0.2)
        expected.append(loss.mean())
        total = np.zeros_like(value)
        np.add.at(total, owner - 1, g[:, :2])
        size = np.linalg.norm(value, axis=1, keepdims=True)
        total = (total + 0.5 * np.divide(value, size, out=np.zeros_like(value), where=size > 0)) / 40
        m, v = 0.9 * m + 0.1 * total, 0.999 * v + 0.001 * total * total
        value = value - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(losses, expected)
    assert np.allclose([r["latent"] for r in found.orderBy("lin_id").collect()], value)


def test_latents_without_samples_stay(spark):
    none = spark.createDataFrame([], "lin_id long, x double, y double, z double, sdf double")
    latents = spark.createDataFrame([(1, [0.5, 0.5])], "lin_id long, latent array<double>")
    found, losses = latent.optimise(none, latents, small_decoder(), 2, 3)
    assert losses == [] and found.first()["latent"] == [0.5, 0.5]


def test_chunks_decode_as_one(spark):
    decoder, made = small_decoder(), np.random.default_rng(4)
    x = made.normal(size=(50, 5))
    rows = spark.createDataFrame([(i, r[:2].tolist(), *map(float, r[2:])) for i, r in enumerate(x)], "id int, code array<double>, x double, y double, z double")
    found = heads.decode(rows, "code", ["x", "y", "z"], decoder, 7).orderBy("id").collect()
    sdf, std = decoder.run(x)
    assert np.allclose([r["sdf"] for r in found], sdf) and np.allclose([r["std"] for r in found], std)


def test_names(spark):
    assert named.names("robust kernel") == ["huber", "none", "tukey"]
    row = spark.range(1).select(named.get("robust kernel", "huber")(F.lit(4.0), 2.0).alias("h"), named.get("schedule", "constant")(F.lit(1), 3).alias("c")).first()
    assert tuple(row) == (0.5, 3.0)
    with pytest.raises(KeyError, match="known: constant, step, warmup"):
        named.get("schedule", "cosine")
    with pytest.raises(ValueError):
        named.register("loss", "l1", abs)


def test_settings_with_include(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text("a: 1\nb: 2\n")
    (tmp_path / "run.yaml").write_text("include_configs: base.yaml\nb: 3\n")
    assert settings.read_settings(spark, str(tmp_path / "run.yaml"), {"a": 9, "c": 4}) == {"a": 1, "b": 3, "c": 4}
    assert settings.read_settings(spark, str(tmp_path / "run.yaml"), {"a": 9}, override=False) == {"a": 9, "b": 3}
    (tmp_path / "run.json").write_text("[{'_': 'a comment', 'x': None}, {'y': True}]")
    assert settings.read_settings(spark, str(tmp_path / "run.json")) == {"x": None, "y": True}
    (tmp_path / "empty.yaml").write_text("")
    assert settings.read_settings(spark, str(tmp_path / "empty.yaml")) == {}


def test_snapshots(spark, tmp_path):
    assert settings.snapshot_epochs(10, 4, (1, 8, 11)) == [1, 4, 8]
    path = str(tmp_path)
    for epoch in (1, 4):
        settings.write_snapshot(path, epoch, {"model": spark.range(epoch), "latents": spark.range(2)})
    assert settings.read_snapshot(spark, path, "model").count() == 4
    assert settings.read_snapshot(spark, path, "model", 1).count() == 1
    with pytest.raises(LookupError):
        settings.read_snapshot(spark, path, "model", 3)


def test_pose_forms():
    one = pose.random_pose(5)
    assert np.allclose(one[:3, :3] @ one[:3, :3].T, np.eye(3)) and np.linalg.det(one[:3, :3]) > 0
    assert np.array_equal(one, pose.random_pose(5))
    assert np.allclose(pose.from_continuous(pose.continuous(one)), one)
    assert np.allclose(pose.from_continuous(pose.continuous(one) * np.repeat([3, 2, 1], 3)), one)
    assert np.allclose(pose.from_full(pose.full(one)), one)
    noisy = pose.full(one) + 0.01
    assert np.allclose(pose.from_full(noisy, True)[:3, :3] @ pose.from_full(noisy, True)[:3, :3].T, np.eye(3))
    assert np.allclose(pose.to_gl_camera(pose.to_gl_camera(one)), one)
    turn = pose.se3_exp(np.array([0, 0, 0, 0.1, 0.2, 0.3]))
    even = pose.tangent(one, one @ pose.inverse(turn), one @ turn)
    assert np.allclose(even[:3, :3], one[:3, :3])


def test_limit_tells_of_more(spark):
    rows = spark.range(10)
    assert [tuple(r) for r in mesh.limited(rows, "id", 3).orderBy("id").collect()] == [(0, True), (1, True), (2, True)]
    assert {tuple(r) for r in mesh.limited(rows, "id", 10).select("overflow").collect()} == {(False,)}
    assert mesh.limited(rows.where("id < 0"), "id", 3).count() == 0


def test_robust_normals_of_a_plane_have_sensor_weights(spark):
    pixels = [(0, v, u, 0.5 if (v, u) != (4, 4) else float("nan"), 0.0) for v in range(9) for u in range(9)]
    rows = spark.createDataFrame(pixels, "frame_id int, v int, u int, depth double, intensity double")
    found = {(r["v"], r["u"]): r for r in image.pca_normals(rows, (200.0, 200.0, 4.0, 4.0)).collect()}
    theta = np.pi
    tilt = theta / (0.5 * 3.14159 - theta)
    expected = 1 / (0.0012 + 0.0019 * 0.1**2 + 0.0001 / np.sqrt(0.5) * tilt**2)
    assert (4, 4) not in found
    assert np.allclose([found[5, 5][f"n{c}"] for c in "xyz"], [0, 0, -1]) and np.isclose(found[5, 5]["weight"], expected)
    alone = image.pca_normals(rows.where("v = 0 AND u < 3"), (200.0, 200.0, 4.0, 4.0)).collect()
    assert all(r["weight"] == -1 and np.isnan(r["nx"]) for r in alone)
