"""Training: numeric gradients by both networks' weights, falling losses, splits, and a resumed run that ends where a whole one does."""

import numpy as np

from stratavox.functions.heads import Decoder
from stratavox.functions.mlp import Layer, synthetic
from stratavox.operators import learn
from stratavox.operators.train import flat, shaped


def networks():
    ends = synthetic([7, 2])[0]
    decoder = Decoder(synthetic([5, 9, 7], (1,)), Layer(ends.weight[:1] / 3, ends.bias[:1]), Layer(ends.weight[1:] / 3, ends.bias[1:]))
    return decoder, synthetic([6, 8, 2])


def tables(spark, voxels=6):
    rnd = np.random.default_rng(2)
    samples = [(int(v), *rnd.uniform(-0.5, 0.5, 3).tolist(), float(rnd.normal() * 0.1)) for v in np.repeat(np.arange(voxels), 20)]
    surface = [(int(v), *rnd.uniform(-0.5, 0.5, 3).tolist(), *rnd.normal(size=3).tolist()) for v in np.repeat(np.arange(voxels), 12)]
    samples += [(99, 0.0, 0.0, 0.0, 0.0)]  # a voxel without surface points doesn't count
    return (
        spark.createDataFrame(samples, "lin_id long, x double, y double, z double, sdf double").repartition(3),
        spark.createDataFrame(surface, "lin_id long, x double, y double, z double, nx double, ny double, nz double").repartition(2),
    )


def trainer(**more):
    decoder, encoder = networks()
    return learn.Trainer(decoder, encoder, (lambda e: 0.01 / (1 + e // 3), lambda e: 0.005), learn.Loss(0.2, 0.3, 10), **more)


def value(decoder, encoder, samples, surface, loss, epoch):
    """The mean loss with NumPy alone."""
    from stratavox.functions.mlp import forward

    points = surface.toPandas()
    codes = {v: forward(encoder, g[learn.SURFACE].to_numpy())[0].mean(0) for v, g in points.groupby("lin_id")}
    rows = samples.toPandas()
    rows = rows[rows["lin_id"].isin(codes)]
    code = np.stack([codes[v] for v in rows["lin_id"]])
    mean, std = decoder.run(np.c_[code, rows[["x", "y", "z"]]])
    error = np.clip(mean, -loss.most, loss.most) - np.clip(rows["sdf"], -loss.most, loss.most)
    return float((error**2 / (2 * std**2) + np.log(std) + np.log(2 * np.pi) / 2 + loss.pull(epoch) * np.linalg.norm(code, axis=1)).mean())


def test_gradients_equal_numeric_ones_and_splits_add_up(spark):
    samples, surface = tables(spark)
    run = trainer()
    by_decoder, by_encoder, loss = run.gradients(samples, surface, 4)
    assert np.isclose(loss, value(run.decoder, run.encoder, samples, surface, run.loss, 4))
    rnd = np.random.default_rng(0)
    for found, layers, rebuild in (
        (by_decoder, learn._layers(run.decoder), lambda w: (Decoder((x := shaped(learn._layers(run.decoder), w))[:-2], x[-2], x[-1]), run.encoder)),
        (by_encoder, run.encoder, lambda w: (run.decoder, shaped(run.encoder, w))),
    ):
        base = flat(layers)
        for k in rnd.choice(len(base), 15, replace=False):
            moved = base.copy()
            moved[k] += 1e-6
            low = base.copy()
            low[k] -= 1e-6
            numeric = (value(*rebuild(moved), samples, surface, run.loss, 4) - value(*rebuild(low), samples, surface, run.loss, 4)) / 2e-6
            assert np.isclose(found[k], numeric, atol=1e-5), k
    split = trainer(splits=3).gradients(samples, surface, 4)
    assert all(np.allclose(a, b) for a, b in zip(split, (by_decoder, by_encoder, loss), strict=True))


def test_losses_fall_and_a_resumed_run_ends_alike(spark, tmp_path):
    samples, surface = tables(spark)
    whole = trainer().fit(samples, surface, 4, batch=3, snapshots=(2,), path=str(tmp_path))
    assert len(whole.losses) == 8 and np.mean(whole.losses[-2:]) < np.mean(whole.losses[:2])
    again = trainer().resumed(spark, str(tmp_path), 2).fit(samples, surface, 4, batch=3)
    assert again.epoch == 4 and np.allclose(again.losses, whole.losses)
    assert all(np.allclose(a.values, b.values, atol=1e-12) for a, b in zip(again.state, whole.state, strict=True))


def test_no_samples_leave_the_weights(spark):
    samples, surface = tables(spark)
    by_decoder, by_encoder, loss = trainer().gradients(samples.where("lin_id = 99"), surface, 1)
    assert not by_decoder.any() and not by_encoder.any() and loss == 0
