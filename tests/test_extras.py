"""Augmentation, views, shapes and training."""

import math

import numpy as np
from pyspark.sql import functions as F

from stratavox.functions import augment, mlp
from stratavox.functions.geometry import dot, length, vec
from stratavox.operators import train, visual
from stratavox.operators.grid import Grid


def test_augmentation_keeps_lengths(spark):
    df = spark.range(200).select("id", F.lit(0.6).alias("x"), F.lit(0.0).alias("y"), F.lit(0.8).alias("z"))
    p = vec("x", "y", "z")
    for axis in "xyz":
        assert df.select(F.max(F.abs(length(augment.turned(p, F.col("id"), axis)) - 1))).first()[0] < 1e-9
    n = augment.tilted(p, F.col("id"), 0.3)
    row = df.select(F.max(F.abs(length(n) - 1)), F.min(dot(n, p))).first()
    assert row[0] < 1e-9 and row[1] >= math.cos(0.3) - 1e-9
    noise = df.select(F.avg(augment.gaussian(F.col("id"), "a")), F.stddev(augment.gaussian(F.col("id"), "a"))).first()
    assert abs(noise[0]) < 0.3 and 0.8 < noise[1] < 1.2


def test_wireframes_and_lines(spark):
    grid = Grid((0.0, 0.0, 0.0), 1.0, (2, 2, 2))
    vertices, edges = visual.wireframes(spark.createDataFrame([(0,), (7,)], "lin_id long"), grid)
    assert vertices.count() == 16 and edges.count() == 24
    assert vertices.where("lin_id = 7").agg(F.max("x"), F.min("z")).first()[:] == (2.0, 1.0)
    sets = spark.createDataFrame([(0, 3), (1, 2)], "set_id long, n_vertices long")
    lines = spark.createDataFrame([(0, 0, 1), (1, 0, 1)], "set_id long, a long, b long")
    assert {tuple(r) for r in visual.merge_lines(sets, lines).collect()} == {(0, 0, 1), (1, 3, 4)}


def test_the_nearest_face_is_seen(spark):
    samples = spark.createDataFrame([(1, 0.1, 0.1, 0.0), (2, 0.2, 0.2, 1.0), (3, 1.5, 0.1, 0.0)], "face long, x double, y double, z double")
    views = spark.createDataFrame([(0, np.eye(4).ravel().tolist())], "view long, matrix array<double>")
    assert {(r.u, r.face) for r in visual.visible_faces(samples, views, 1.0).collect()} == {(0, 2), (1, 3)}
    tallies = visual.orientation_tallies(spark.createDataFrame([(1, 0.5), (1, -0.2), (1, 0.1)], "face long, nz double")).first()
    assert tallies.n == 3 and tallies.sign == 1.0


def test_shapes(spark):
    rows = visual.made_up_shapes(spark, 60).collect()
    assert {r.kind for r in rows} == {"cube", "sphere", "cylinder"}
    assert all(0.1 <= r.scale <= 1.5 and abs(r.tx) <= 0.5 and abs(sum(a * a for a in r.axis) - 1) < 1e-9 for r in rows)
    assert spark.range(1).select(visual.palette(F.lit(13))).first()[0] == "red"


def test_training_lowers_the_loss_and_its_gradient_is_numeric(spark):
    layers = mlp.synthetic([3, 8, 6, 1], (1,))
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(20, 3))
    y = x[:, 0] - x[:, 1]
    _, g = train.loss_gradient(layers, x, y)
    values = train.flat(layers)
    for k in (0, 7, 30, len(values) - 1):
        step = np.zeros_like(values)
        step[k] = 1e-6
        up, down = (train.loss_gradient(train.shaped(layers, values + s * step), x, y)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-4
    rows = spark.createDataFrame(np.column_stack([x, y]).tolist(), "a double, b double, c double, t double")
    _, losses = train.fit(rows, ["a", "b", "c"], "t", layers, 8, 0.02)
    assert losses[-1] < losses[0]
