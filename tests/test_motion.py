"""Poses as Columns against NumPy, as-of neighbours against brute force, dense ids and colours of meshes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions import colour, motion, pose
from stratavox.functions.geometry import vec
from stratavox.operators import reduce, scan
from stratavox.sources import sinks

STRUCT = "struct<qx:double,qy:double,qz:double,qw:double,tx:double,ty:double,tz:double>"


def matrix(p):
    return pose.from_quaternion(p.qx, p.qy, p.qz, p.qw, np.array([p.tx, p.ty, p.tz]))


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = np.random.default_rng(3)
    made = [tuple(rnd.normal(size=7).tolist()) for _ in range(40)]
    close = tuple(x + 1e-12 for x in made[0])
    rows = [(k, made[k], made[k + 20]) for k in range(20)] + [(20, made[0], made[0]), (21, made[0], close), (22, made[0], tuple(-x for x in made[0][:4]) + made[1][4:])]
    return spark.createDataFrame(rows, f"k int, a {STRUCT}, b {STRUCT}").withColumn("alpha", F.lit(0.3))


def test_poses_equal_numpy(spark, pairs):
    a, b = motion.Pose.read("a"), motion.Pose.read("b")
    found = pairs.select(
        "*",
        a.inverse().struct().alias("inverse"),
        a.after(b).struct().alias("both"),
        a.interpolate(b, F.col("alpha")).struct().alias("mixed"),
        F.array(*a.log()).alias("log"),
        F.array(*[c for r in a.adjoint() for c in r]).alias("adjoint"),
        motion.from_rotation(a.rotation(), a.t).struct().alias("again"),
        F.array(*a.moved(b.t)).alias("moved"),
    ).collect()
    for r in found:
        x, y = matrix(r.a), matrix(r.b)
        assert np.allclose(matrix(r.inverse), pose.inverse(x)) and np.allclose(matrix(r.both), x @ y) and np.allclose(matrix(r.again), x)
        assert np.allclose(matrix(r.mixed), pose.interpolate(x, y, 0.3), atol=1e-9), r.k
        assert np.allclose(r.log, pose.so3_log(x[:3, :3])) and np.allclose(np.reshape(r.adjoint, (6, 6)), pose.adjoint(x))
        assert np.allclose(r.moved, x[:3, :3] @ y[:3, 3] + x[:3, 3])


def test_looking_and_jacobians_equal_numpy(spark):
    rnd = np.random.default_rng(6)
    rows = [tuple(v.tolist()) for v in rnd.normal(size=(20, 6))] + [(1e-7, 0.0, 0.0, 3.0, 1.0, 0.0), (0.0, 0.0, 3.141592, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, az double, bx double, by double, bz double")
    a, b = vec("ax", "ay", "az"), vec("bx", "by", "bz")
    up = (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    flat = lambda m: F.array(*[c for r in m for c in r])
    for r in df.select("*", flat(motion.orthonormal(a, b)).alias("o"), motion.look_at(a, b, up).struct().alias("p"), flat(motion.left_jacobian(a)).alias("j"), flat(motion.inverse_left_jacobian(a)).alias("i")).collect():
        x, y = np.array(r[:3]), np.array(r[3:6])
        assert np.allclose(np.reshape(r.o, (3, 3)), pose.from_continuous([*x, *y, 0, 0, 0])[:3, :3])
        assert np.allclose(matrix(r.p), pose.look_at(x, y, np.array([0.0, 0.0, 1.0])))
        assert np.allclose(np.reshape(r.j, (3, 3)), pose.left_jacobian(x), atol=1e-7)
        assert np.allclose(np.reshape(r.i, (3, 3)) @ pose.left_jacobian(x), np.eye(3), atol=1e-6)


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_marks_before_and_after(spark, block):
    rnd = np.random.default_rng(block)
    marks = [(int(o), "ab"[int(k)], float(v)) for o, k, v in zip(rnd.integers(0, 60, 15), rnd.integers(0, 2, 15), rnd.normal(size=15), strict=True)]
    rows = [(int(o), "abc"[int(k)], i) for i, (o, k) in enumerate(zip(rnd.integers(-9, 70, 60), rnd.integers(0, 3, 60), strict=True))] + [(5, None, 60), (None, "a", 61), (5, "a", 62), (5, "a", 62)]
    found = scan.between(spark.createDataFrame(rows, "at int, k string, i int"), spark.createDataFrame([*marks, (3, None, 1.0), (None, "a", 1.0), (4, "a", None)], "at int, k string, v double"), "at", ["k"], "v", block).collect()
    expected = []
    for at, k, i in rows:
        mine = sorted((o, v) for o, m, v in marks if m == k and at is not None)
        expected.append((i, max((x for x in mine if x[0] <= at), default=(0, None))[1], min((x for x in mine if x[0] > at), default=(0, None))[1]))
    order = lambda rows: sorted(rows, key=str)
    assert order((r.i, r.before, r.after) for r in found) == order(expected)


def test_vertices_have_dense_ids_and_colours(spark):
    rnd = np.random.default_rng(8)
    spots = [(*p, float(s)) for p, s in zip(rnd.integers(0, 3, size=(30, 3)).astype(float).tolist(), range(30), strict=True)]
    spots = [(x, y, z, x + 3 * y + 9 * z) for x, y, z, _ in spots]
    soup = [(k, [spots[i] for i in rnd.integers(0, 30, 3)]) for k in range(40)]
    df = spark.createDataFrame([*soup, (99, [(None, 0.0, 0.0, 0.0), spots[0], spots[1]])], "tri int, v array<struct<x:double,y:double,z:double,std:double>>")
    for block in (None, F.col("x").cast("int")):
        vertices, faces = sinks.indexed_mesh(df, block)
        at = {r.vid: r for r in vertices.collect()}
        assert sorted(at) == list(range(len(at))) and len({(r.x, r.y, r.z) for r in at.values()}) == len(at)
        whole = {r.tri: [(at[v].x, at[v].y, at[v].z, at[v]["std"]) for v in (r.a, r.b, r.c)] for r in faces.collect()}
        assert whole == dict(soup)
        assert {at[k].vid: (at[k].x, at[k].y, at[k].z) for k in at} == dict(enumerate(sorted((r.x, r.y, r.z) for r in at.values()))) or block is None
    vertices, faces = sinks.indexed_mesh(df.limit(0))
    assert vertices.count() == 0 == faces.count()


def test_colours(spark):
    values = [0.0, 1.0, 0.5, -3.0, 9.0, float("nan"), None, 0.2]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    found = {r.k: (r.r, r.g, r.b) for r in rows.select("k", *[c.alias(n) for n, c in colour.jet(F.col("v")).items()]).collect()}
    assert found[0] == found[3] == (0.0, 0.0, 0.5) and found[1] == found[4] == (0.5, 0.0, 0.0) and found[5] == (0.0, 0.0, 0.0) and found[6] == (None, None, None)
    assert found[2] == pytest.approx(((128 / 255 - 0.35) / 0.31, 1.0, 1 - (128 / 255 - 0.34) / 0.31)) and found[7] == pytest.approx((0.0, (51 / 255 - 0.125) / 0.25, 1.0))
    clipped = {r.k: r.r for r in sinks.coloured(rows, "v", (0.0, 0.5)).select("k", "r").collect()}
    assert clipped[2] == clipped[4] == clipped[1] == 0.5 and clipped[3] == 0.0
    assert {(r.r, r.b) for r in sinks.coloured(rows.where("k < 2"), "v", (1.0, 1.0)).collect()} == {(0.0, 0.5)}


def test_meters_over_all_names(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("b", None), ("c", float("nan"))], "name string, value double")
    assert reduce.overall(rows, "name", "value").first()[:] == (2, 4.5, 9.0)
    assert reduce.overall(rows.limit(0), "name", "value").first()[:] == (0, None, None)
