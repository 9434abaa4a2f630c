"""Readers, writers and the stream, on files made here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.operators.grid import Grid
from stratavox.sources import rgbd, sinks
from stratavox.streaming.voxel_state import run_to_end


def test_frames_in_numeric_order(spark, tmp_path):
    for kind in ("rgb", "depth"):
        (tmp_path / kind).mkdir()
    for k, name in enumerate((2, 10, 1)):
        (tmp_path / "rgb" / f"{name}.png").write_bytes(b"x")
        (tmp_path / "depth" / f"{k}.png").write_bytes(b"y")
    rows = rgbd.frame_files(spark, str(tmp_path)).orderBy("frame_id").collect()
    assert [r.stem for r in rows] == [1, 2, 10]
    assert [r.frame_id for r in rgbd.frame_files(spark, str(tmp_path), 1, 3).orderBy("frame_id").collect()] == [1, 2]


def test_trajectory(spark, tmp_path):
    path = tmp_path / "t.freiburg"
    path.write_text("1 1 2 3 0 0 0 1\n2 2 2 3 0 0 0 1\n")
    start = np.eye(4)
    start[:3, 3] = [5, 5, 5]
    found = {r.frame_id: np.array(r.pose).reshape(4, 4) for r in rgbd.trajectory(spark, str(path), start).collect()}
    assert np.allclose(found[0], start) and np.allclose(found[1], start)
    assert np.allclose(abs(found[2] - found[1]).sum(), 1.0)
    path.write_text("1 1 2 3 0 0 0 1\n3 2 2 3 0 0 0 1\n")
    with pytest.raises(ValueError):
        rgbd.trajectory(spark, str(path))


def test_raw_files(spark, tmp_path):
    np.array([[1, 2, 3, np.nan], [4, 5, 6, 7]], np.float32).tofile(tmp_path / "a.raw")
    rows = rgbd.raw_floats(spark, str(tmp_path / "a.raw"), ["x", "y", "z", "sdf"])
    assert rows.count() == 2 and rgbd.complete(rows, ["x", "sdf"]).first().x == 4.0
    (tmp_path / "a.cam").write_bytes(np.arange(3, dtype=np.float32).tobytes() + np.arange(32, dtype=np.float32).tobytes())
    cams = rgbd.cameras(spark, str(tmp_path / "a.cam")).orderBy("view").collect()
    assert len(cams) == 2 and cams[1].matrix[0] == 16.0 and cams[0].z_max == 2.0
    (tmp_path / "a.bin").write_bytes(np.array([2], np.int32).tobytes() + np.arange(16, dtype=np.float32).tobytes())
    assert [r.nx for r in rgbd.reference_points(spark, str(tmp_path / "a.bin")).orderBy("pid").collect()] == [8.0, 12.0]


def test_mesh_of_several_objects(spark, tmp_path):
    (tmp_path / "m.obj").write_text("o a\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3 4\no b\nv 0 0 1\nf 1/1 2/1 5/1\n")
    vertices, faces = rgbd.mesh(spark, str(tmp_path / "m.obj"))
    assert vertices.count() == 5
    assert [tuple(r)[2:] for r in faces.orderBy("fid").collect()] == [(0, 1, 2), (0, 2, 3), (0, 1, 4)]


def test_catalogue_and_spiral(spark):
    shapes = spark.createDataFrame([("a", f"s{k}") for k in range(9)] + [("b", "x")], "category string, name string")
    rows = rgbd.shape_catalogue(shapes, 3, {"a": 0.5}).collect()
    assert sorted((r.category, r.scale) for r in rows) == [("a", 0.5)] * 3 + [("b", 1.0)]
    assert rgbd.shape_catalogue(shapes, -1, {}).count() == 10
    r = rgbd.sphere_spiral(spark, 100).select(F.max(F.abs(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 - 1))).first()[0]
    assert r < 1e-12
    assert rgbd.read_config('[{"a": 1, "_": "x"}, {"b": 2}]') == {"a": 1, "b": 2}


def test_voxel_records_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, 0, [1.0]), ("s", 2, 1, [2.0])], "source string, mesh_idx int, lif_idx int, data array<double>")
    sinks.write_voxels(rows, str(tmp_path / "v"))
    sinks.write_voxels(rows.where("mesh_idx = 1"), str(tmp_path / "v"))
    assert rgbd.voxel_records(spark, str(tmp_path / "v")).count() == 1
    soup = spark.createDataFrame([(0, [(0.0, 0.0, 0.0, 0.1), (1.0, 0.0, 0.0, 0.1), (0.0, 1.0, 0.0, 0.1)]), (1, [(1.0, 0.0, 0.0, 0.1), (1.0, 1.0, 0.0, 0.1), (0.0, 1.0, 0.0, 0.1)])], "tri long, v array<struct<x:double,y:double,z:double,std:double>>")
    vertices, faces = sinks.indexed_mesh(soup)
    assert vertices.count() == 4 and faces.count() == 2


@pytest.mark.parametrize("freeze", [None, 4.0])
def test_stream_equals_batches(spark, tmp_path, freeze):
    grid = Grid((0.0, 0.0, 0.0), 1.0, (2, 2, 2))
    rnd = np.random.default_rng(2)
    batches = [rnd.uniform(0.01, 2, size=(12, 3)) for _ in range(3)]
    for k, b in enumerate(batches):
        spark.createDataFrame(b.tolist(), "x double, y double, z double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = run_to_end(spark, str(tmp_path / "in"), "x double, y double, z double", grid, str(tmp_path / "work"), freeze)
    rows = {r.lin_id: r for r in found.collect()}
    if freeze is None:
        every = np.concatenate(batches)
        for r in rows.values():
            cell = np.ceil(every) - 1
            mine = every[(cell[:, 2] + 2 * cell[:, 1] + 4 * cell[:, 0]) == r.lin_id]
            assert r.obs_count == len(mine) and np.allclose([r.cx, r.cy, r.cz], mine.mean(0))
    else:
        assert sum(r.obs_count for r in rows.values()) <= 36
