"""Manifests prune what is read; samples, maps and metrics come back."""

import pytest
from pyspark.sql import functions as F

from stratavox.sources import rgbd, sinks


@pytest.mark.parametrize("few", [1_000_000, 1])
def test_a_manifest_prunes_the_payload(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(rgbd, "FEW_MESHES", few)  # beyond it the same rows, without pruning
    path = str(tmp_path / "v")
    rows = [("ab"[k % 2], m, k, [float(k)]) for m in range(6) for k in range(4)]
    sinks.write_voxels(spark.createDataFrame(rows, "source string, mesh_idx int, lif_idx int, data array<double>"), path)
    assert rgbd.voxel_records(spark, path).count() == 24
    listed = (F.col("source") == "a") & F.col("mesh_idx").isin(1, 4)
    spark.read.json(f"{path}/manifest").where("mesh_idx = 1").write.mode("append").json(f"{path}/manifest")  # listed twice
    found, whole = rgbd.voxel_records(spark, path, listed), rgbd.voxel_records(spark, path)
    if few > 1:
        for part in (tmp_path / "v" / "payload").glob("mesh_idx=*/*.parquet"):
            if part.parent.name not in ("mesh_idx=1", "mesh_idx=4"):
                part.unlink()  # an error if it were opened now
        with pytest.raises(Exception, match="not exist"):
            whole.collect()
    assert sorted((r.source, r.mesh_idx, r.lif_idx) for r in found.collect()) == [("a", m, k) for m in (1, 4) for k in (0, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan or few == 1
    assert rgbd.voxel_records(spark, path, F.lit(False)).count() == 0


def test_samples_maps_and_metrics_come_back(spark, tmp_path):
    samples = spark.createDataFrame([(k, float(k), 0.0, 0.0, 0.1) for k in range(25)], "sid long, x double, y double, z double, sdf double")
    sinks.write_samples(samples, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "samples")).count() == 25
    assert sorted(r.sid for r in spark.read.parquet(str(tmp_path / "s" / "preview")).collect()) == [0, 10, 20]
    voxels = spark.createDataFrame([(3, [0.5, 1.0], 2.0, True)], "lin_id long, latent array<double>, obs_count double, optimized boolean")
    for _ in range(2):
        sinks.save_map(voxels, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).collect() == voxels.collect()
    for step in range(2):
        sinks.append_metrics(spark.createDataFrame([(step, "loss", 1.0 / (step + 1), "left out")], "step int, name string, value double, note string"), str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(0, "loss", 1.0), (1, "loss", 0.5)]
