"""Queries of what was written and is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox.plans import views
from stratavox.plans.registered import query
from stratavox.sources import rgbd, sinks
from stratavox.sources.shared import fresh_path


@query("SELECT CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS source, label AS mesh_idx, vec_id AS lif_idx, x, y, z FROM epts WHERE label >= 0 AND (vec_id % 3 = 0 AND label IN (2, 5, 7) OR vec_id % 3 <> 0 AND label = 9)", "epts")
def manifest_records(spark, sf_dir):
    """Records written by mesh and read through their manifest: three meshes of one source, and one of the other."""
    path = fresh_path(spark, "records")
    source = F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b")
    sinks.write_voxels(views.epts(spark, sf_dir).where("label >= 0").select(source.alias("source"), F.col("label").alias("mesh_idx"), F.col("vec_id").alias("lif_idx"), "x", "y", "z"), path)
    listed = (F.col("source") == "a") & F.col("mesh_idx").isin(2, 5, 7) | (F.col("source") == "b") & (F.col("mesh_idx") == 9)
    return rgbd.voxel_records(spark, path, listed).select("source", "mesh_idx", "lif_idx", "x", "y", "z")
