"""Writers of voxel records, samples, meshes, maps and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.colour import jet
from stratavox.operators.scan import numbered, placed
from stratavox.sources.shared import settle


def dense_ids(df: DataFrame, order: str, out: str) -> DataFrame:
    """Dense ids 0, 1, ... by an integer order without ties: the same in every run."""
    return numbered(df, [], order, out).withColumn(out, F.col(out) - 1)


def write_voxels(records: DataFrame, path: str) -> None:
    """Voxel records by ``mesh_idx``, and the manifest of (source, mesh_idx, lif_idx); what was there before goes."""
    records.write.mode("overwrite").partitionBy("mesh_idx").parquet(f"{path}/payload")
    records.select("source", "mesh_idx", "lif_idx").write.mode("overwrite").json(f"{path}/manifest")


def write_samples(samples: DataFrame, path: str, every: int = 10, order: str = "sid") -> None:
    """Samples as Parquet, and every tenth of them for inspection."""
    samples.write.mode("overwrite").parquet(f"{path}/samples")
    samples.where(F.col(order) % every == 0).write.mode("overwrite").parquet(f"{path}/preview")


def save_map(voxels: DataFrame, path: str) -> None:
    """A snapshot of the voxel map."""
    voxels.write.mode("overwrite").parquet(path)


def indexed_mesh(triangles: DataFrame, block: Column | None = None, limits: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z, std, r, g, b) and faces (tri, a, b, c) of a triangle soup (tri, v): equal places become one vertex.

    Vertex ids are dense from 0, by an integer ``block`` of x, y, z (4,096 of
    hashes unless given, such as a grid's cells) and within it by x, y, z. A
    vertex takes the mean ``std`` of its corners; its colour shows it between
    ``limits``, or between the least and the largest of the mesh. Triangles with a
    null coordinate are dropped.
    """
    whole = F.forall("v", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    rows = triangles.where(whole).select("tri", F.posexplode("v").alias("corner", "p")).select("tri", "corner", "p.*")
    spots = settle(rows.groupBy("x", "y", "z").agg(F.avg("std").alias("std")), "spots")
    cell = F.pmod(F.xxhash64("x", "y", "z"), F.lit(4096)) if block is None else block
    vertices = settle(placed(spots, cell, ["x", "y", "z"], "vid"), "vertices")
    corners = rows.join(vertices.select("x", "y", "z", "vid"), ["x", "y", "z"])
    faces = corners.groupBy("tri").agg(*[F.max(F.when(F.col("corner") == k, F.col("vid"))).alias(n) for k, n in enumerate("abc")])
    return coloured(vertices, "std", limits), faces


def coloured(df: DataFrame, column: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """Rows with r, g, b of ``column``, clipped to ``limits`` or from its least to its largest value; equal limits or values give the lowest colour."""
    if limits is None:
        rows = min_max(df, column, "_share")
    else:
        low, high = limits
        rows = df.withColumn("_share", F.greatest(F.least((F.col(column) - low) / (high - low), F.lit(1.0)), F.lit(0.0)) if high > low else F.lit(0.0))
    return rows.withColumns(jet(F.col("_share"))).drop("_share")


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` scaled to [0, 1] over all rows; 0 where all are equal."""
    ends = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    span = F.col("_high") - F.col("_low")
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(span > 0, (F.col(column) - F.col("_low")) / span).otherwise(0.0)).drop("_low", "_high")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """(step, name, value) rows added to a metrics table."""
    metrics.select("step", "name", "value").write.mode("append").parquet(path)
