"""Readers of depth sequences, trajectories, raw samples, meshes, cameras and voxel records; all through Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratavox.functions.pose import from_quaternion, inverse

#: Meshes of a manifest that are broadcast, to prune folders by; four bytes each.
FEW_MESHES = 1_000_000


def frame_files(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """(frame_id, stem, rgb, depth): the files of ``rgb/`` in the numeric order of their names, each with ``depth/`` of its place."""
    stem = F.regexp_extract("path", r"(\d+)\.[^/]*$", 1).cast("long")
    rgb = spark.read.format("binaryFile").load(f"{path}/rgb").select(stem.alias("stem"), F.col("path").alias("rgb"))
    depth = spark.read.format("binaryFile").load(f"{path}/depth").select(stem.alias("frame_id"), F.col("path").alias("depth"))
    stems = sorted(r["stem"] for r in rgb.select("stem").collect())  # a sequence's file names, not its pixels
    order = spark.createDataFrame([(i, s) for i, s in enumerate(stems)][start:end], "frame_id long, stem long")
    return order.join(rgb, "stem").join(depth, "frame_id").select("frame_id", "stem", "rgb", "depth")


def trajectory(spark: SparkSession, path: str, first: np.ndarray | None = None) -> DataFrame:
    """(frame_id, pose array of 16) from rows ``id tx ty tz qx qy qz qw`` with ids 1, 2, ... ; frame 0 is frame 1's.

    The y axis is flipped and the world turned by 180 degrees about z; with
    ``first`` all poses are moved so that frame 0 has that pose.
    """
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    rows = rows.select(F.get(parts, 0).cast("double").cast("long").alias("frame_id"), *[F.get(parts, k + 1).cast("double").alias(n) for k, n in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"))])
    ids = rows.agg(F.min("frame_id"), F.max("frame_id"), F.count_distinct("frame_id"), F.count("*")).first()
    if ids[3] and (ids[0] != 1 or ids[1] != ids[2] or ids[2] != ids[3]):
        raise ValueError("ids of a trajectory are 1, 2, ... without gaps")
    rows = rows.unionByName(rows.where("frame_id = 1").withColumn("frame_id", F.lit(0).cast("long")))
    flip, turn = np.diag([1.0, -1, 1, 1]), np.diag([-1.0, -1, 1, 1])

    def pose(r: pd.Series) -> np.ndarray:
        return turn @ flip @ from_quaternion(r.qx, r.qy, r.qz, r.qw, np.array([r.tx, r.ty, r.tz])) @ flip

    head = rows.where("frame_id = 0").toPandas()
    base = np.eye(4) if first is None or not len(head) else first @ inverse(pose(head.iloc[0]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"frame_id": frame["frame_id"], "pose": [(base @ pose(r)).ravel().tolist() for r in frame.itertuples()]})

    return rows.mapInPandas(run, "frame_id long, pose array<double>")


def raw_floats(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(path, row, names...) of files of 32-bit floats, ``len(names)`` to a row; a file that ends within a row is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for one, content in zip(frame["path"], frame["content"], strict=True):
                values = np.frombuffer(content, np.float32).reshape(-1, len(names)).astype(float)
                yield pd.DataFrame({"path": one, "row": np.arange(len(values))} | {n: values[:, k] for k, n in enumerate(names)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row long, " + ", ".join(f"{n} double" for n in names))


def complete(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows without NaN or null in any of ``names``."""
    keep: Column = F.lit(True)
    for n in names:
        keep = keep & F.col(n).isNotNull() & ~F.isnan(n)
    return rows.where(keep)


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """(path, half_window, z_min, z_max, view, matrix) of camera files: three floats, then 16 for each view."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for one, content in zip(frame["path"], frame["content"], strict=True):
                head, views = np.frombuffer(content[:12], np.float32), np.frombuffer(content[12:], np.float32).reshape(-1, 16)
                yield pd.DataFrame({"path": one, "half_window": float(head[0]), "z_min": float(head[1]), "z_max": float(head[2]), "view": np.arange(len(views)), "matrix": [v.astype(float).tolist() for v in views]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, half_window double, z_min double, z_max double, view long, matrix array<double>")


def reference_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, pid, x, y, z, nx, ny, nz) of reference files: a count, that many points of four floats, then as many normals."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for one, content in zip(frame["path"], frame["content"], strict=True):
                n = int(np.frombuffer(content[:4], np.int32)[0])
                v = np.frombuffer(content[4 : 4 + 32 * n], np.float32).reshape(2, n, 4).astype(float)
                yield pd.DataFrame({"path": one, "pid": np.arange(n)} | {a: v[0, :, k] for k, a in enumerate("xyz")} | {f"n{a}": v[1, :, k] for k, a in enumerate("xyz")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, pid long, x double, y double, z double, nx double, ny double, nz double")


def mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (path, vid, x, y, z) and triangles (path, fid, a, b, c) of OBJ files; all objects of a file are one mesh, polygons become fans.

    A file is one row here: lines are numbered within it, so files spread over tasks but each is read whole.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value"))
    parts = F.split(F.trim("value"), r"\s+")
    word = lines.withColumn("w", parts)
    of = lambda kind, name: word.where(F.get("w", 0) == kind).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "w"))).alias("r")).select("path", F.posexplode("r").alias(name, "r"))
    vertices = of("v", "vid").select("path", F.col("vid").cast("long").alias("vid"), *[F.get("r.w", k + 1).cast("double").alias(c) for k, c in enumerate("xyz")])
    corner = F.transform(F.slice("r.w", 2, F.size("r.w")), lambda x: F.substring_index(x, "/", 1).cast("long") - 1)
    fan = of("f", "face").select("path", "face", corner.alias("c"))
    fan = fan.select("path", "face", F.posexplode(F.expr("transform(sequence(1, size(c) - 2), i -> struct(c[0] AS a, c[i] AS b, c[i + 1] AS c))")).alias("part", "t"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("face", "part")) - 1
    return vertices, fan.select("path", number.cast("long").alias("fid"), "t.*")


def shape_catalogue(shapes: DataFrame, each: int, scale: dict[str, float]) -> DataFrame:
    """Up to ``each`` shapes (all if -1) of each category (category, name), by the md5 of their name, with the category's scale."""
    from stratavox.operators.sample import per_group

    chosen = shapes if each < 0 else per_group(shapes, "category", "name", each).drop("place")
    pairs = [x for k, v in scale.items() for x in (F.lit(k), F.lit(float(v)))]
    factor = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("category")), F.lit(1.0)) if pairs else F.lit(1.0)
    return chosen.withColumn("scale", factor)


def sphere_spiral(spark: SparkSession, n: int) -> DataFrame:
    """``n`` points of the golden-angle spiral on the unit sphere: (id, x, y, z)."""
    z = 1 - (2 * F.col("id") + 1) / n
    turn = F.col("id") * (np.pi * (3 - np.sqrt(5)))
    r = F.sqrt(1 - z * z)
    return spark.range(n).select("id", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), z.alias("z"))


def read_config(text: str) -> dict:
    """A JSON configuration: an object, or a list of objects merged in order; keys that begin with ``_`` are comments."""
    found = json.loads(text)
    merged: dict = {}
    for part in found if isinstance(found, list) else [found]:
        merged |= {k: v for k, v in part.items() if not k.startswith("_")}
    return merged


def voxel_records(spark: SparkSession, path: str, listed: Column | None = None) -> DataFrame:
    """The voxel records that :func:`stratavox.sources.sinks.write_voxels` wrote, or those that rows ``listed`` of the manifest name.

    ``listed`` is a condition on the manifest's (source, mesh_idx, lif_idx). The
    meshes it leaves prune the payload's folders when the query runs, so files of
    other meshes aren't opened; a row listed twice gives its record once. Records
    that the manifest doesn't name are left out.
    """
    payload = spark.read.parquet(f"{path}/payload")
    if listed is None:
        return payload
    names = ["source", "mesh_idx", "lif_idx"]
    found = spark.read.schema(payload.select(*names).schema).json(f"{path}/manifest").where(listed)
    meshes = found.where("mesh_idx >= 0").select("mesh_idx").distinct()
    few = meshes.limit(FEW_MESHES + 1).count() <= FEW_MESHES
    some = payload.join(F.broadcast(meshes) if few else meshes, "mesh_idx", "left_semi")  # pruned where they are broadcast
    return some.join(found, names, "left_semi")
