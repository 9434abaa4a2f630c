"""Geometry to look at: voxel wireframes, line sets, visible faces, orientation tallies and made-up shapes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.augment import seeded
from stratavox.operators.grid import Grid
from stratavox.operators.mesh import CORNERS, EDGES
from stratavox.operators.scan import prefix_sum


def wireframes(cells: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Vertices (lin_id, vid, x, y, z) and edges (lin_id, a, b) of cells: eight and twelve each."""
    g = grid.axes(F.col("lin_id"))
    corner = [F.struct(F.lit(k).alias("vid"), *[((a + o) * grid.size + lo).alias(n) for a, o, lo, n in zip(g, c, grid.low, "xyz", strict=True)]) for k, c in enumerate(CORNERS)]
    edges = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EDGES])
    return cells.select("lin_id", F.inline(F.array(*corner))), cells.select("lin_id", F.inline(edges))


def merge_lines(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (set_id, a, b) of line sets (set_id, n_vertices) over one vertex buffer: each set's shifted by the vertices before it."""
    ends = prefix_sum(sets, "n_vertices", "set_id", out="end").select("set_id", (F.col("end") - F.col("n_vertices")).alias("shift"))
    return edges.join(ends, "set_id").select("set_id", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"))


def visible_faces(samples: DataFrame, views: DataFrame, pixel: float) -> DataFrame:
    """(view, u, v, face): for each view and pixel the face that lies nearest, by an orthographic view of surface samples.

    Samples are (face, x, y, z), views (view, matrix of 16, rows first). Nearest
    is the largest z after the view's transform; ties go to the smaller face.
    """
    m = lambda r, c: F.element_at("matrix", 4 * r + c + 1)
    along = [m(r, 0) * F.col("x") + m(r, 1) * F.col("y") + m(r, 2) * F.col("z") + m(r, 3) for r in range(3)]
    seen = samples.crossJoin(F.broadcast(views)).select("view", "face", F.floor(along[0] / pixel).alias("u"), F.floor(along[1] / pixel).alias("v"), along[2].alias("z"))
    return seen.groupBy("view", "u", "v").agg(F.min_by("face", F.struct(-F.col("z"), "face")).alias("face"))


def orientation_tallies(pixels: DataFrame) -> DataFrame:
    """(face, n, sign): how often each face (face, nz) was seen, and from which side more often."""
    return pixels.groupBy("face").agg(F.count("*").alias("n"), F.sum(F.signum("nz")).alias("sign"))


def made_up_shapes(spark: SparkSession, n: int) -> DataFrame:
    """(shape_id, kind, scale, axis, angle, tx, ty, tz): cubes, spheres and cylinders of random size, turn and place."""
    key = F.col("id")
    kind = F.element_at(F.array(F.lit("cube"), F.lit("sphere"), F.lit("cylinder")), (1 + F.floor(seeded(key, "kind") * 3)).cast("int"))
    z, turn = 2 * seeded(key, "z") - 1, 2 * math.pi * seeded(key, "turn")
    flat = F.sqrt(1 - z * z)
    place = [(seeded(key, f"t{c}") - 0.5).alias(f"t{c}") for c in "xyz"]
    return spark.range(n).select(key.alias("shape_id"), kind.alias("kind"), (0.1 + 1.4 * seeded(key, "scale")).alias("scale"), F.array(flat * F.cos(turn), flat * F.sin(turn), z).alias("axis"), (2 * math.pi * seeded(key, "angle")).alias("angle"), *place)


def palette(i):
    """One of ten colours for an id."""
    colours = ["blue", "orange", "green", "red", "purple", "brown", "pink", "gray", "olive", "cyan"]
    return F.element_at(F.array(*[F.lit(c) for c in colours]), (i % 10 + 1).cast("int"))
