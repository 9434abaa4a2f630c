"""A colour and depth frame made ready for tracking and integration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.geometry import unproject
from stratavox.operators.grid import downsample
from stratavox.operators.spatial import estimate_normals, remove_outliers
from stratavox.sources.rgbd import complete
from stratavox.sources.shared import settle


def intensity(r: Column, g: Column, b: Column) -> Column:
    """A pixel's brightness: the mean of its channels."""
    return (r + g + b) / 3


def thinned(pixels: DataFrame, step: int, height: int, width: int) -> DataFrame:
    """(frame_id, v, u, depth, r, g, b) of frames of one ``step``-th of the size.

    Depth is that of a block's first pixel; colours are those at its middle, the
    mean of the pixels around it if ``step`` is even. Rows and columns beyond the
    last whole block are left out; a block without its first pixel has a null depth.
    """
    rows = pixels.where((F.col("v") < height // step * step) & (F.col("u") < width // step * step))
    first = (F.col("v") % step == 0) & (F.col("u") % step == 0)
    middle = [(F.col(c) % step).isin((step - 1) // 2, step // 2) for c in "vu"]
    keys = ["frame_id", *[F.floor(F.col(c) / step).alias(c) for c in "vu"]]
    return rows.groupBy(*keys).agg(F.max(F.when(first, F.col("depth"))).alias("depth"), *[F.avg(F.when(middle[0] & middle[1], F.col(c))).alias(c) for c in "rgb"])


@dataclass(frozen=True)
class Preparation:
    """How a frame of ``height`` x ``width`` pixels becomes points.

    Pixels are thinned by ``step``; points with fewer than ``crowd`` points within
    ``crowd_radius`` go, and those without a normal from up to ``neighbours``
    points within ``normal_radius``; cells of ``cell`` are averaged.
    """

    intrinsics: tuple[float, float, float, float]
    height: int
    width: int
    step: int = 2
    crowd: int = 16
    crowd_radius: float = 0.05
    neighbours: int = 16
    normal_radius: float = 0.1
    cell: float = 0.02

    def points(self, pixels: DataFrame) -> DataFrame:
        """(pid, x, y, z, r, g, b) of one frame's pixels (frame_id, v, u, depth, r, g, b) that have a depth."""
        rows = complete(thinned(pixels, self.step, self.height, self.width), ["depth"])
        fx, fy, cx, cy = (x / self.step for x in self.intrinsics)
        place = unproject(F.col("u"), F.col("v"), F.col("depth"), fx, fy, cx, cy)
        pid = F.col("v") * (self.width // self.step) + F.col("u")
        return rows.select(pid.alias("pid"), *[p.alias(c) for p, c in zip(place, "xyz", strict=True)], "r", "g", "b")

    def coloured(self, pixels: DataFrame) -> DataFrame:
        """(pid, x, y, z, r, g, b, nx, ny, nz): one frame's points that aren't outliers and have a normal."""
        kept = settle(remove_outliers(self.points(pixels), self.crowd, self.crowd_radius), "kept")
        normals = estimate_normals(kept, self.neighbours, self.normal_radius).select("pid", "nx", "ny", "nz")
        return complete(kept.join(normals, "pid"), ["nx"])

    def processed(self, coloured: DataFrame) -> DataFrame:
        """(bx, by, bz, n, mx, my, mz, mnx, mny, mnz): places and normals averaged by cell."""
        return downsample(coloured, self.cell, ("nx", "ny", "nz"))
