"""Sparse voxel grids: cells of points, occupancy, pruning, dilation, scattering and down-sampling."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.geometry import box_cell, map_cell


@dataclass(frozen=True)
class Grid:
    """Cells of edge ``size`` from ``low``, ``shape`` of them; cells are half-open (lo, hi]."""

    low: tuple[float, float, float]
    size: float
    shape: tuple[int, int, int]

    @classmethod
    def over(cls, low: tuple[float, float, float], high: tuple[float, float, float], size: float) -> Grid:
        return cls(low, size, tuple(-int(-(b - a) // size) for a, b in zip(low, high, strict=True)))  # type: ignore[arg-type]

    def inside(self, points: DataFrame) -> DataFrame:
        """Points in the grid; NaN and what lies outside goes, before any cell is computed."""
        keep = F.lit(True)
        for name, low, n in zip("xyz", self.low, self.shape, strict=True):
            c = F.col(name)
            keep = keep & ~F.isnan(c) & (c > low) & (c <= low + n * self.size)
        return points.where(keep)

    def cells(self, points: DataFrame) -> DataFrame:
        """Points in the grid with their cells ``gx``, ``gy``, ``gz`` and ``lin_id``."""
        axes = {f"g{n}": map_cell(F.col(n), low, self.size) for n, low in zip("xyz", self.low, strict=True)}
        return self.inside(points).withColumns(axes).withColumn("lin_id", self.linear(F.col("gx"), F.col("gy"), F.col("gz")))

    def linear(self, gx: Column, gy: Column, gz: Column) -> Column:
        return gz + self.shape[2] * gy + self.shape[2] * self.shape[1] * gx

    def axes(self, lin_id: Column) -> tuple[Column, Column, Column]:
        nz, nyz = self.shape[2], self.shape[1] * self.shape[2]
        return F.floor(lin_id / nyz), F.floor(lin_id % nyz / nz), lin_id % nz

    def clamped(self, g: Column, axis: int) -> Column:
        return F.least(F.greatest(g, F.lit(0)), F.lit(self.shape[axis] - 1))

    def shifted(self, cells: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
        """The cells at ``offsets`` from each ``lin_id``, clamped to the grid, one row for each offset."""
        gx, gy, gz = self.axes(F.col("lin_id"))
        moved = [self.linear(*(self.clamped(g + o, k) for k, (g, o) in enumerate(zip((gx, gy, gz), offset, strict=True)))) for offset in offsets]
        return cells.withColumn("lin_id", F.explode(F.array(*[m.cast("long") for m in moved])))


def occupancy(points: DataFrame, grid: Grid) -> DataFrame:
    """Points and their centroid for each occupied cell."""
    return grid.cells(points).groupBy("lin_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])


def prune(points: DataFrame, grid: Grid, more_than: int) -> DataFrame:
    """Points in cells with more than ``more_than`` points (all if that isn't positive).

    Counts are combined before the shuffle and joined back, so a hot cell never
    meets in one task as it would in a window.
    """
    found = grid.cells(points)
    if more_than <= 0:
        return found
    full = found.groupBy("lin_id").count().where(F.col("count") > more_than).select("lin_id")
    return found.join(full, "lin_id", "leftsemi")


def dilate(cells: DataFrame, grid: Grid, corners: bool = False) -> DataFrame:
    """Cells and their six face neighbours (with ``corners`` all 26 around), clamped to the grid, each once."""
    if corners:
        rows = cells.select(*[g.cast("long").alias(n) for g, n in zip(grid.axes(F.col("lin_id")), ("gx", "gy", "gz"), strict=True)])
        for n, size in zip(("gx", "gy", "gz"), grid.shape, strict=True):
            rows = rows.withColumn(n, F.expr(f"explode(sequence(greatest({n} - 1, 0L), least({n} + 1, {size - 1}L)))"))
        return rows.select(grid.linear(F.col("gx"), F.col("gy"), F.col("gz")).cast("long").alias("lin_id")).distinct()
    faces = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    return grid.shifted(cells.select("lin_id"), faces).distinct()


def scatter8(points: DataFrame, grid: Grid, targets: DataFrame) -> DataFrame:
    """Each point once for each of the eight cells around it that is a target, as a bag: clamped cells may repeat.

    The eight are the cells of the point moved by half a cell along each axis.
    ``rx``, ``ry``, ``rz`` are the places relative to the target cell's centre.
    """
    moved = []
    for offset in product((-0.5, 0.5), repeat=3):
        g = [self_cell(points, grid, k, o) for k, o in enumerate(offset)]
        moved.append(F.struct(*[x.alias(n) for x, n in zip(g, ("gx", "gy", "gz"), strict=True)], grid.linear(*g).alias("lin_id")))
    spread = grid.inside(points).withColumn("t", F.explode(F.array(*moved))).select("*", "t.*").drop("t")
    places = {f"r{n}": (F.col(n) - low) / grid.size - F.col(f"g{n}") - 0.5 for n, low in zip("xyz", grid.low, strict=True)}
    return spread.join(targets.select("lin_id"), "lin_id", "leftsemi").withColumns(places)


def self_cell(points: DataFrame, grid: Grid, axis: int, offset: float) -> Column:
    """The clamped cell along one axis of a point moved by ``offset`` cells."""
    c = F.col("xyz"[axis])
    return grid.clamped((F.ceil((c - grid.low[axis]) / grid.size + offset) - 1).cast("long"), axis)


def downsample(points: DataFrame, size: float, also: tuple[str, ...] = ()) -> DataFrame:
    """Means of the points (and of the columns ``also``) for each cell [lo, hi) from half a cell below the minimum.

    Means don't depend on the order or partitions of the rows: see :func:`_mean`.
    """
    names = ("x", "y", "z", *also)
    bounds = points.agg(*[F.min(c).alias(f"min_{c}") for c in "xyz"], *[_steps(F.col(c).cast("double")).alias(f"steps_{c}") for c in names])
    cells = points.crossJoin(F.broadcast(bounds)).withColumns({f"b{c}": box_cell(F.col(c), F.col(f"min_{c}"), size) for c in "xyz"})
    return cells.groupBy("bx", "by", "bz").agg(F.count("*").alias("n"), *[_mean(F.col(c).cast("double"), F.col(f"steps_{c}")).alias(f"m{c}") for c in names])


def _steps(c: Column) -> Column:
    """Aggregate: the power of two that takes the largest finite magnitude of ``c`` to between 2^25 and 2^26."""
    most = F.max(F.when(F.abs(c) < float("inf"), F.abs(c)))
    return F.pow(F.lit(2.0), F.least(26 - F.ceil(F.log2(F.when(most > 0, most))), F.lit(1000)))


def _mean(c: Column, steps: Column) -> Column:
    """Aggregate: the mean of ``c`` by its exact sum, rounded; the last bits of ``avg`` depend on the order of rows.

    Whole steps sum without rounding (up to 2^27 rows a group). What is left of each value is 2^26 times smaller
    than the largest one, and so is the rounding of its sum.
    """
    coarse = F.coalesce(F.rint(c * steps) / steps, c)  # all zero or not finite: no steps
    fine = F.when(F.abs(c) < float("inf"), c - coarse).otherwise(0.0)
    return (F.sum(coarse) + F.sum(fine)) / F.count(c)


def lookup(points: DataFrame, grid: Grid, voxels: DataFrame, more_than: int) -> DataFrame:
    """All points with their voxel's columns where it was seen more than ``more_than`` times, and a mask of those."""
    found = grid.cells(points).join(voxels.where(F.col("obs_count") > more_than), "lin_id", "left")
    return found.withColumn("known", F.col("obs_count").isNotNull())
