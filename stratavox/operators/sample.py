"""Sampling: triangle areas and their running sum, surface points by area, strata, bounded groups, training voxels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.augment import gaussian
from stratavox.functions.geometry import barycentric, triangle_area, uniform, vec
from stratavox.operators.grid import Grid
from stratavox.operators.scan import interval_lookup, prefix_sum
from stratavox.operators.spatial import near_pairs, vote_sdf
from stratavox.sources.shared import settle


def areas(triangles: DataFrame) -> DataFrame:
    """Triangles (tri_id, ax .. cz) with their ``area``."""
    return triangles.withColumn("area", triangle_area(vec("ax", "ay", "az"), vec("bx", "by_", "bz"), vec("cx", "cy", "cz")))


def area_cdf(triangles: DataFrame) -> DataFrame:
    """Areas with their running sum ``cdf`` by ``tri_id`` and the sum ``below`` it."""
    run = prefix_sum(areas(triangles), "area", "tri_id", out="cdf")
    return run.withColumn("below", F.col("cdf") - F.col("area"))


def surface_samples(triangles: DataFrame, count: int) -> DataFrame:
    """``count`` points over the surface by area: (sid, tri_id, x, y, z); the same in every run."""
    cdf = area_cdf(triangles)
    total = cdf.agg(F.max("cdf")).first()[0] or 0.0
    key = lambda n: F.concat_ws(":", F.col("sid").cast("string"), F.lit(n))
    picks = triangles.sparkSession.range(count).select(F.col("id").alias("sid")).withColumn("t", uniform(key("t")) * total)
    met = interval_lookup(picks, "t", cdf, "below", "cdf", total)
    p = barycentric(vec("ax", "ay", "az"), vec("bx", "by_", "bz"), vec("cx", "cy", "cz"), uniform(key("a")), uniform(key("b")))
    return met.select("sid", "tri_id", *[x.alias(c) for x, c in zip(p, "xyz", strict=True)])


def per_group(df: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Up to ``most`` rows of each group, by the md5 of their key: the first ones are found before the shuffle as well."""
    order = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def with_replacement(df: DataFrame, stratum: str, key: str, draws: int) -> DataFrame:
    """``draws`` rows of each stratum with replacement: (stratum, draw, key); hash-seeded."""
    order = Window.partitionBy(stratum, "_block").orderBy(key)
    rows = df.select(stratum, key).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(64)))
    counts = rows.groupBy(stratum, "_block").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy(stratum).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("start", F.coalesce(start, F.lit(0)))
    placed = rows.withColumn("i", F.row_number().over(order)).join(counts.select(stratum, "_block", "start"), [stratum, "_block"])
    placed = placed.withColumn("place", F.col("start") + F.col("i"))
    sizes = counts.groupBy(stratum).agg(F.sum("n").alias("n"))
    draw = sizes.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    seed = F.concat_ws(":", F.col(stratum).cast("string"), F.col("draw").cast("string"))
    draw = draw.withColumn("place", 1 + F.floor(uniform(seed) * F.col("n")))
    return draw.join(placed.select(stratum, "place", key), [stratum, "place"]).select(stratum, "draw", key)


def training_voxels(samples: DataFrame, surface: DataFrame, grid: Grid, reach: float, least: int, low: float, high: float, cells: DataFrame | None = None) -> DataFrame:
    """Voxels that are worth training on, of those that hold surface points or of ``cells`` (lin_id): (lin_id, n_near, n_local, n_surface, positive).

    Voxel centres are joined with samples (sid, x, y, z, sdf) and surface points
    (pid, x, y, z) within a box of ``reach`` cells; kept are those with enough of
    both in their own cell and a share of positive samples within [low, high].
    """
    cells = grid.cells(surface).select("lin_id").distinct() if cells is None else cells
    g = grid.axes(F.col("lin_id"))
    centre = cells.select(F.col("lin_id").alias("qid"), *[((a + 0.5) * grid.size + lo).alias(c) for a, lo, c in zip(g, grid.low, "xyz", strict=True)])
    near = near_pairs(centre, samples.withColumnRenamed("sid", "pid"), grid.size * reach / 2, chebyshev=True)
    inside: Column = F.greatest(*[F.abs(F.col(c) - F.col(f"q{c}")) for c in "xyz"]) <= grid.size / 2
    by_samples = near.groupBy("qid").agg(F.count("*").alias("n_near"), F.count_if(inside).alias("n_local"), (F.count_if(F.col("sdf") > 0) / F.count("*")).alias("positive"))
    on = near_pairs(centre, surface, grid.size * reach / 2, chebyshev=True).groupBy("qid").agg(F.count("*").alias("n_surface"))
    kept = by_samples.join(on, "qid").where((F.col("n_local") >= least) & (F.col("n_surface") >= least) & F.col("positive").between(low, high))
    return kept.withColumnRenamed("qid", "lin_id")


def training_records(voxels: DataFrame, samples: DataFrame, grid: Grid, reach: float, scale: float = 1.0) -> DataFrame:
    """Samples (sid, x, y, z, sdf) of each voxel (lin_id) within a box of ``reach`` cells: (lin_id, sid, x, y, z, sdf), relative to its centre, in cells.

    ``scale`` multiplies places and distances first, as for shapes that were sampled at another size.
    """
    scaled = samples.select(F.col("sid").alias("pid"), *[(F.col(c) * scale).alias(c) for c in ("x", "y", "z", "sdf")])
    g = grid.axes(F.col("lin_id"))
    centre = voxels.select(F.col("lin_id").alias("qid"), *[((a + 0.5) * grid.size + lo).alias(c) for a, lo, c in zip(g, grid.low, "xyz", strict=True)])
    near = near_pairs(centre, scaled, grid.size * reach / 2, chebyshev=True)
    places = [((F.col(c) - F.col(f"q{c}")) / grid.size).alias(c) for c in "xyz"]
    return near.select(F.col("qid").alias("lin_id"), F.col("pid").alias("sid"), *places, (F.col("sdf") / grid.size).alias("sdf"))


def batches(df: DataFrame, key: str, size: int, digits: int = 3) -> DataFrame:
    """Rows in the order of their key's md5, ``size`` to a ``batch`` (0, 1, ...); the last, partial batch is dropped.

    Places go in two steps: 16^``digits`` ranges of the digest are counted, and
    rows numbered within each, so no task holds the whole order.
    """
    rows = df.withColumn("_md5", F.md5(F.col(key).cast("string").cast("binary")))
    rows = rows.withColumn("_range", F.conv(F.substring("_md5", 1, digits), 16, 10).cast("int"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(F.lit(1)).orderBy("_range")
    ends = counts.select("_range", (F.sum("_n").over(whole) - F.col("_n")).alias("_start"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy("_md5", key)) - 1
    placed = rows.join(F.broadcast(ends), "_range").withColumn("batch", F.floor(place / size))  # at most 16^digits rows
    return placed.where(F.col("batch") < F.floor(F.col("_total") / size)).drop("_md5", "_range", "_start", "_total")


def near_surface(triangles: DataFrame, count: int, deviations: tuple[float, ...]) -> DataFrame:
    """``count`` surface points by area, each moved by normal noise of every one of ``deviations``: (sid, x, y, z), sid = point * deviations + which."""
    on = surface_samples(triangles, count)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(d)).alias("d")) for k, d in enumerate(deviations)]))
    rows = on.withColumn("_m", each).select((F.col("sid") * len(deviations) + F.col("_m.k")).alias("sid"), *"xyz", F.col("_m.d").alias("_d"))
    key = F.concat_ws(":", F.lit("near"), F.col("sid").cast("string"))
    return rows.select("sid", *[(F.col(c) + F.col("_d") * gaussian(key, c)).alias(c) for c in "xyz"])


def in_box(box: DataFrame, count: int, first: int = 0) -> DataFrame:
    """``count`` points spread evenly over a box, one row (min_x, max_x, ..): (sid, x, y, z), sid from ``first`` on."""
    rows = box.sparkSession.range(count).select((F.col("id") + first).alias("sid")).crossJoin(F.broadcast(box))  # one row
    key = lambda c: F.concat_ws(":", F.lit("box"), F.col("sid").cast("string"), F.lit(c))
    return rows.select("sid", *[(F.col(f"min_{c}") + uniform(key(c)) * (F.col(f"max_{c}") - F.col(f"min_{c}"))).alias(c) for c in "xyz"])


@dataclass(frozen=True)
class Sampler:
    """How a shape is sampled for training.

    ``count`` samples, ``near`` of them (a share) in pairs about surface points
    with variances ``variance`` and a fifth of it, the others over the box of the
    used vertices, wider by ``expand``. Distances are voted by ``votes`` surface
    points. Voxels with ``least`` samples and surface points and a share of
    positive samples within [low, high] give records; see :func:`training_voxels`.
    """

    grid: Grid
    count: int
    near: float = 0.8
    variance: float = 0.02
    expand: float = 0.2
    votes: int = 11
    furthest: float | None = None
    reach: float = 2.0
    least: int = 50
    low: float = 0.1
    high: float = 0.9
    radius: float | None = None
    scale: float = 1.0

    def samples(self, triangles: DataFrame, surface: DataFrame) -> DataFrame:
        """(sid, x, y, z, sdf) of a shape's triangles against surface points (pid, x, y, z, nx, ny, nz); disagreeing votes are dropped, and all lengths multiplied by ``scale``."""
        pairs = int(self.count * self.near) // 2
        about = near_surface(triangles, pairs, (math.sqrt(self.variance), math.sqrt(self.variance / 5)))
        corners = triangles.select(F.explode(F.array(*[F.struct(*[F.col(f"{v}{c}{'_' if v + c == 'by' else ''}").alias(c) for c in "xyz"]) for v in "abc"])).alias("p")).select("p.*")
        ends = corners.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
        box = ends.select(*[(F.col(f"{n}{c}") + s * self.expand / 2).alias(f"{m}_{c}") for c in "xyz" for n, m, s in (("lo", "min", -1), ("hi", "max", 1))])
        places = settle(about.unionByName(in_box(box, self.count - 2 * pairs, 2 * pairs)), "places")
        voted = vote_sdf(places.withColumnRenamed("sid", "qid"), surface, self.votes, math.sqrt(self.variance / 5), self.radius, self.furthest)
        kept = places.join(voted.where(~F.isnan("sdf")).withColumnRenamed("qid", "sid"), "sid")
        return kept.select("sid", *[(F.col(c) * self.scale).alias(c) for c in ("x", "y", "z", "sdf")])

    def records(self, triangles: DataFrame, surface: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Samples (lin_id, sid, x, y, z, sdf) and surface points (lin_id, pid, x, y, z, nx, ny, nz) of the voxels that are worth training on, relative to their centres and in cells.

        A voxel is one that holds samples. Surface points with a NaN normal are dropped first.
        """
        good = surface.where(~(F.isnan("nx") | F.isnan("ny") | F.isnan("nz")))
        made = settle(self.samples(triangles, good), "samples")
        on = good.select("pid", *[(F.col(c) * self.scale).alias(c) for c in "xyz"], "nx", "ny", "nz")
        cells = self.grid.cells(made).select("lin_id").distinct()
        voxels = settle(training_voxels(made, on, self.grid, self.reach, self.least, self.low, self.high, cells), "voxels")
        g = self.grid.axes(F.col("lin_id"))
        centre = voxels.select(F.col("lin_id").alias("qid"), *[((a + 0.5) * self.grid.size + lo).alias(c) for a, lo, c in zip(g, self.grid.low, "xyz", strict=True)])
        near = near_pairs(centre, on, self.grid.size * self.reach / 2, chebyshev=True)
        around = near.select(F.col("qid").alias("lin_id"), "pid", *[((F.col(c) - F.col(f"q{c}")) / self.grid.size).alias(c) for c in "xyz"], "nx", "ny", "nz")
        return training_records(voxels, made, self.grid, self.reach), around
