"""The voxel map as decoded lattices: overlapping samples of each voxel, their stitching, meshes of changed voxels, and the map's keyed state."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.geometry import cross, vec
from stratavox.operators import mesh, reduce
from stratavox.operators.grid import Grid, dilate
from stratavox.sources.shared import settle

#: Adds ``sdf`` and ``std`` to rows with a voxel's columns and a place (x, y, z) relative to its centre, in cells.
Decode = Callable[[DataFrame], DataFrame]


def lattice_of(voxels: DataFrame, n: int, low: float, step: float) -> DataFrame:
    """Every voxel row repeated to n^3 places: (.., i, j, k, x, y, z), places from ``low`` in steps, relative to the voxel's centre."""
    spread = voxels.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n**3 - 1))))
    axes = [F.floor(F.col("_m") / (n * n)), F.floor(F.col("_m") / n) % n, F.col("_m") % n]
    spread = spread.withColumns({a: x.cast("long") for a, x in zip("ijk", axes, strict=True)}).drop("_m")
    return spread.withColumns({c: F.col(a) * step + (low - 0.5) for a, c in zip("ijk", "xyz", strict=True)})


def bounds(r: int) -> tuple[float, float]:
    """The first and last place of a voxel's overlapping lattice, in cells from its low corner: neighbours share half of theirs."""
    return -(r // 2) / r, 1 + ((r - 1) // 2) / r


def decode_lattice(voxels: DataFrame, r: int, decode: Decode, gate: float | None = None) -> DataFrame:
    """(lin_id, i, j, k, sdf, std) of the (2r)^3 lattice of every voxel.

    With ``gate``, r^3 samples are decoded, interpolated to twice as many along
    each axis (ends on ends), and decoded again only where the interpolated
    distance is below it. A voxel's coarse samples meet in one array, of r^3
    entries whatever the input; nothing is joined.
    """
    low, high = bounds(r)
    out = ["lin_id", "i", "j", "k", "sdf", "std"]
    if gate is None:
        return decode(lattice_of(voxels, 2 * r, low, 1 / r)).select(*out)
    names = voxels.columns
    coarse = decode(lattice_of(voxels, r, low, (high - low) / (r - 1)))
    at = F.col("i") * (r * r) + F.col("j") * r + F.col("k")
    held = F.array_sort(F.collect_list(F.struct(at.alias("at"), "sdf", "std"))).alias("_coarse")
    first = [F.first(c).alias(c) for c in names if c != "lin_id"]
    fine = lattice_of(coarse.groupBy("lin_id").agg(*first, held), 2 * r, low, 1 / r)
    place = {a: F.col(a) * ((r - 1) / (2 * r - 1)) for a in "ijk"}
    base = {a: F.least(F.floor(place[a]), F.lit(r - 2)) for a in "ijk"}
    fine = fine.withColumns({f"_{a}": base[a].cast("int") for a in "ijk"} | {f"_w{a}": place[a] - base[a] for a in "ijk"})
    total: dict[str, Column] = {"sdf": F.lit(0.0), "std": F.lit(0.0)}
    for o in product((0, 1), repeat=3):
        w = F.lit(1.0)
        for side, a in zip(o, "ijk", strict=True):
            w = w * (F.col(f"_w{a}") if side else 1 - F.col(f"_w{a}"))
        value = F.get("_coarse", (F.col("_i") + o[0]) * (r * r) + (F.col("_j") + o[1]) * r + F.col("_k") + o[2])
        total = {c: t + w * value[c] for c, t in total.items()}
    fine = settle(fine.withColumns(total).select(*names, "i", "j", "k", "x", "y", "z", "sdf", "std"), "lattice")
    near = F.coalesce(F.abs("sdf") < gate, F.lit(False))
    again = decode(fine.where(near).drop("sdf", "std")).select(*out)
    return fine.where(~near).select(*out).unionByName(again)


def stitch(lattices: DataFrame, grid: Grid, r: int, weight: str = "std") -> DataFrame:
    """One (i, j, k, sdf, std) for each corner of the fine grid, from the lattices of up to eight voxels around it.

    A sample's weight falls from 1 at its voxel's centre to 0 a cell away along
    each axis. Every sample names its corner itself, so voxels meet by one
    grouped sum, not by a join. Corners whose own voxel has no lattice are left
    out; the grid's upper faces repeat the last corner before them.
    """
    rows = lattices.where(F.col("sdf").isNotNull() & ~F.isnan("sdf"))
    cell = dict(zip("ijk", grid.axes(F.col("lin_id")), strict=True))
    rows = rows.withColumns({f"_c{a}": cell[a].cast("long") for a in "ijk"})
    rows = rows.withColumns({a: F.col(f"_c{a}") * r + F.col(a) - r // 2 for a in "ijk"})
    w, home = F.lit(1.0), F.lit(True)
    for a in "ijk":
        w = w * (1 - F.abs(F.col(a) / r - F.col(f"_c{a}") - 0.5))
        home = home & (F.floor(F.col(a) / r) == F.col(f"_c{a}"))
    made = mesh.blend(rows.select("i", "j", "k", w.alias("w"), "sdf", "std", home.alias("home")), weight)
    for a, n in zip("ijk", grid.shape, strict=True):
        last = n * r - 1
        ends = F.when(F.col(a) == last, F.array(F.lit(last).cast("long"), F.lit(last + 1).cast("long"))).otherwise(F.array(F.col(a)))
        made = made.withColumn(a, F.explode(ends))
    return made


def decode_set(voxels: DataFrame, dirty: DataFrame, grid: Grid, more_than: float, corners: bool = False) -> DataFrame:
    """Voxels to decode for new meshes of the ``dirty`` ones: they and their face neighbours (``corners``: all 26), of those seen more than so often."""
    return voxels.where(F.col("obs_count") > more_than).join(dilate(dirty, grid, corners), "lin_id", "left_semi")


def dirty_mesh(voxels: DataFrame, dirty: DataFrame, grid: Grid, r: int, decode: Decode, more_than: float = 0, gate: float | None = None, most_std: float | None = None, corners: bool = False) -> DataFrame:
    """Triangles (lin_id, i, j, k, tri_no, v) of the cubes in dirty voxels only: what :func:`reduce.replace_by_key` puts into the cache.

    With face neighbours alone, corners on a voxel's edges miss the lattices of the
    diagonal ones; with ``corners`` they are those of a mesh of all voxels.
    """
    field = stitch(decode_lattice(decode_set(voxels, dirty, grid, more_than, corners), r, decode, gate), grid, r)
    made = mesh.march(field, grid.size / r, grid.low, most_std)
    home = grid.linear(*[F.floor(F.col(a) / r).cast("long") for a in "ijk"])
    return made.withColumn("lin_id", home).join(dirty.select("lin_id").distinct(), "lin_id", "left_semi")


def admit(state: DataFrame, touched: DataFrame, grid: Grid, dims: int) -> DataFrame:
    """The state and, for touched cells that it lacks, these and their face neighbours with a zero latent, no count, not optimised.

    State rows are (lin_id, latent, obs_count, optimized). Cells that are there stay as they are.
    """
    absent = touched.select("lin_id").distinct().join(state.select("lin_id"), "lin_id", "left_anti")
    fresh = dilate(absent, grid).join(state.select("lin_id"), "lin_id", "left_anti")
    zero = F.array_repeat(F.lit(0.0), dims)
    return state.unionByName(fresh.select("lin_id", zero.alias("latent"), F.lit(0.0).alias("obs_count"), F.lit(False).alias("optimized")))


def integrate(state: DataFrame, delta: DataFrame, freeze_at: float) -> DataFrame:
    """Merge sums (lin_id, total, n) into the state's latents by running means; the flag ``optimized`` stays."""
    merged = reduce.running_mean_merge(state.drop("optimized"), delta, "lin_id", freeze_at)
    return merged.join(state.select("lin_id", "optimized"), "lin_id", "left").withColumn("optimized", F.coalesce("optimized", F.lit(False)))


def due(state: DataFrame, count: float) -> DataFrame:
    """State rows whose latent is to be optimised: seen often enough, not yet optimised, and (as in the original rule) not cell 0."""
    return state.where((F.col("obs_count") >= count) & ~F.col("optimized") & (F.col("lin_id") > 0))


def sdf_residuals(points: DataFrame, rotation: list[list[float]]) -> DataFrame:
    """Residuals (f, j0 .. j5) of the distance term from rows (px, py, pz, sdf, std, gx, gy, gz).

    f = sdf / std with std held constant; g is the gradient of sdf at the moved
    point and p the point in the previous camera's frame. The gradient is turned
    by the previous pose's ``rotation`` as the original does: J = (R g / std, p x R g / std).
    """
    g = vec("gx", "gy", "gz")
    turned = tuple(sum((x * v for x, v in zip(g, row, strict=True)), F.lit(0.0)) / F.col("std") for row in rotation)
    jacobian = [*turned, *cross(vec("px", "py", "pz"), turned)]  # type: ignore[arg-type]
    return points.select((F.col("sdf") / F.col("std")).alias("f"), *[j.alias(f"j{k}") for k, j in enumerate(jacobian)])
