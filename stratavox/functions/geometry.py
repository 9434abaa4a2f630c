"""Row-wise expressions: points, cells, triangles, weights, losses and schedules, all as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Vec) -> Vec:
    """``a`` at length 1; NaN where it has none."""
    n = length(a)
    inverse = F.when(n > 0, 1 / n).otherwise(F.lit(float("nan")))
    return tuple(x * inverse for x in a)  # type: ignore[return-value]


def unproject(u: Column, v: Column, depth: Column, fx: float, fy: float, cx: float, cy: float) -> Vec:
    """A pixel's point in camera space; NaN depth gives NaN."""
    return (u - cx) / fx * depth, (v - cy) / fy * depth, depth


def transform(p: Vec, rotation: list[list[float]], translation: list[float] | None = None) -> Vec:
    """Rotate, and move if a translation is given (directions take none)."""
    moved = [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] for r in rotation]
    return tuple(m + t for m, t in zip(moved, translation or [0.0] * 3, strict=True))  # type: ignore[return-value]


def depth_in_range(depth: Column, low: float, high: float) -> Column:
    """``depth`` within the inclusive range, else NaN."""
    return F.when((depth >= low) & (depth <= high), depth).otherwise(F.lit(float("nan")))


def map_cell(c: Column, low: float, size: float) -> Column:
    """Cells (lo, hi] of the voxel map. NaN must be filtered before."""
    return (F.ceil((c - low) / size) - 1).cast("long")


def box_cell(c: Column, low: Column, size: float) -> Column:
    """Cells [lo, hi) of the down-sampling filter, whose first one is centred at the minimum."""
    return F.floor((c - (low - size / 2)) / size).cast("long")


def relative(c: Column, cell: Column, low: float, size: float) -> Column:
    """Place within a cell, in (-0.5, 0.5]."""
    return (c - low) / size - cell - 0.5


def huber_weight(x: Column, k: float) -> Column:
    return F.when(F.abs(x) > k, k / F.abs(x)).otherwise(1.0)


def tukey_weight(x: Column, k: float) -> Column:
    return F.when(F.abs(x) <= k, F.pow(1 - F.pow(x / k, 2), 2)).otherwise(0.0)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    """Half the product of two sides and the sine between them, its cosine kept off the extremes; 0 for a degenerate one."""
    ab, ac = sub(b, a), sub(c, a)
    lengths = length(ab) * length(ac)
    cosine = dot(ab, ac) / F.when(lengths > 0, lengths)
    cosine = F.when(cosine < -1, math.cos(359 / 360 * math.pi)).when(cosine > 1, math.cos(math.pi / 360)).otherwise(cosine)
    area = 0.5 * lengths * F.sqrt(F.greatest(1 - cosine * cosine, F.lit(0.0)))
    return F.coalesce(F.nanvl(area, F.lit(0.0)), F.lit(0.0))


def barycentric(a: Vec, b: Vec, c: Vec, r1: Column, r2: Column) -> Vec:
    """The point of a triangle that two uniform numbers pick."""
    wa = 1 - F.sqrt(r1)
    wb = (1 - wa) * (1 - r2)
    wc = r2 * (1 - wa)
    return tuple(wa * x + wb * y + wc * z for x, y, z in zip(a, b, c, strict=True))  # type: ignore[return-value]


def clamp(x: Column, most: float) -> Column:
    return F.least(F.greatest(x, F.lit(-most)), F.lit(most))


def normal_log_prob(mean: Column, deviation: Column, value: Column) -> Column:
    return -F.pow(value - mean, 2) / (2 * deviation * deviation) - F.log(deviation) - math.log(math.sqrt(2 * math.pi))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def lerp_zero(p1: Column, p2: Column, v1: Column, v2: Column) -> Column:
    """Where the value is zero between two corners; a corner itself where its value, or the difference, is below 1e-5."""
    near = 1e-5
    return F.when(F.abs(v1) < near, p1).when(F.abs(v2) < near, p2).when(F.abs(v1 - v2) < near, p1).otherwise(p1 - v1 / (v2 - v1) * (p2 - p1))


def step_rate(epoch: Column, initial: float, factor: float, interval: int) -> Column:
    return initial * F.pow(F.lit(factor), F.floor(epoch / interval).cast("double"))


def warmup_rate(epoch: Column, initial: float, final: float, length_: int) -> Column:
    return F.when(epoch > length_, F.lit(final)).otherwise(initial + (final - initial) * epoch / length_)


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the md5 of a key's text: the same in every engine and run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


def with_smallest_eigenvector(df: DataFrame, cov: list[Column], out: list[str]) -> DataFrame:
    """Add the eigenvector of symmetric 3 x 3 matrices (xx, xy, xz, yy, yz, zz) for the smallest eigenvalue, as columns ``out``.

    By the trigonometric solution, in steps of one column each, as each step is
    read many times. The eigenvector is the longest cross product of two rows of
    (matrix - eigenvalue); NaN where all are zero, as for a repeated smallest eigenvalue.
    """
    xx, xy, xz, yy, yz, zz = (F.col(f"_{n}") for n in ("xx", "xy", "xz", "yy", "yz", "zz"))
    df = df.withColumns({f"_{n}": c for n, c in zip(("xx", "xy", "xz", "yy", "yz", "zz"), cov, strict=True)})
    df = df.withColumn("_q", (xx + yy + zz) / 3)
    q, p, low = F.col("_q"), F.col("_p"), F.col("_low")
    df = df.withColumn("_p", F.sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy**2 + xz**2 + yz**2)) / 6))
    a, b, c = xx - q, yy - q, zz - q
    half = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (2 * p * p * p)
    df = df.withColumn("_half", F.when(p > 0, clamp(half, 1.0)))
    df = df.withColumn("_low", q + 2 * p * F.cos(F.acos("_half") / 3 + 2 * math.pi / 3))
    rows: list[Vec] = [(xx - low, xy, xz), (xy, yy - low, yz), (xz, yz, zz - low)]
    made = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    df = df.withColumn("_crosses", F.array(*[F.struct(dot(v, v).alias("size"), *[x.alias(n) for x, n in zip(v, "xyz", strict=True)]) for v in made]))
    df = df.withColumn("_best", F.array_max("_crosses"))
    size = F.sqrt("_best.size")
    unit = {n: F.when(size > 0, F.col(f"_best.{c}") / size).otherwise(float("nan")) for n, c in zip(out, "xyz", strict=True)}
    return df.withColumns(unit).drop("_xx", "_xy", "_xz", "_yy", "_yz", "_zz", "_q", "_p", "_half", "_low", "_crosses", "_best")


def so3_exp(x: Column, y: Column, z: Column) -> list[list[Column]]:
    """The rotation of a rotation vector, by Rodrigues' formula; first order near zero."""
    angle = F.sqrt(x * x + y * y + z * z)
    small = angle < 1e-8
    s = F.when(small, F.lit(1.0)).otherwise(F.sin(angle) / F.when(~small, angle))
    c = F.when(small, F.lit(0.5)).otherwise((1 - F.cos(angle)) / F.when(~small, angle * angle))
    return [
        [1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y],
        [c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x],
        [c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y)],
    ]


def siren_terms(sdf: Column, gradient: Vec, normal: Vec) -> dict[str, Column]:
    """Each row's four loss terms: zero on the surface, far from zero off it, gradient along the normal, gradient of length 1.

    A row is on the surface if it has a normal. A product of lengths below 1e-8 counts as 1e-8.
    """
    on = sum((F.abs(x) for x in normal), F.lit(0.0)) > 1e-6
    along = dot(gradient, normal) / F.greatest(length(gradient) * length(normal), F.lit(1e-8))
    return {
        "sdf_in": F.when(on, F.abs(sdf)).otherwise(0.0),
        "sdf_out": F.when(on, 0.0).otherwise(F.exp(-100.0 * F.abs(sdf))),
        "normal": F.when(on, 1 - along).otherwise(0.0),
        "eikonal": F.abs(length(gradient) - 1),
    }
