"""Image operators over pixel rows (frame_id, v, u, depth, intensity): pyramids, stencils and projective association."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.geometry import cross, dot, normalised, sub, unproject, vec, with_smallest_eigenvector

NAN = float("nan")


def half(pixels: DataFrame) -> DataFrame:
    """The next pyramid level: intensity as the mean of 2 x 2 blocks, depth as the block's upper left pixel."""
    keys = ["frame_id", F.floor(F.col("v") / 2).alias("v"), F.floor(F.col("u") / 2).alias("u")]
    corner = F.max(F.when((F.col("v") % 2 == 0) & (F.col("u") % 2 == 0), F.col("depth")))
    return pixels.groupBy(*keys).agg(F.avg("intensity").alias("intensity"), corner.alias("depth"))


def stencil(pixels: DataFrame, reach: int, columns: list[str]) -> DataFrame:
    """Each pixel's neighbours up to ``reach`` away, itself included: (frame_id, v, u, dv, du, columns of the neighbour).

    Every pixel is repeated to the places it is a neighbour of; grouping by them needs one shuffle and no join.
    """
    steps = [F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a, b in product(range(-reach, reach + 1), repeat=2)]
    spread = pixels.select("frame_id", "v", "u", *columns, F.explode(F.array(*steps)).alias("s"))
    return spread.select("frame_id", (F.col("v") - F.col("s.dv")).alias("v"), (F.col("u") - F.col("s.du")).alias("u"), "s.dv", "s.du", *columns)


def sobel(pixels: DataFrame, value: str = "intensity") -> DataFrame:
    """(frame_id, v, u, gx, gy): the 3 x 3 gradient over 8; NaN where a neighbour is missing."""
    around = stencil(pixels, 1, [value])
    smooth = lambda c: F.when(F.col(c) == 0, 2.0).otherwise(1.0)
    gx = F.sum(F.col("du") * smooth("dv") * F.col(value)) / 8
    gy = F.sum(F.col("dv") * smooth("du") * F.col(value)) / 8
    full = F.count(value) == 9
    made = around.groupBy("frame_id", "v", "u").agg(*[F.when(full, g).otherwise(NAN).alias(n) for g, n in ((gx, "gx"), (gy, "gy"))])
    return pixels.select("frame_id", "v", "u").join(made, ["frame_id", "v", "u"])


def bilateral(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """(frame_id, v, u, depth) smoothed over 5 x 5 neighbours by distance and depth; two border pixels stay, none below 1e-6 count.

    The depth term follows the sensor's noise, 0.0012 + 0.0019 (z - 0.4)^2 + 0.0001 / sqrt(z) / 4.
    """
    centre = pixels.select("frame_id", "v", "u", F.col("depth").alias("z"))
    rows = stencil(pixels, 2, ["depth"]).join(centre, ["frame_id", "v", "u"])
    z = F.col("z")
    sharp = 1 / (0.0012 + 0.0019 * (z - 0.4) * (z - 0.4) + 0.0001 / F.sqrt(z) * 0.25)
    far = (F.abs("du") + F.abs("dv")) * (1.2232 * 1.2232)
    near = F.pow(F.col("depth") - z, 2) * sharp * sharp
    weight = F.when(F.col("depth") > 1e-6, F.exp(-0.5 * (far + near))).otherwise(0.0)
    sums = rows.groupBy("frame_id", "v", "u", "z").agg(F.sum(weight * F.col("depth")).alias("s"), F.sum(weight).alias("w"))
    inner = (F.col("v") >= 2) & (F.col("u") >= 2) & (F.col("v") < height - 2) & (F.col("u") < width - 2)
    smooth = F.when(z < 1e-6, 0.0).when(inner & (F.col("w") > 0), F.col("s") / F.col("w")).otherwise(z)
    return sums.select("frame_id", "v", "u", smooth.alias("depth"))


def _points(pixels: DataFrame, intrinsics: tuple[float, float, float, float]) -> DataFrame:
    x, y, z = unproject(F.col("u"), F.col("v"), F.col("depth"), *intrinsics)
    return pixels.select("frame_id", "v", "u", x.alias("x"), y.alias("y"), z.alias("z"))


def sensor_weight(z: Column, nz: Column) -> Column:
    """How far a depth is to be trusted: one over the sensor's deviation at that depth and tilt."""
    theta = F.acos(F.least(F.greatest(nz, F.lit(-1.0)), F.lit(1.0)))
    tilt = theta / (0.5 * 3.14159 - theta)  # fixed value: pi as the sensor model has it
    return 1 / (0.0012 + 0.0019 * (z - 0.4) * (z - 0.4) + 0.0001 / F.sqrt(z) * tilt * tilt)


def cross_normals(pixels: DataFrame, intrinsics: tuple[float, float, float, float]) -> DataFrame:
    """(frame_id, v, u, nx, ny, nz, weight) from the four neighbours' differences; NaN and weight -1 without a depth at all five, or without a direction."""
    rows = stencil(_points(pixels, intrinsics), 1, ["x", "y", "z"])
    at = lambda dv, du, c: F.max(F.when((F.col("dv") == dv) & (F.col("du") == du), F.col(c)))
    names = {(0, 1): "r", (0, -1): "l", (1, 0): "d", (-1, 0): "t", (0, 0): "c"}
    m = rows.groupBy("frame_id", "v", "u").agg(*[at(*k, c).alias(n + c) for k, n in names.items() for c in "xyz"])
    p = {n: tuple(F.col(n + c) for c in "xyz") for n in names.values()}
    m = m.withColumns({f"e{c}": x for x, c in zip(cross(sub(p["d"], p["t"]), sub(p["r"], p["l"])), "xyz", strict=True)})  # type: ignore[arg-type]
    e = vec("ex", "ey", "ez")
    known = F.lit(True)
    for n in names.values():
        known = known & F.coalesce(~F.isnan(f"{n}z") & (F.col(f"{n}z") > 1e-6), F.lit(False))
    known = known & F.coalesce(dot(e, e) >= 1e-12, F.lit(False))
    made = [F.when(known, x).otherwise(NAN) for x in normalised(e)]
    m = m.where("cx IS NOT NULL").select("frame_id", "v", "u", "cz", *[x.alias(f"n{c}") for x, c in zip(made, "xyz", strict=True)], known.alias("_known"))
    return m.select("frame_id", "v", "u", "nx", "ny", "nz", F.when(F.col("_known"), sensor_weight(F.col("cz"), F.col("nz"))).otherwise(-1.0).alias("weight"))


def pca_normals(pixels: DataFrame, intrinsics: tuple[float, float, float, float], near2: float = 0.01, least: int = 9) -> DataFrame:
    """(frame_id, v, u, n, nx, ny, nz, weight): the direction of least spread in a 7 x 7 window, of points nearer than sqrt(``near2``).

    NaN and weight -1 with fewer than ``least`` such points, or without a direction. Pixels without a depth have no row.
    """
    points = _points(pixels, intrinsics)
    centre = points.withColumnsRenamed({c: f"c{c}" for c in "xyz"})
    rows = stencil(points, 3, ["x", "y", "z"]).join(centre, ["frame_id", "v", "u"])
    d = {c: F.col(c) - F.col(f"c{c}") for c in "xyz"}
    rows = rows.where((d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"] < near2) & (F.col("z") > 1e-6) & (F.col("cz") > 1e-6))
    two = ("xx", "xy", "xz", "yy", "yz", "zz")
    m = rows.groupBy("frame_id", "v", "u", "cx", "cy", "cz").agg(F.count("*").alias("n"), *[F.sum(d[c]).alias(f"s{c}") for c in "xyz"], *[F.sum(d[a] * d[b]).alias(f"s{a}{b}") for a, b in two])
    cov = [F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n") for a, b in two]
    m = with_smallest_eigenvector(m, cov, ["ex", "ey", "ez"])
    n = vec("ex", "ey", "ez")
    flip = F.when(dot(n, (F.col("cx"), F.col("cy"), F.col("cz"))) > 0, -1.0).otherwise(1.0)
    m = m.select("frame_id", "v", "u", "n", "cz", *[F.when(F.col("n") >= least, flip * x).otherwise(NAN).alias(f"n{c}") for x, c in zip(n, "xyz", strict=True)])
    weight = F.when(F.isnan("nz"), -1.0).otherwise(sensor_weight(F.col("cz"), F.col("nz")))
    return m.select("frame_id", "v", "u", "n", "nx", "ny", "nz", weight.alias("weight"))


def project(x: Column, y: Column, z: Column, intrinsics: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """The pixel of a point, rounded half to even."""
    fx, fy, cx, cy = intrinsics
    return F.rint(x / z * fx + cx).cast("long"), F.rint(y / z * fy + cy).cast("long")


def photometric_residuals(
    current: DataFrame,
    previous: DataFrame,
    intrinsics: tuple[float, float, float, float],
    rotation: list[list[float]],
    translation: list[float],
    least_gradient2: float = 0.0,
    most_delta: float = 0.07,
) -> DataFrame:
    """Pixels of the current frame with the previous frame's pixel that they fall on, the residual, and the Jacobian of the six motions.

    A pixel counts if its gradient is strong enough, its depth is known, it falls
    into the previous frame, and the depths there agree; the match is an equi-join on the projected pixel.
    """
    fx, fy, *_ = intrinsics
    g = sobel(current)
    rows = current.join(g, ["frame_id", "v", "u"]).where(~F.isnan("gx") & (F.col("gx") ** 2 + F.col("gy") ** 2 >= least_gradient2) & ~F.isnan("depth"))
    p = unproject(F.col("u"), F.col("v"), F.col("depth"), *intrinsics)
    q = [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] + t for r, t in zip(rotation, translation, strict=True)]
    rows = rows.select("v", "u", "intensity", "gx", "gy", *[x.alias(f"p{c}") for x, c in zip(p, "xyz", strict=True)], *[x.alias(f"q{c}") for x, c in zip(q, "xyz", strict=True)]).where("qz > 0")
    u0, v0 = project(F.col("qx"), F.col("qy"), F.col("qz"), intrinsics)
    before = previous.select(F.col("v").cast("long").alias("v0"), F.col("u").cast("long").alias("u0"), F.col("intensity").alias("i0"), F.col("depth").alias("d0"))
    met = rows.withColumns({"u0": u0, "v0": v0}).join(before, ["v0", "u0"]).where((F.col("d0") > 0) & (F.abs(F.col("qz") - F.col("d0")) <= most_delta))
    px_, py_, pz_ = F.col("px"), F.col("py"), F.col("pz")
    jx, jy = F.col("gx") * fx / pz_, F.col("gy") * fy / pz_
    jz = -(jx * px_ + jy * py_) / pz_
    turn = cross((px_, py_, pz_), (jx, jy, jz))
    jacobian = [jx, jy, jz, *turn]
    return met.select("v", "u", "v0", "u0", (F.col("intensity") - F.col("i0")).alias("f"), *[j.alias(f"j{k}") for k, j in enumerate(jacobian)])


def normal_equations(residuals: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: the upper half of H = sum w J J', g = sum w J f, E = sum w f^2, all over the number of rows ``m``; zeros without rows."""
    w = F.lit(1.0) if weight is None else weight
    one = lambda e: F.coalesce(F.sum(w * e) / F.count("*"), F.lit(0.0))
    j = [F.col(f"j{k}") for k in range(6)]
    h = [one(j[a] * j[b]).alias(f"h{a}{b}") for a in range(6) for b in range(a, 6)]
    return residuals.agg(F.count("*").alias("m"), *h, *[one(x * F.col("f")).alias(f"g{k}") for k, x in enumerate(j)], one(F.col("f") * F.col("f")).alias("e"))
