"""Triangles as pixels: orthographic views of a shape, the nearest face of each pixel, and the surface points that views see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.geometry import cross, normalised, sub, vec

#: Views that are sent to every task (16 numbers each); more of them are shuffled to triangles in blocks.
FEW_VIEWS = 4096
#: Parts of the triangles that a block of views meets by itself.
SALTS = 64
#: Pixels along a side of the tiles that triangles are cut into.
TILE = 16

_CORNERS = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}


@dataclass(frozen=True)
class Camera:
    """An image of ``width`` x ``height`` pixels over [-half, half] of a view's x and y; depths, negative z, are seen within [near, far].

    Column u grows with x, row v falls with y. With ``by_columns`` the views'
    matrices are stored column by column, as camera files have them.
    """

    half: float
    near: float
    far: float
    width: int = 400
    height: int = 400
    by_columns: bool = False

    def entry(self, r: int, c: int) -> Column:
        return F.element_at("matrix", (4 * c + r if self.by_columns else 4 * r + c) + 1)


def _in_views(triangles: DataFrame, views: DataFrame) -> DataFrame:
    """Every triangle with every view: views are broadcast if they are few, else both are keyed by a block of views and a part of the triangles."""
    views = views.select("view", "matrix")
    many = views.limit(FEW_VIEWS + 1).count() > FEW_VIEWS
    if not many:
        return triangles.crossJoin(F.broadcast(views))  # at most FEW_VIEWS
    blocks = -(-views.count() // FEW_VIEWS)
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = triangles.withColumn("_salt", F.pmod(F.xxhash64("face"), F.lit(SALTS)).cast("int")).withColumn("_block", parts(blocks))
    right = views.withColumn("_block", F.pmod(F.xxhash64("view"), F.lit(blocks)).cast("int")).withColumn("_salt", parts(SALTS))
    return left.join(right, ["_salt", "_block"]).drop("_salt", "_block")


def _edge(p: str, q: str, u: Column, v: Column) -> Column:
    """Twice the signed area of a pixel's centre and an edge. Turned around it is exactly the negative, so no pixel falls between two faces."""
    x, y = u + 0.5, v + 0.5
    return (F.col(f"{p}u") - x) * (F.col(f"{q}v") - y) - (F.col(f"{p}v") - y) * (F.col(f"{q}u") - x)


_EDGES = (("a", "b"), ("b", "c"), ("c", "a"))


def fragments(triangles: DataFrame, views: DataFrame, camera: Camera, face: str = "tri_id") -> DataFrame:
    """(view, u, v, face, depth, x, y, z, nx, ny, nz, valid): every pixel that a triangle covers in a view, edges included.

    Triangles are (``face``, ax, ay, az, bx, by_, bz, cx, cy, cz), views (view,
    matrix of 16 that leads to the camera). x, y, z is the place on the triangle,
    the normal looks to the camera. ``valid`` is false where the triangle is seen
    edge-on. Triangles with a null or non-finite coordinate, and those without
    an area in the image, cover nothing.

    A triangle is cut into tiles, tiles beside it are left out, and only then its
    pixels are listed.
    """
    names = [n for c in _CORNERS.values() for n in c]
    whole = sum((F.col(n) for n in names[1:]), F.col(names[0])) * 0 == 0
    rows = _in_views(triangles.select(F.col(face).alias("face"), *names).where(whole), views)
    at = lambda p, r: sum((camera.entry(r, k) * F.col(c) for k, c in enumerate(p) if k), camera.entry(r, 0) * F.col(p[0])) + camera.entry(r, 3)
    screen = {}
    for c, p in _CORNERS.items():
        screen[f"{c}u"] = (at(p, 0) / camera.half + 1) / 2 * camera.width
        screen[f"{c}v"] = (1 - at(p, 1) / camera.half) / 2 * camera.height
        screen[f"{c}d"] = -at(p, 2)
    normal = normalised(cross(sub(vec(*_CORNERS["b"]), vec(*_CORNERS["a"])), sub(vec(*_CORNERS["c"]), vec(*_CORNERS["a"]))))
    rows = rows.withColumns(screen | {f"n{c}": n for c, n in zip("xyz", normal, strict=True)})
    seen = normalised(tuple(sum((camera.entry(r, k) * F.col(f"n{c}") for k, c in enumerate("xyz") if k), camera.entry(r, 0) * F.col("nx")) for r in range(3)))
    rows = rows.withColumn("_facing", seen[2]).drop("matrix")
    area = (F.col("bu") - F.col("au")) * (F.col("cv") - F.col("av")) - (F.col("bv") - F.col("av")) * (F.col("cu") - F.col("au"))
    ends = {}
    for s, n in (("u", camera.width), ("v", camera.height)):
        corners = [F.col(f"{c}{s}") for c in "abc"]
        ends[f"_{s}0"] = F.greatest(F.ceil(F.least(*corners) - 0.5), F.lit(0)).cast("long")
        ends[f"_{s}1"] = F.least(F.floor(F.greatest(*corners) - 0.5), F.lit(n - 1)).cast("long")
    rows = rows.withColumns(ends | {"_side": F.signum(area)}).where("_side != 0 AND _u0 <= _u1 AND _v0 <= _v1")
    for s in "uv":
        rows = rows.withColumn(f"_t{s}", F.explode(F.sequence(F.floor(F.col(f"_{s}0") / TILE), F.floor(F.col(f"_{s}1") / TILE))))
        low, high = F.col(f"_t{s}") * TILE, F.col(f"_t{s}") * TILE + TILE - 1
        rows = rows.withColumns({f"_{s}0": F.greatest(f"_{s}0", low), f"_{s}1": F.least(f"_{s}1", high)})
    for p, q in _EDGES:  # a tile is beside the triangle if all its corners are beyond one edge
        most = F.greatest(*[F.col("_side") * _edge(p, q, F.col(u), F.col(v)) for u in ("_u0", "_u1") for v in ("_v0", "_v1")])
        rows = rows.where(most > -1e-9)
    rows = rows.withColumn("u", F.explode(F.sequence("_u0", "_u1"))).withColumn("v", F.explode(F.sequence("_v0", "_v1")))
    rows = rows.withColumns({f"_w{k}": _edge(p, q, F.col("u"), F.col("v")) for k, (p, q) in zip("cab", _EDGES, strict=True)})
    total = F.col("_wa") + F.col("_wb") + F.col("_wc")
    rows = rows.where("_side * _wa >= 0 AND _side * _wb >= 0 AND _side * _wc >= 0").withColumn("_total", total).where("_total != 0")
    mixed = lambda of: (F.col("_wa") * F.col(of[0]) + F.col("_wb") * F.col(of[1]) + F.col("_wc") * F.col(of[2])) / F.col("_total")
    place = [mixed([_CORNERS[c][k] for c in "abc"]).alias(n) for k, n in enumerate("xyz")]
    towards = [F.when(F.col("_facing") < 0, -F.col(n)).otherwise(F.col(n)).alias(n) for n in ("nx", "ny", "nz")]
    found = rows.select("view", "u", "v", "face", mixed(["ad", "bd", "cd"]).alias("depth"), *place, *towards, ((F.abs("_facing") >= 0.001) & ~F.isnan("_facing")).alias("valid"))
    return found.where((F.col("depth") >= camera.near) & (F.col("depth") <= camera.far))


def rasterised(triangles: DataFrame, views: DataFrame, camera: Camera, face: str = "tri_id") -> DataFrame:
    """The nearest of :func:`fragments` for each view and pixel; ties go to the smaller face. A face that is seen edge-on hides what is behind it."""
    rest = ["face", "depth", "x", "y", "z", "nx", "ny", "nz", "valid"]
    nearest = F.min_by(F.struct(*rest), F.struct("depth", "face"))
    return fragments(triangles, views, camera, face).groupBy("view", "u", "v").agg(nearest.alias("p")).select("view", "u", "v", "p.*")


def seen_points(triangles: DataFrame, views: DataFrame, camera: Camera, face: str = "tri_id") -> DataFrame:
    """(pid, face, x, y, z, nx, ny, nz): what all views see of the surface, a point a valid pixel. Views have integer ids."""
    pixel = ((F.col("view") * camera.height + F.col("v")) * camera.width + F.col("u")).cast("long")
    return rasterised(triangles, views, camera, face).where("valid").select(pixel.alias("pid"), "face", "x", "y", "z", "nx", "ny", "nz")


def side(normal: tuple[Column, Column, Column]) -> Column:
    """1 or -1 by the sign of a normal's x, or of y or z where those before it are below 1e-6."""
    sign = lambda c: F.when(c > 0, 1).otherwise(-1)
    x, y, z = normal
    return F.when(F.abs(x) >= 1e-6, sign(x)).when(F.abs(y) >= 1e-6, sign(y)).otherwise(sign(z))


def face_tallies(points: DataFrame) -> DataFrame:
    """(face, n, sign): in how many pixels each face was seen, and the sum of their sides."""
    return points.groupBy("face").agg(F.count("*").alias("n"), F.sum(side(vec("nx", "ny", "nz"))).alias("sign"))
