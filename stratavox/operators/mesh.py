"""Surface extraction: lattices, overlap blending and marching cubes, as joins and grouped aggregates."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions.geometry import lerp_zero

#: Corners of a cube, and its edges as pairs of corners that differ along one axis.
CORNERS = list(product((0, 1), repeat=3))
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if sum(x != y for x, y in zip(CORNERS[a], CORNERS[b], strict=True)) == 1]


def _faces() -> list[list[int]]:
    """The corners of the six faces, each around the face as seen from outside, counter-clockwise."""
    faces = []
    for axis, side in product(range(3), (0, 1)):
        u, v = [k for k in range(3) if k != axis]
        ring = []
        for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
            corner = [0, 0, 0]
            corner[axis], corner[u], corner[v] = side, a, b
            ring.append(CORNERS.index(tuple(corner)))
        outward = (axis != 1) == bool(side)  # u x v points along +axis but for the y axis
        faces.append(ring if outward else ring[::-1])
    return faces


@lru_cache(maxsize=1)
def triangle_table() -> list[list[tuple[int, int, int]]]:
    """For each of the 256 sign cases its triangles, as edge numbers.

    On each face the surface runs from the edge where one walks out of the
    negative corners to the edge where that stretch of negative corners began, so
    that negative corners across a face stay apart, on both sides of the face
    alike. The runs close to loops around the cube; each loop is a fan of triangles.
    """
    number = {e: k for k, e in enumerate(EDGES)}
    table = []
    for case in range(256):
        negative = [bool(case >> k & 1) for k in range(8)]
        follow: dict[int, int] = {}
        for ring in _faces():
            for k in range(4):
                a, b = ring[k], ring[(k + 1) % 4]
                if negative[a] and not negative[b]:
                    back = k
                    while negative[ring[back]]:
                        back = (back - 1) % 4
                    enter = (ring[back], ring[(back + 1) % 4])
                    follow[number[tuple(sorted((a, b)))]] = number[tuple(sorted(enter))]
        triangles = []
        while follow:
            first, at = follow.popitem()
            loop = [first]
            while at != first:
                loop.append(at)
                at = follow.pop(at)
            triangles += [(loop[0], loop[k], loop[k + 1]) for k in range(1, len(loop) - 1)]
        table.append(triangles)
    return table


def lattice(spark: SparkSession, r: int, low: float = 0.0, high: float | None = None) -> DataFrame:
    """r^3 regular samples on [low, high] (high 1 - 1/r unless given), x-major: (id, i, j, k, x, y, z)."""
    high = 1 - 1 / r if high is None else high
    step = (high - low) / (r - 1) if r > 1 else 0.0
    rows = spark.range(r**3)
    axes = [F.floor(F.col("id") / (r * r)), F.floor(F.col("id") / r) % r, F.col("id") % r]
    return rows.select("id", *[a.cast("long").alias(n) for a, n in zip(axes, "ijk", strict=True)], *[(a * step + low).alias(c) for a, c in zip(axes, "xyz", strict=True)])


def blend(corners: DataFrame, weight: str = "std") -> DataFrame:
    """One value for each lattice corner (i, j, k) from the overlapping voxels' values (``w``: trilinear weight, ``sdf``, ``std``).

    A larger deviation weighs more (``std``), or less (``inv_var``). A corner without its ``home`` voxel is left out.
    """
    by = F.col("w") * (F.col("std") if weight == "std" else 1 / (F.col("std") * F.col("std")))
    made = corners.groupBy("i", "j", "k").agg((F.sum(by * F.col("sdf")) / F.sum(by)).alias("sdf"), (F.sum(F.col("w") * F.col("std")) / F.sum("w")).alias("std"), F.max("home").alias("home"))
    return made.where("home").drop("home")


def march(field: DataFrame, size: float, low: tuple[float, float, float] = (0.0, 0.0, 0.0), most_std: float | None = None, interpolate: bool = True) -> DataFrame:
    """Triangles of the zero surface of a field (i, j, k, sdf[, std]): (i, j, k, tri_no, v), v an array of three (x, y, z, std).

    Every corner is repeated to the cubes that it belongs to and grouped by cube:
    one shuffle, no join. Cubes with a missing or NaN corner give nothing; a
    triangle with a vertex whose deviation is over ``most_std`` goes. The 256
    cases are a constant table.
    """
    spark = field.sparkSession
    if "std" not in field.columns:
        field = field.withColumn("std", F.lit(0.0))
    shifts = F.array(*[F.struct(F.lit(k).alias("corner"), *[F.lit(o).alias(n) for o, n in zip(c, ("di", "dj", "dk"), strict=True)]) for k, c in enumerate(CORNERS)])
    spread = field.where(~F.isnan("sdf") & F.col("sdf").isNotNull()).select("i", "j", "k", "sdf", "std", F.explode(shifts).alias("s"))
    spread = spread.select(*[(F.col(n) - F.col(f"s.d{n}")).alias(n) for n in "ijk"], "s.corner", "sdf", "std")
    at = lambda k, c: F.max(F.when(F.col("corner") == k, F.col(c)))
    cubes = spread.groupBy("i", "j", "k").agg(F.count("*").alias("n"), *[at(k, c).alias(f"{c}{k}") for k in range(8) for c in ("sdf", "std")]).where("n = 8")
    case = sum((F.when(F.col(f"sdf{k}") < 0, 1 << k).otherwise(0) for k in range(8)), F.lit(0))
    cubes = cubes.withColumn("case", case).where((F.col("case") > 0) & (F.col("case") < 255))
    rows = [(c, n, list(t)) for c, found in enumerate(triangle_table()) for n, t in enumerate(found)]
    table = spark.createDataFrame(rows, "case int, tri_no int, edges array<int>")
    met = cubes.join(F.broadcast(table), "case")  # at most five triangles a case
    ijk = [F.col(n) for n in "ijk"]

    def vertex(a: int, b: int) -> Column:
        va, vb = F.col(f"sdf{a}"), F.col(f"sdf{b}")
        place = []
        for axis, name in enumerate("xyz"):
            pa, pb = ((ijk[axis] + CORNERS[c][axis]) * size + low[axis] for c in (a, b))
            place.append((lerp_zero(pa, pb, va, vb) if interpolate else (pa + pb) / 2).alias(name))
        return F.struct(*place, lerp_zero(F.col(f"std{a}"), F.col(f"std{b}"), va, vb).alias("std"))

    points = F.array(*[vertex(a, b) for a, b in EDGES])
    made = met.withColumn("p", points).select("i", "j", "k", "tri_no", F.expr("transform(edges, e -> p[e])").alias("v"))
    return made if most_std is None else made.where(F.array_max(F.transform("v", lambda x: x["std"])) <= most_std)


def bounding_box(vertices: DataFrame, faces: DataFrame, vid: str = "vid", buffer: float = 0.0) -> DataFrame:
    """One row (min_x, max_x, ..): the box of the vertices that a face (rows of ``vid``) uses, wider by ``buffer`` along each axis about its centre."""
    ends = vertices.join(faces.select(vid), vid, "left_semi").agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))])
    centre = {c: (F.col(f"lo{c}") + F.col(f"hi{c}")) / 2 for c in "xyz"}
    half = {c: (F.col(f"hi{c}") - F.col(f"lo{c}") + buffer) / 2 for c in "xyz"}
    return ends.select(*[x.alias(f"{n}_{c}") for c in "xyz" for n, x in (("min", centre[c] - half[c]), ("max", centre[c] + half[c]))])


def limited(triangles: DataFrame, order: str, most: int) -> DataFrame:
    """The first ``most`` rows by ``order``, with a column ``overflow`` that tells whether there were more. At most one row beyond is looked at."""
    top = triangles.orderBy(order).limit(most + 1)
    more = top.agg((F.count("*") > most).alias("overflow"))
    return top.orderBy(order).limit(most).crossJoin(F.broadcast(more))
