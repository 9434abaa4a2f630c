"""Queries of surfaces: rasterised faces and their tallies, indexed and coloured meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox.operators import raster
from stratavox.plans import views
from stratavox.plans.mapping import TURN
from stratavox.plans.registered import query
from stratavox.sources import sinks

CAMERA = raster.Camera(0.5, -0.35, 0.4, 32, 24)
#: Three views, rows first: along z, turned, and along x with the camera's y against the z axis.
VIEWS = [
    [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0],
    [*TURN[0], 0.05, *TURN[1], -0.02, *TURN[2], 0.1, 0.0, 0.0, 0.0, 1.0],
    [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, -1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0],
]

_CORNERS = {"a": ("ax", "ay", "az"), "b": ("bx", "by_", "bz"), "c": ("cx", "cy", "cz")}


def _raster_sql() -> str:
    """DuckDB text of the nearest fragments ``px0``: each triangle of each view against each pixel of the image."""
    given = ", ".join(f"({k}, {', '.join(f'{x}e0' for x in m)})" for k, m in enumerate(VIEWS))
    names = ", ".join(f"m{k}" for k in range(16))
    at = lambda p, r: f"(m{4 * r}*{p[0]}+m{4 * r + 1}*{p[1]}+m{4 * r + 2}*{p[2]}+m{4 * r + 3})"
    screen = ", ".join(
        f"({at(p, 0)}/{CAMERA.half}e0+1e0)/2e0*{CAMERA.width}e0 AS {c}u, (1e0-{at(p, 1)}/{CAMERA.half}e0)/2e0*{CAMERA.height}e0 AS {c}v, -{at(p, 2)} AS {c}d" for c, p in _CORNERS.items()
    )
    edge = lambda p, q: f"(({p}u-x0)*({q}v-y0)-({p}v-y0)*({q}u-x0))"
    mixed = lambda of: f"(wa*{of[0]}+wb*{of[1]}+wc*{of[2]})/(wa+wb+wc)"
    places = ", ".join(f"{mixed([p[k] for p in _CORNERS.values()])} AS {n}" for k, n in enumerate("xyz"))
    p1, p2 = ("(bx-ax)", "(by_-ay)", "(bz-az)"), ("(cx-ax)", "(cy-ay)", "(cz-az)")
    turned = ", ".join(f"{p1[a]}*{p2[b]}-{p1[b]}*{p2[a]} AS q{n}" for n, a, b in (("x", 1, 2), ("y", 2, 0), ("z", 0, 1)))
    return f""", views AS (SELECT * FROM (VALUES {given}) t(view, {names})), t1 AS (SELECT view, tri_id AS face, tri.* EXCLUDE tri_id, {screen}, {turned}, m8, m9, m10 FROM tri, views),
t2 AS (SELECT *, (bu-au)*(cv-av)-(bv-av)*(cu-au) AS area, sqrt(qx*qx+qy*qy+qz*qz) AS far, (m8*qx+m9*qy+m10*qz)/sqrt(qx*qx+qy*qy+qz*qz) AS facing FROM t1),
t3 AS (SELECT *, {edge('b', 'c')} AS wa, {edge('c', 'a')} AS wb, {edge('a', 'b')} AS wc FROM (SELECT *, u+5e-1 AS x0, v+5e-1 AS y0 FROM t2, range({CAMERA.width}) p(u), range({CAMERA.height}) q(v) WHERE area <> 0)),
t4 AS (SELECT view, u, v, face, {mixed(['ad', 'bd', 'cd'])} AS depth, {places}, {', '.join(f'CASE WHEN facing < 0 THEN -q{n} ELSE q{n} END/far AS n{n}' for n in 'xyz')}, abs(facing) >= 1e-3 AS valid
 FROM t3 WHERE sign(area)*wa >= 0 AND sign(area)*wb >= 0 AND sign(area)*wc >= 0 AND wa+wb+wc <> 0),
px0 AS (SELECT * EXCLUDE place FROM (SELECT *, row_number() OVER (PARTITION BY view, u, v ORDER BY depth, face) AS place FROM t4 WHERE depth BETWEEN {CAMERA.near}e0 AND {CAMERA.far}e0) WHERE place = 1)"""


_RASTER = _raster_sql()
_NUMBERS = ["depth", "x", "y", "z", "nx", "ny", "nz"]


def _seen(spark, sf_dir):
    given = spark.createDataFrame(list(enumerate(VIEWS)), "view long, matrix array<double>")
    return views.tri(spark, sf_dir), given


@query(f"{_RASTER} SELECT CAST(view AS BIGINT) AS view, u, v, face, {', '.join(f'round({n},5)+0e0 AS {n}' for n in _NUMBERS)}, valid FROM px0", "epts", "tri")
def rasterised_pixels(spark, sf_dir):
    """What three views see of all triangles: for each pixel the nearest face, the place on it and its normal."""
    found = raster.rasterised(*_seen(spark, sf_dir), CAMERA)
    return found.select("view", "u", "v", "face", *[(F.round(n, 5) + 0.0).alias(n) for n in _NUMBERS], "valid")


_SIDE = "CASE WHEN abs(nx) >= 1e-6 THEN sign(nx) WHEN abs(ny) >= 1e-6 THEN sign(ny) WHEN nz > 0 THEN 1 ELSE -1 END"


@query(f"{_RASTER} SELECT face, count(*) AS n, CAST(sum({_SIDE}) AS BIGINT) AS sign FROM px0 WHERE valid GROUP BY face", "epts", "tri")
def seen_face_tallies(spark, sf_dir):
    """How often each face is seen in three views, and from which side."""
    return raster.face_tallies(raster.seen_points(*_seen(spark, sf_dir), CAMERA))


#: Triangles whose corners are moved onto eighths, so that many share a place; the deviation is a sum that is exact there.
_AT = {c: {n: f"floor({p}*8e0)/8e0" for n, p in zip("xyz", names, strict=True)} for c, names in _CORNERS.items()}
_STD = "abs({x})+2e0*abs({y})+4e0*abs({z})"
_CELL = "(CAST(floor({x}*4e0) AS BIGINT)+4)*64+(CAST(floor({y}*4e0) AS BIGINT)+4)*8+CAST(floor({z}*4e0) AS BIGINT)+4"
_SOUP = (
    ", k0 AS ("
    + " UNION ALL ".join(f"SELECT tri_id AS tri, {k} AS corner, {', '.join(f'{p}+0e0 AS {n}' for n, p in at.items())} FROM tri" for k, at in enumerate(_AT.values()))
    + f"), k1 AS (SELECT x, y, z, avg({_STD.format(x='x', y='y', z='z')}) AS std, row_number() OVER (ORDER BY {_CELL.format(x='x', y='y', z='z')}, x, y, z)-1 AS vid FROM k0 GROUP BY x, y, z)"
)
_JET = {
    "r": "CASE WHEN t <= 35e-2 THEN 0 WHEN t <= 66e-2 THEN (t-35e-2)/31e-2 WHEN t <= 89e-2 THEN 1 ELSE 1-(t-89e-2)/11e-2/2 END",
    "g": "CASE WHEN t <= 125e-3 THEN 0 WHEN t <= 375e-3 THEN (t-125e-3)/25e-2 WHEN t <= 64e-2 THEN 1 WHEN t <= 91e-2 THEN 1-(t-64e-2)/27e-2 ELSE 0 END",
    "b": "CASE WHEN t <= 11e-2 THEN 5e-1+t/11e-2/2 WHEN t <= 34e-2 THEN 1 WHEN t <= 65e-2 THEN 1-(t-34e-2)/31e-2 ELSE 0 END",
}


def _indexed(spark, sf_dir):
    corner = lambda at: f"struct({at['x']} AS x, {at['y']} AS y, {at['z']} AS z, {_STD.format(**at)} AS std)"
    soup = views.tri(spark, sf_dir).select(F.col("tri_id").alias("tri"), F.expr(f"array({', '.join(corner(at) for at in _AT.values())})").alias("v"))
    return sinks.indexed_mesh(soup, F.expr(_CELL.format(x="x", y="y", z="z")))


@query(
    f"""{_SOUP}, k2 AS (SELECT *, least(floor((std-min(std) OVER ())/(max(std) OVER ()-min(std) OVER ())*256), 255)/255e0 AS t FROM k1)
SELECT vid, x+0e0 AS x, y+0e0 AS y, z+0e0 AS z, std, {', '.join(f'round({e},6)+0e0 AS {n}' for n, e in _JET.items())} FROM k2""",
    "epts",
    "tri",
)
def indexed_vertices(spark, sf_dir):
    """The vertices of an indexed mesh: dense ids, deviations and their colours."""
    vertices, _ = _indexed(spark, sf_dir)
    return vertices.select("vid", *[(F.col(c) + 0.0).alias(c) for c in "xyz"], "std", *[(F.round(c, 6) + 0.0).alias(c) for c in "rgb"])


@query(f"{_SOUP} SELECT tri, {', '.join(f'max(CASE WHEN corner={k} THEN vid END) AS {n}' for k, n in enumerate('abc'))} FROM k0 JOIN k1 USING (x, y, z) GROUP BY tri", "epts", "tri")
def indexed_faces(spark, sf_dir):
    """The faces of an indexed mesh, as ids of their vertices."""
    return _indexed(spark, sf_dir)[1]
