"""Named queries over the driver's tables, each with its DuckDB text where SQL can express it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import geometry as geo
from stratavox.functions import mlp
from stratavox.functions.pose import inverse, se3_exp, se3_log
from stratavox.operators import grid, image, mesh, reduce, sample, scan, spatial, track
from stratavox.plans import frames, mapping, networks, online, paths, stored, surfaces, views  # noqa: F401 (register their queries)
from stratavox.plans.registered import ORACLE_SQL, QUERIES, query, r6  # noqa: F401
from stratavox.sources import rgbd, sinks
from stratavox.sources.tables import read_table, workers_find_package

PTS = grid.Grid((0.0, 0.0, 0.0), 0.5, (10, 10, 10))
EPTS = grid.Grid((-1.0, -1.0, -1.0), 0.25, (8, 8, 8))
K = (20.0, 20.0, 7.5, 7.5)
TURN = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]
MOVE = [0.1, -0.2, 0.3]


_CELL = "CAST(ceil(z/5e-1)-1 AS BIGINT) + 10*CAST(ceil(y/5e-1)-1 AS BIGINT) + 100*CAST(ceil(x/5e-1)-1 AS BIGINT)"
_IN = "x>0e0 AND x<=5e0 AND y>0e0 AND y<=5e0 AND z>0e0 AND z<=5e0"
_G = f"g AS (SELECT *, {_CELL} AS lin_id FROM pts WHERE {_IN})"
_FACES = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) AS o(dx,dy,dz)"


def _dilated(cells: str, n: int = 10) -> str:
    part = lambda c, d: f"least(greatest({c}+{d},0),{n - 1})"
    gx, gy, gz = f"(lin_id//{n * n})", f"(lin_id%{n * n}//{n})", f"(lin_id%{n})"
    return f"SELECT DISTINCT CAST({part(gz, 'dz')} + {n}*{part(gy, 'dy')} + {n * n}*{part(gx, 'dx')} AS BIGINT) AS lin_id FROM ({cells}) c, {_FACES}"


@query(f", {_G} SELECT lin_id, count(*) AS n, round(avg(x),6) AS cx, round(avg(y),6) AS cy, round(avg(z),6) AS cz FROM g GROUP BY lin_id HAVING count(*) > 16", "pts")
def voxel_occupancy(spark, sf_dir):
    found = grid.occupancy(views.pts(spark, sf_dir), PTS).where("n > 16")
    return found.select("lin_id", "n", r6("cx"), r6("cy"), r6("cz"))


@query(f", {_G} SELECT x, y, z, tag, lin_id FROM g WHERE lin_id IN (SELECT lin_id FROM g GROUP BY 1 HAVING count(*) > 16)", "pts")
def voxel_prune_points(spark, sf_dir):
    return grid.prune(views.pts(spark, sf_dir), PTS, 16).select("x", "y", "z", "tag", "lin_id")


@query(
    """, m AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts)
SELECT CAST(floor((x-(lx-25e-2))/5e-1) AS BIGINT) AS bx, CAST(floor((y-(ly-25e-2))/5e-1) AS BIGINT) AS by, CAST(floor((z-(lz-25e-2))/5e-1) AS BIGINT) AS bz,
count(*) AS n, round(avg(x),6) AS mx, round(avg(y),6) AS my, round(avg(z),6) AS mz, round(avg(w),6) AS mw FROM pts, m GROUP BY 1,2,3""",
    "pts",
)
def voxel_downsample(spark, sf_dir):
    found = grid.downsample(views.pts(spark, sf_dir), 0.5, ("w",))
    return found.select("bx", "by", "bz", "n", r6("mx"), r6("my"), r6("mz"), r6("mw"))


@query(
    """, m AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM epts)
SELECT CAST(floor((x-(lx-5e-2))/1e-1) AS BIGINT) AS bx, CAST(floor((y-(ly-5e-2))/1e-1) AS BIGINT) AS by, CAST(floor((z-(lz-5e-2))/1e-1) AS BIGINT) AS bz,
count(*) AS n, round(avg(x),6)+0e0 AS mx, round(avg(y),6)+0e0 AS my, round(avg(z),6)+0e0 AS mz, round(avg(nx),6)+0e0 AS mnx FROM epts, m GROUP BY 1,2,3""",
    "epts",
)
def downsample_with_normals(spark, sf_dir):
    """Points and their normals averaged in cells of 0.1 from half a cell below the minimum."""
    found = grid.downsample(views.epts(spark, sf_dir), 0.1, ("nx",))
    return found.select("bx", "by", "bz", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mx", "my", "mz", "mnx")])


@query(f", {_G} SELECT count(*) AS voxels, round(avg(n),6) AS mean, min(n) AS least, max(n) AS most FROM (SELECT count(*) AS n FROM g GROUP BY lin_id)", "pts")
def voxel_stats(spark, sf_dir):
    n = grid.occupancy(views.pts(spark, sf_dir), PTS)
    return n.agg(F.count("*").alias("voxels"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


_FULL = "SELECT lin_id FROM g GROUP BY 1 HAVING count(*) > 64"


@query(f", {_G} {_dilated(_FULL)}", "pts")
def voxel_dilate(spark, sf_dir):
    return grid.dilate(grid.occupancy(views.pts(spark, sf_dir), PTS).where("n > 64"), PTS)


@query(f", {_G} SELECT * FROM ({_dilated(_FULL)}) EXCEPT ({_FULL})", "pts")
def voxel_new_cells(spark, sf_dir):
    full = grid.occupancy(views.pts(spark, sf_dir), PTS).where("n > 64").select("lin_id")
    return grid.dilate(full, PTS).join(full, "lin_id", "left_anti")


@query(
    f""", {_G}, v AS (SELECT lin_id, CAST(count(*) AS DOUBLE) AS obs_count FROM g WHERE tag = 'R' GROUP BY 1)
SELECT x, y, z, g.lin_id, v.obs_count, v.obs_count IS NOT NULL AS known FROM g LEFT JOIN v ON v.lin_id = g.lin_id AND v.obs_count > 16""",
    "pts",
)
def point_voxel_lookup(spark, sf_dir):
    points = views.pts(spark, sf_dir)
    voxels = PTS.cells(points.where("tag = 'R'")).groupBy("lin_id").agg(F.count("*").cast("double").alias("obs_count"))
    return grid.lookup(points, PTS, voxels, 16).select("x", "y", "z", "lin_id", "obs_count", "known")


_EG = "CAST(ceil((z+1e0)/25e-2)-1 AS BIGINT) + 8*CAST(ceil((y+1e0)/25e-2)-1 AS BIGINT) + 64*CAST(ceil((x+1e0)/25e-2)-1 AS BIGINT)"


@query(
    f""", t AS (SELECT DISTINCT {_EG} AS lin_id FROM epts WHERE label < 5),
o AS (SELECT a.v AS ox, b.v AS oy, c.v AS oz FROM (VALUES (-5e-1),(5e-1)) a(v), (VALUES (-5e-1),(5e-1)) b(v), (VALUES (-5e-1),(5e-1)) c(v)),
s AS (SELECT x, y, z, least(greatest(CAST(ceil((x+1e0)/25e-2+ox)-1 AS BIGINT),0),7) AS gx, least(greatest(CAST(ceil((y+1e0)/25e-2+oy)-1 AS BIGINT),0),7) AS gy,
  least(greatest(CAST(ceil((z+1e0)/25e-2+oz)-1 AS BIGINT),0),7) AS gz FROM epts, o)
SELECT gz+8*gy+64*gx AS lin_id, count(*) AS n, round(sum((x+1e0)/25e-2-gx-5e-1),6)+0e0 AS sx, round(sum((y+1e0)/25e-2-gy-5e-1),6)+0e0 AS sy, round(sum((z+1e0)/25e-2-gz-5e-1),6)+0e0 AS sz
FROM s WHERE gz+8*gy+64*gx IN (SELECT lin_id FROM t) GROUP BY 1""",
    "epts",
)
def scatter8_sum(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    targets = EPTS.cells(points.where("label < 5")).select("lin_id").distinct()
    found = grid.scatter8(points, EPTS, targets).groupBy("lin_id")
    return found.agg(F.count("*").alias("n"), *[(F.round(F.sum(f"r{c}"), 6) + 0.0).alias(f"s{c}") for c in "xyz"])


@query(f", {_G} SELECT x, y, z, lin_id FROM g WHERE lin_id IN ({_dilated('SELECT lin_id FROM g GROUP BY 1 HAVING count(*) > 75')})", "pts")
def semi_prune(spark, sf_dir):
    points = views.pts(spark, sf_dir)
    active = grid.dilate(grid.occupancy(points, PTS).where("n > 75"), PTS)
    return PTS.cells(points).join(active, "lin_id", "left_semi").select("x", "y", "z", "lin_id")


def _vectors(op: str):
    def run(spark, sf_dir):
        found = reduce.group_vectors(read_table(spark, sf_dir, "embeddings"), "label", "embedding", 8, op)
        return found.select("label", "n", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)

    run.__name__ = f"group_vec_{ {'sum': 'sum', 'avg': 'mean', 'max': 'max'}[op] }"
    sql = f"""SELECT e.label, count(*) AS n, CAST(i AS INTEGER) AS dim, round({op}(CAST(embedding[i+1] AS DOUBLE)),6)+0e0 AS value
FROM embeddings e, range(8) r(i) GROUP BY e.label, i"""
    query(sql)(run)


for _op in ("sum", "avg", "max"):
    _vectors(_op)


def _latents(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in ("x", "y", "z")]).alias("total"))


@query(
    """, s AS (SELECT label, count(*)*1e0 AS c, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM epts WHERE vec_id % 3 = 0 GROUP BY 1),
d AS (SELECT label, count(*)*1e0 AS n, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM epts WHERE vec_id % 3 <> 0 AND label < 8 GROUP BY 1),
m AS (SELECT coalesce(s.label, d.label) AS label, coalesce(c,0e0) AS c, CASE WHEN coalesce(c,0e0) >= 18e0 THEN 0e0 ELSE coalesce(n,0e0) END AS n,
 coalesce(s.x,0e0) AS sx, coalesce(s.y,0e0) AS sy, coalesce(s.z,0e0) AS sz, coalesce(d.x,0e0) AS dx, coalesce(d.y,0e0) AS dy, coalesce(d.z,0e0) AS dz FROM s FULL JOIN d ON s.label = d.label)
SELECT label, c+n AS obs_count, round(CASE WHEN n > 0 THEN (sx*c+dx)/(c+n) ELSE sx END,6)+0e0 AS lx, round(CASE WHEN n > 0 THEN (sy*c+dy)/(c+n) ELSE sy END,6)+0e0 AS ly,
 round(CASE WHEN n > 0 THEN (sz*c+dz)/(c+n) ELSE sz END,6)+0e0 AS lz FROM m""",
    "epts",
)
def running_mean_merge(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    state = points.where("vec_id % 3 = 0").groupBy("label").agg(F.array(F.avg("x"), F.avg("y"), F.avg("z")).alias("latent"), F.count("*").cast("double").alias("obs_count"))
    merged = reduce.running_mean_merge(state, _latents(points.where("vec_id % 3 != 0 AND label < 8")), "label", 18)
    return merged.select("label", "obs_count", *[(F.round(F.col("latent")[i], 6) + 0.0).alias(f"l{c}") for i, c in enumerate("xyz")])


@query(
    """, s AS (SELECT label, count(*)*1e0 AS c, avg(x) AS x, avg(y) AS y FROM epts GROUP BY 1),
k AS (SELECT label, count(*)*1e0 AS n, avg(x) AS ox, avg(y) AS oy, avg(nx) AS px, avg(ny) AS py FROM epts WHERE vec_id % 2 = 0 GROUP BY 1)
SELECT s.label, c AS obs_count, round((x*c+(px-ox)*n)/c,6)+0e0 AS lx, round((y*c+(py-oy)*n)/c,6)+0e0 AS ly FROM s JOIN k ON s.label = k.label""",
    "epts",
)
def deintegrate(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    state = points.groupBy("label").agg(F.array(F.avg("x"), F.avg("y")).alias("latent"), F.count("*").cast("double").alias("obs_count"))
    change = points.where("vec_id % 2 = 0").groupBy("label").agg(F.array(F.avg("x"), F.avg("y")).alias("old"), F.array(F.avg("nx"), F.avg("ny")).alias("new"), F.count("*").cast("double").alias("count_old"))
    return reduce.deintegrate(state, change, "label").select("label", "obs_count", *[(F.round(F.col("latent")[i], 6) + 0.0).alias(f"l{c}") for i, c in enumerate("xy")])


def _ids(points: DataFrame, name: str) -> DataFrame:
    return points.select(F.col("vec_id").alias(name), "x", "y", "z")


_D2 = "(b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z)"
_PAIRS = f"p AS (SELECT a.vec_id AS qid, b.vec_id AS pid, {_D2} AS d2 FROM epts a, epts b)"
_RANKED = f"{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM p)"


@query(f", {_RANKED} SELECT qid, pid, round(d2,9) AS d2, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5", "epts")
def knn_topk(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    return spatial.k_nearest(_ids(points, "qid"), _ids(points, "pid"), 5).withColumn("d2", F.round("d2", 9))


@query(f", {_PAIRS} SELECT qid, count(*) AS n FROM p WHERE d2 < 1e-1*1e-1 GROUP BY 1", "epts")
def radius_count(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    return spatial.radius_counts(_ids(points, "qid"), _ids(points, "pid"), 0.1)


@query(f", {_RANKED} SELECT qid, pid, round(d2,9) AS d2, CAST(rank AS INTEGER) AS rank FROM k WHERE d2 < 1e-1*1e-1 AND rank <= 8", "epts")
def radius_topk(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    return spatial.radius_top(_ids(points, "qid"), _ids(points, "pid"), 0.1, 8).select("qid", "pid", F.round("d2", 9).alias("d2"), "rank")


@query(f", {_PAIRS} SELECT qid AS pid FROM p WHERE d2 < 1e-1*1e-1 GROUP BY 1 HAVING count(*) >= 16", "epts")
def radius_outlier(spark, sf_dir):
    return spatial.remove_outliers(_ids(views.epts(spark, sf_dir), "pid"), 16, 0.1).select("pid")


@query()
def estimate_normals(spark, sf_dir):
    return spatial.estimate_normals(_ids(views.epts(spark, sf_dir), "pid"), 16, 0.2)


@query(
    f""", q AS (SELECT vec_id AS qid, x+5e-2 AS x, y-3e-2 AS y, z+2e-2 AS z FROM epts),
p AS (SELECT a.qid, b.vec_id AS pid, {_D2} AS d2, b.nx*(a.x-b.x)+b.ny*(a.y-b.y)+b.nz*(a.z-b.z) AS side FROM q a, epts b),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM p),
v AS (SELECT qid, min(CASE WHEN rank = 1 THEN sqrt(d2) END) AS d, min(CASE WHEN rank = 1 THEN abs(side) END) AS s, sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) AS plus, count(*) AS n FROM k WHERE rank <= 11 GROUP BY 1)
SELECT qid, round(CASE WHEN plus = n THEN 1e0 WHEN plus = 0 THEN -1e0 END * CASE WHEN d < 5e-2 THEN s ELSE d END, 6)+0e0 AS sdf FROM v""",
    "epts",
)
def knn_vote_sdf(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    samples = points.select(F.col("vec_id").alias("qid"), (F.col("x") + 0.05).alias("x"), (F.col("y") - 0.03).alias("y"), (F.col("z") + 0.02).alias("z"))
    surface = points.select(F.col("vec_id").alias("pid"), "x", "y", "z", "nx", "ny", "nz")
    found = spatial.vote_sdf(samples, surface, 11, 0.05)
    return found.select("qid", F.when(~F.isnan("sdf"), F.round("sdf", 6) + 0.0).alias("sdf"))


@query(
    """, c AS (SELECT i*64+j*8+k AS qid, (i+5e-1)*25e-2-1e0 AS x, (j+5e-1)*25e-2-1e0 AS y, (k+5e-1)*25e-2-1e0 AS z FROM range(8) a(i), range(8) b(j), range(8) d(k))
SELECT c.qid, count(*) AS n, CAST(sum(CASE WHEN e.nx > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM c JOIN epts e
ON abs(e.x-c.x) <= 25e-2 AND abs(e.y-c.y) <= 25e-2 AND abs(e.z-c.z) <= 25e-2 GROUP BY 1""",
    "epts",
)
def chebyshev_range_join(spark, sf_dir):
    axes = [F.floor(F.col("id") / 64), F.floor(F.col("id") / 8) % 8, F.col("id") % 8]
    centres = spark.range(512).select(F.col("id").alias("qid"), *[((a + 0.5) * 0.25 - 1.0).alias(c) for a, c in zip(axes, "xyz", strict=True)])
    points = views.epts(spark, sf_dir).select(F.col("vec_id").alias("pid"), "x", "y", "z", "nx")
    return spatial.near_pairs(centres, points, 0.25, chebyshev=True).groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("nx") > 0).alias("positive"))


@query("SELECT frame_id, v, u, round((u-75e-1)/20e0*depth,8)+0e0 AS x, round((v-75e-1)/20e0*depth,8)+0e0 AS y, round(depth,6) AS z FROM px WHERE depth >= 24e-1 AND depth <= 27e-1", "px")
def unproject_depth(spark, sf_dir):
    pixels = views.px(spark, sf_dir).withColumn("depth", geo.depth_in_range(F.col("depth"), 2.4, 2.7)).where(~F.isnan("depth"))
    p = geo.unproject(F.col("u"), F.col("v"), F.col("depth"), *K)
    return pixels.select("frame_id", "v", "u", *[(F.round(x, n) + 0.0).alias(c) for x, c, n in zip(p, "xyz", (8, 8, 6), strict=True)])


@query(
    "SELECT frame_id, v//2 AS v, u//2 AS u, round(avg(intensity),6) AS intensity, round(max(CASE WHEN v%2=0 AND u%2=0 THEN depth END),6) AS depth FROM px GROUP BY frame_id, v//2, u//2", "px"
)
def image_pyramid(spark, sf_dir):
    return image.half(views.px(spark, sf_dir)).select("frame_id", "v", "u", r6("intensity"), r6("depth"))


_SOBEL = """s AS (SELECT a.frame_id, a.v, a.u, count(*) AS n,
 sum((b.u-a.u)*(CASE WHEN b.v=a.v THEN 2e0 ELSE 1e0 END)*b.intensity)/8 AS gx, sum((b.v-a.v)*(CASE WHEN b.u=a.u THEN 2e0 ELSE 1e0 END)*b.intensity)/8 AS gy
 FROM px a JOIN px b ON a.frame_id=b.frame_id AND abs(a.v-b.v)<=1 AND abs(a.u-b.u)<=1 GROUP BY 1,2,3)"""


@query(f", {_SOBEL} SELECT frame_id, v, u, CASE WHEN n=9 THEN round(gx,6)+0e0 END AS gx, CASE WHEN n=9 THEN round(gy,6)+0e0 END AS gy FROM s", "px")
def sobel_gradient(spark, sf_dir):
    found = image.sobel(views.px(spark, sf_dir))
    return found.select("frame_id", "v", "u", *[F.when(~F.isnan(g), F.round(g, 6) + 0.0).alias(g) for g in ("gx", "gy")])


@query(
    """, b AS (SELECT a.frame_id, a.v, a.u, a.depth AS z, b.depth AS d, abs(a.v-b.v)+abs(a.u-b.u) AS far,
 1e0/(12e-4+19e-4*(a.depth-4e-1)*(a.depth-4e-1)+1e-4/sqrt(a.depth)*25e-2) AS sharp FROM px a JOIN px b ON a.frame_id=b.frame_id AND abs(a.v-b.v)<=2 AND abs(a.u-b.u)<=2),
w AS (SELECT *, exp(-5e-1*(far*(12232e-4*12232e-4)+(d-z)*(d-z)*sharp*sharp)) AS w FROM b)
SELECT frame_id, v, u, round(CASE WHEN v>=2 AND u>=2 AND v<14 AND u<14 THEN sum(w*d)/sum(w) ELSE z END,6) AS depth FROM w GROUP BY frame_id, v, u, z""",
    "px",
)
def bilateral_depth(spark, sf_dir):
    return image.bilateral(views.px(spark, sf_dir), 16, 16).select("frame_id", "v", "u", r6("depth"))


@query(
    """, p AS (SELECT frame_id, v, u, (u-75e-1)/20e0*depth AS x, (v-75e-1)/20e0*depth AS y, depth AS z FROM px),
d AS (SELECT c.*, r.x-l.x AS ax, r.y-l.y AS ay, r.z-l.z AS az, b.x-t.x AS bx, b.y-t.y AS by_, b.z-t.z AS bz FROM p c
 LEFT JOIN p r ON r.frame_id=c.frame_id AND r.v=c.v AND r.u=c.u+1 LEFT JOIN p l ON l.frame_id=c.frame_id AND l.v=c.v AND l.u=c.u-1
 LEFT JOIN p b ON b.frame_id=c.frame_id AND b.v=c.v+1 AND b.u=c.u LEFT JOIN p t ON t.frame_id=c.frame_id AND t.v=c.v-1 AND t.u=c.u),
n AS (SELECT *, by_*az-bz*ay AS ex, bz*ax-bx*az AS ey, bx*ay-by_*ax AS ez FROM d), m AS (SELECT *, sqrt(ex*ex+ey*ey+ez*ez) AS len FROM n),
w AS (SELECT *, acos(ez/len)/(5e-1*314159e-5-acos(ez/len)) AS tilt FROM m)
SELECT frame_id, v, u, round(ex/len,6)+0e0 AS nx, round(ey/len,6)+0e0 AS ny, round(ez/len,6)+0e0 AS nz,
 round(coalesce(1e0/(12e-4+19e-4*(z-4e-1)*(z-4e-1)+1e-4/sqrt(z)*tilt*tilt),-1e0),5) AS weight FROM w""",
    "px",
)
def normal_map(spark, sf_dir):
    found = image.cross_normals(views.px(spark, sf_dir), K)
    return found.select("frame_id", "v", "u", *[F.when(~F.isnan(c), F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")], F.round("weight", 5).alias("weight"))


@query()
def normal_map_robust(spark, sf_dir):
    return image.pca_normals(views.px(spark, sf_dir), K, near2=0.5)


def _residuals(spark, sf_dir):
    pixels = views.px(spark, sf_dir)
    return image.photometric_residuals(pixels.where("frame_id = 1"), pixels.where("frame_id = 0"), K, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [0.1, 0.05, 0.0], 0.0, 0.5)


_PROJ = f"""{_SOBEL},
q AS (SELECT c.v, c.u, c.intensity, s.gx, s.gy, (c.u-75e-1)/20e0*c.depth AS px, (c.v-75e-1)/20e0*c.depth AS py, c.depth AS pz
 FROM px c JOIN s ON s.frame_id=c.frame_id AND s.v=c.v AND s.u=c.u WHERE c.frame_id=1 AND s.n=9),
r AS (SELECT q.*, CAST(round_even((px+1e-1)/pz*20e0+75e-1,0) AS BIGINT) AS u0, CAST(round_even((py+5e-2)/pz*20e0+75e-1,0) AS BIGINT) AS v0 FROM q),
f AS (SELECT r.v, r.u, r.v0, r.u0, r.intensity-p.intensity AS f, r.gx*20e0/pz AS jx, r.gy*20e0/pz AS jy, r.px, r.py, r.pz
 FROM r JOIN px p ON p.frame_id=0 AND p.v=r.v0 AND p.u=r.u0 WHERE p.depth>0 AND abs(r.pz-p.depth)<=5e-1)"""


@query(f", {_PROJ} SELECT v, u, v0, u0, round(f,6)+0e0 AS f, round(jx,6)+0e0 AS j0, round(-(jx*px+jy*py)/pz,6)+0e0 AS j2 FROM f", "px")
def projective_residual(spark, sf_dir):
    return _residuals(spark, sf_dir).select("v", "u", "v0", "u0", *[(F.round(c, 6) + 0.0).alias(c) for c in ("f", "j0", "j2")])


@query(
    f", {_PROJ}, k AS (SELECT *, -(jx*px+jy*py)/pz AS jz FROM f) SELECT count(*) AS m, round(avg(jx*jx),5) AS h00, round(avg(jx*jy),5)+0e0 AS h01, "
    "round(avg((py*jz-pz*jy)*(py*jz-pz*jy)),5) AS h33, round(avg(jx*f),5)+0e0 AS g0, round(avg(f*f),5) AS e FROM k",
    "px",
)
def normal_equations_rgb(spark, sf_dir):
    found = image.normal_equations(_residuals(spark, sf_dir))
    return found.select("m", *[(F.round(c, 5) + 0.0).alias(c) for c in ("h00", "h01", "h33", "g0", "e")])


@query(
    "SELECT vec_id, " + ", ".join(f"round(x*{r[0]!r}e0+y*{r[1]!r}e0+z*{r[2]!r}e0+({t!r}e0),6)+0e0 AS {c}" for r, t, c in zip(TURN, MOVE, "xyz", strict=True)) + " FROM epts",
    "epts",
)
def rigid_transform(spark, sf_dir):
    p = geo.transform(geo.vec("x", "y", "z"), TURN, MOVE)
    return views.epts(spark, sf_dir).select("vec_id", *[(F.round(x, 6) + 0.0).alias(c) for x, c in zip(p, "xyz", strict=True)])


@query(
    """, a AS (SELECT vec_id, nx, ny, nz, x, y, z, sqrt(nx*nx+ny*ny+nz*nz) AS t FROM epts), b AS (SELECT *, nx*x+ny*y+nz*z AS d FROM a)
SELECT vec_id, round(x*cos(t)+(ny*z-nz*y)*sin(t)/t+nx*d*(1-cos(t))/(t*t),6)+0e0 AS x, round(y*cos(t)+(nz*x-nx*z)*sin(t)/t+ny*d*(1-cos(t))/(t*t),6)+0e0 AS y,
 round(z*cos(t)+(nx*y-ny*x)*sin(t)/t+nz*d*(1-cos(t))/(t*t),6)+0e0 AS z FROM b""",
    "epts",
)
def so3_exp(spark, sf_dir):
    r = geo.so3_exp(*geo.vec("nx", "ny", "nz"))
    return views.epts(spark, sf_dir).select("vec_id", *[(F.round(row[0] * F.col("x") + row[1] * F.col("y") + row[2] * F.col("z"), 6) + 0.0).alias(c) for row, c in zip(r, "xyz", strict=True)])


@query()
def twist_compose(spark, sf_dir):
    workers_find_package(spark)

    @F.pandas_udf("array<double>")
    def run(*parts):
        import pandas as pd

        out = []
        for xi in zip(*parts, strict=True):
            pose = se3_exp(np.array(xi))
            out.append([*se3_log(pose @ pose), float(np.abs(pose @ inverse(pose) - np.eye(4)).max())])
        return pd.Series(out)

    return views.epts(spark, sf_dir).select("vec_id", run("x", "y", "z", "nx", "ny", "nz").alias("twice"))


@query(
    """, e AS (SELECT y-25e-1 AS f FROM pts) SELECT round(sum(CASE WHEN abs(f) > 5e-1 THEN 5e-1/abs(f) ELSE 1e0 END),3) AS huber,
round(sum(CASE WHEN abs(f) <= 2e0 THEN (1-f/2e0*f/2e0)*(1-f/2e0*f/2e0) ELSE 0e0 END),3) AS tukey FROM e""",
    "pts",
)
def robust_weights(spark, sf_dir):
    f = F.col("y") - 2.5
    return views.pts(spark, sf_dir).agg(F.round(F.sum(geo.huber_weight(f, 0.5)), 3).alias("huber"), F.round(F.sum(geo.tukey_weight(f, 2.0)), 3).alias("tukey"))


_CROSS = """sqrt(power((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2)+power((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2)+power((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2))/2"""


@query(f"SELECT tri_id, round({_CROSS},6) AS area FROM tri", "epts", "tri")
def triangle_area(spark, sf_dir):
    return sample.areas(views.tri(spark, sf_dir)).select("tri_id", r6("area"))


_CDF = f"c AS (SELECT *, sum({_CROSS}) OVER (ORDER BY tri_id) AS cdf FROM tri)"


@query(f", {_CDF} SELECT tri_id, round(cdf,6) AS cdf FROM c", "epts", "tri")
def area_cdf(spark, sf_dir):
    return sample.area_cdf(views.tri(spark, sf_dir)).select("tri_id", r6("cdf"))


def _u(key: str) -> str:
    return f"(CAST(('0x'||substr(md5({key}),1,8)) AS BIGINT)/4294967296e0)"


@query(
    f""", {_CDF}, k AS (SELECT *, lag(cdf,1,0e0) OVER (ORDER BY tri_id) AS below, max(cdf) OVER () AS total FROM c),
s AS (SELECT i AS sid, {_u("i||':t'")} AS t, {_u("i||':a'")} AS r1, {_u("i||':b'")} AS r2 FROM range(2000) q(i)),
w AS (SELECT s.*, k.*, 1-sqrt(r1) AS wa FROM s JOIN k ON t*total > below AND t*total <= cdf)
SELECT sid, tri_id, round(wa*ax+(1-wa)*(1-r2)*bx+r2*(1-wa)*cx,6)+0e0 AS x, round(wa*ay+(1-wa)*(1-r2)*by_+r2*(1-wa)*cy,6)+0e0 AS y, round(wa*az+(1-wa)*(1-r2)*bz+r2*(1-wa)*cz,6)+0e0 AS z FROM w""",
    "epts",
    "tri",
)
def cdf_sample(spark, sf_dir):
    found = sample.surface_samples(views.tri(spark, sf_dir), 2000)
    return found.select("sid", "tri_id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


_NORMAL = lambda c: f"sqrt(-2*ln(1-{_u(f"'near:'||sid||':{c}/r'")}))*cos(2*pi()*{_u(f"'near:'||sid||':{c}/t'")})"
_BARY = lambda c, b: f"wa*a{c}+(1-wa)*(1-r2)*{b}+r2*(1-wa)*c{c}"
_SAMPLES = f""", {_CDF}, z AS (SELECT 4*count(*) AS n, CAST(floor(4*count(*)*8e-1) AS BIGINT)//2 AS pairs FROM tri),
k AS (SELECT *, lag(cdf,1,0e0) OVER (ORDER BY tri_id) AS below, max(cdf) OVER () AS total FROM c),
s AS (SELECT i AS sid, {_u("i||':t'")} AS t, {_u("i||':a'")} AS r1, {_u("i||':b'")} AS r2 FROM z, unnest(range(pairs)) q(i)),
w AS (SELECT s.*, k.*, 1-sqrt(r1) AS wa FROM s JOIN k ON t*total > below AND t*total <= cdf),
nr AS (SELECT sid*2+m AS sid, {_BARY('x', 'bx')} AS x, {_BARY('y', 'by_')} AS y, {_BARY('z', 'bz')} AS z, dev FROM w, (VALUES (0, sqrt(2e-2)), (1, sqrt(2e-2/5))) v(m, dev)),
bo AS (SELECT {", ".join(f"least(min(a{c}),min({b}),min(c{c}))-1e-1 AS lo{c}, greatest(max(a{c}),max({b}),max(c{c}))+1e-1 AS hi{c}" for c, b in (("x", "bx"), ("y", "by_"), ("z", "bz")))} FROM tri),
un AS (SELECT 2*pairs+i AS sid FROM z, unnest(range(n-2*pairs)) q(i)),
q AS (SELECT sid AS qid, {", ".join(f"{c}+dev*{_NORMAL(c)} AS {c}" for c in "xyz")} FROM nr
 UNION ALL SELECT sid, {", ".join(f"lo{c}+{_u(f"'box:'||sid||':{c}'")}*(hi{c}-lo{c}) AS {c}" for c in "xyz")} FROM un, bo),
p AS (SELECT a.qid, b.vec_id AS pid, {_D2} AS d2, b.nx*(a.x-b.x)+b.ny*(a.y-b.y)+b.nz*(a.z-b.z) AS side FROM q a, epts b),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, pid) AS rank FROM p),
vo AS (SELECT qid, min(CASE WHEN rank = 1 THEN sqrt(d2) END) AS d, min(CASE WHEN rank = 1 THEN abs(side) END) AS s, sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) AS plus, count(*) AS n FROM rk WHERE rank <= 3 GROUP BY 1),
sm AS (SELECT qid AS sid, x*15e-1 AS x, y*15e-1 AS y, z*15e-1 AS z, CASE WHEN plus = n THEN 15e-1 ELSE -15e-1 END * CASE WHEN d < sqrt(2e-2/5) THEN s ELSE d END AS sdf FROM vo JOIN q USING (qid) WHERE plus = n OR plus = 0),
ce AS (SELECT DISTINCT {", ".join(f"ceil(({c}+2e0)/5e-1)-1 AS g{c}" for c in "xyz")} FROM sm WHERE {" AND ".join(f"{c} > -2 AND {c} <= 2" for c in "xyz")}),
ct AS (SELECT CAST(gz+8*gy+64*gx AS BIGINT) AS lin_id, {", ".join(f"(g{c}+5e-1)*5e-1-2e0 AS m{c}" for c in "xyz")} FROM ce),
ns AS (SELECT *, greatest({", ".join(f"abs({c}-m{c})" for c in "xyz")}) AS far FROM ct, sm WHERE {" AND ".join(f"abs({c}-m{c}) <= 5e-1" for c in "xyz")}),
on_ AS (SELECT lin_id, count(*) AS n_surface FROM ct, epts WHERE {" AND ".join(f"abs({c}*15e-1-m{c}) <= 5e-1" for c in "xyz")} GROUP BY 1),
kp AS (SELECT lin_id FROM ns JOIN on_ USING (lin_id) GROUP BY lin_id HAVING count_if(far <= 25e-2) >= 3 AND any_value(n_surface) >= 3 AND count_if(sdf > 0)/count(*) BETWEEN 1e-1 AND 9e-1)
SELECT lin_id, sid, {", ".join(f"round((s{c}-m{c})/5e-1,5)+0e0 AS {c}" for c in "xyz")}, round(sdf/5e-1,5)+0e0 AS sdf FROM (SELECT lin_id, sid, x AS sx, y AS sy, z AS sz, mx, my, mz, sdf FROM ns) WHERE lin_id IN (SELECT lin_id FROM kp)"""


@query(_SAMPLES, "epts", "tri")
def sampler_records(spark, sf_dir):
    """Training records of the triangles against the points: samples about the surface and in its box, voted distances, voxels worth training on."""
    triangles = views.tri(spark, sf_dir)
    surface = views.epts(spark, sf_dir).select(F.col("vec_id").alias("pid"), "x", "y", "z", "nx", "ny", "nz")
    wide = grid.Grid((-2.0, -2.0, -2.0), 0.5, (8, 8, 8))
    sampler = sample.Sampler(wide, 4 * triangles.count(), votes=3, least=3, scale=1.5)
    found, _ = sampler.records(triangles, surface)
    return found.select("lin_id", "sid", *[(F.round(c, 5) + 0.0).alias(c) for c in ("x", "y", "z", "sdf")])


@query(
    """SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM epts
WHERE vec_id < (SELECT count(*)//3*3 FROM epts) AND vec_id//3%2=0""",
    "epts",
)
def bbox_used_vertices(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    faces = views.tri(spark, sf_dir).where("tri_id % 2 = 0").select(F.explode(F.array(*[F.col("tri_id") * 3 + k for k in range(3)])).alias("vec_id"))
    return points.join(faces, "vec_id", "left_semi").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


@query("SELECT vec_id, s AS positive FROM (SELECT vec_id, x > 0 AS s, row_number() OVER (PARTITION BY x > 0 ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS k FROM epts) WHERE k <= 100", "epts")
def stratified_sample(spark, sf_dir):
    rows = views.epts(spark, sf_dir).withColumn("positive", F.col("x") > 0)
    return sample.per_group(rows, "positive", "vec_id", 100).select("vec_id", "positive")


@query()
def strata_with_replacement(spark, sf_dir):
    rows = views.epts(spark, sf_dir).withColumn("positive", F.col("x") > 0)
    return sample.with_replacement(rows, "positive", "vec_id", 256)


@query("SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM orders) WHERE place <= 3")
def pack_per_group(spark, sf_dir):
    found = sample.per_group(read_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3)
    return found.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT frame_id, event_type, value FROM frames WHERE is_key", "frames")
def keyframe_gate(spark, sf_dir):
    return views.frames(spark, sf_dir).where("is_key").select("frame_id", "event_type", "value")


@query("SELECT frame_id, round(value - lag(value) OVER (ORDER BY frame_id), 6)+0e0 AS delta FROM frames", "frames")
def prev_frame_delta(spark, sf_dir):
    rows = views.frames(spark, sf_dir)
    last = rows.select((F.col("frame_id") + 1).alias("frame_id"), F.col("value").alias("before"))
    return rows.join(last, "frame_id", "left").select("frame_id", (F.round(F.col("value") - F.col("before"), 6) + 0.0).alias("delta"))


@query("SELECT * FROM (SELECT user_id, frame_id, lead(frame_id) OVER (PARTITION BY user_id ORDER BY frame_id) AS next_id FROM frames) WHERE next_id IS NOT NULL", "frames")
def trajectory_edges(spark, sf_dir):
    rows = scan.numbered(views.frames(spark, sf_dir).select("user_id", "frame_id"), ["user_id"], "frame_id")
    after = rows.select("user_id", F.col("frame_id").alias("next_id"), (F.col("place") - 1).alias("place"))
    return rows.join(after, ["user_id", "place"]).select("user_id", "frame_id", "next_id")


_CACHE = "o AS (SELECT vec_id AS tri_no, label AS lin_id, x FROM epts WHERE label < 8), n AS (SELECT vec_id+100000 AS tri_no, label AS lin_id, y AS x FROM epts WHERE label BETWEEN 4 AND 6)"


def _cache(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    old = points.where("label < 8").select(F.col("label").alias("lin_id"), F.col("vec_id").alias("tri_no"), "x")
    new = points.where("label BETWEEN 4 AND 6").select(F.col("label").alias("lin_id"), (F.col("vec_id") + 100000).alias("tri_no"), F.col("y").alias("x"))
    return old, new


@query(f", {_CACHE} SELECT lin_id, tri_no, x FROM o WHERE lin_id NOT IN (SELECT lin_id FROM n) UNION ALL SELECT lin_id, tri_no, x FROM n", "epts")
def mesh_cache_replace(spark, sf_dir):
    old, new = _cache(spark, sf_dir)
    return reduce.replace_by_key(old, new, "lin_id")


@query(f", {_CACHE} SELECT lin_id, tri_no, x FROM o WHERE lin_id NOT BETWEEN 3 AND 6 UNION ALL SELECT lin_id, tri_no, x FROM n", "epts")
def mesh_cache_replace_dirty(spark, sf_dir):
    old, new = _cache(spark, sf_dir)
    return reduce.replace_by_key(old, new, "lin_id", old.where("lin_id BETWEEN 3 AND 6"))


@query("SELECT tri_id, ax, ay, az FROM tri ORDER BY tri_id LIMIT 50", "epts", "tri")
def limit_triangles(spark, sf_dir):
    return views.tri(spark, sf_dir).select("tri_id", "ax", "ay", "az").orderBy("tri_id").limit(50)


@query("SELECT frame_id, round((value-min(value) OVER ())/(max(value) OVER ()-min(value) OVER ()),6)+0e0 AS scaled FROM frames", "frames")
def minmax_normalise(spark, sf_dir):
    found = sinks.min_max(views.frames(spark, sf_dir), "value", "scaled")
    return found.select("frame_id", (F.round("scaled", 6) + 0.0).alias("scaled"))


@query(
    """SELECT 'nation' AS dataset, row_number() OVER (ORDER BY n_nationkey)-1 AS local_id, row_number() OVER (ORDER BY n_nationkey)-1 AS global_id, n_name AS name FROM nation
UNION ALL SELECT 'region', row_number() OVER (ORDER BY r_regionkey)-1, row_number() OVER (ORDER BY r_regionkey)-1+(SELECT count(*) FROM nation), r_name FROM region
UNION ALL SELECT 'supplier', row_number() OVER (ORDER BY s_suppkey)-1, row_number() OVER (ORDER BY s_suppkey)-1+(SELECT count(*) FROM nation)+(SELECT count(*) FROM region), s_name FROM supplier"""
)
def dataset_union_index(spark, sf_dir):
    """A combined data set: every row's global index, and the data set and local index that a lookup by interval gives back."""
    parts = [(0, "nation", "n_nationkey", "n_name"), (1, "region", "r_regionkey", "r_name"), (2, "supplier", "s_suppkey", "s_name")]
    rows = None
    for k, table, key, name in parts:
        part = read_table(spark, sf_dir, table).select(F.lit(k).alias("part"), F.lit(table).alias("dataset"), F.col(key).cast("long").alias("key"), F.col(name).alias("name"))
        part = sinks.dense_ids(part, "key", "local_id")
        rows = part if rows is None else rows.unionByName(part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    ends = scan.prefix_sum(sizes, "n", "part", out="end").withColumn("start", F.col("end") - F.col("n"))
    placed = rows.join(ends.select("part", "start"), "part").withColumn("global_id", F.col("start") + F.col("local_id"))
    total = ends.agg(F.max("end")).first()[0]
    found = scan.interval_lookup(placed.select("global_id", "name").withColumn("at", F.col("global_id") + 1), "at", ends.select("part", "start", "end"), "start", "end", float(total))
    names = rows.select("part", "dataset").distinct()
    return found.join(names, "part").select("dataset", (F.col("global_id") - F.col("start")).alias("local_id"), "global_id", "name")


@query(
    "SELECT event_type AS name, count(value) AS n, round(avg(value),6) AS mean, round(sum(value),4) AS total, arg_max(value, frame_id) AS last FROM frames WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1",
    "frames",
)
def meter_mean(spark, sf_dir):
    rows = views.frames(spark, sf_dir).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy(F.col("event_type").alias("name")).agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.max_by("value", "frame_id").alias("last"))


@query(
    """, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY frame_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM frames)
SELECT event_type AS name, round(sum(power(3e-1, n-k)*CASE WHEN k=1 THEN 1e0 ELSE 7e-1 END*value),6) AS ema, count(*) AS n FROM r GROUP BY 1""",
    "frames",
)
def meter_ema(spark, sf_dir):
    found = reduce.ordered_ema(views.frames(spark, sf_dir), "event_type", "frame_id", "value", 0.3)
    return found.select(F.col("event_type").alias("name"), r6("ema"), "n")


@query(
    """, e AS (SELECT least(greatest(x-25e-1,-1e0),1e0) AS p, least(greatest(y-25e-1,-1e0),1e0) AS t, 5e-2+w/5e0 AS s FROM pts)
SELECT round(avg((t-p)*(t-p)/(2*s*s)+ln(s)+ln(sqrt(2*pi()))),4) AS nll, round(avg(abs(p-t)),6) AS l1, count(*) AS n FROM e""",
    "pts",
)
def losses(spark, sf_dir):
    p, t, s = geo.clamp(F.col("x") - 2.5, 1.0), geo.clamp(F.col("y") - 2.5, 1.0), 0.05 + F.col("w") / 5
    return views.pts(spark, sf_dir).agg(F.round(F.avg(-geo.normal_log_prob(p, s, t)), 4).alias("nll"), F.round(F.avg(F.abs(p - t)), 6).alias("l1"), F.count("*").alias("n"))


@query("SELECT round(avg(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE)*CAST(v AS DOUBLE)))))*4e-1,6) AS reg FROM embeddings")
def reg_loss(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return read_table(spark, sf_dir, "embeddings").agg(F.round(F.avg(norm) * min(1.0, 40 / 100), 6).alias("reg"))


@query(
    """SELECT CAST(i AS BIGINT) AS epoch, round(5e-4*power(5e-1, i//80),12) AS step, round(CASE WHEN i > 50 THEN 1e-3 ELSE 1e-4+(1e-3-1e-4)*i/50 END,12) AS warmup, 1e-3 AS constant FROM range(301) t(i)"""
)
def lr_schedules(spark, sf_dir):
    e = F.col("id")
    rows = spark.range(301)
    return rows.select(e.alias("epoch"), F.round(geo.step_rate(e, 5e-4, 0.5, 80), 12).alias("step"), F.round(geo.warmup_rate(e, 1e-4, 1e-3, 50), 12).alias("warmup"), F.lit(1e-3).alias("constant"))


@query("SELECT CAST(n AS BIGINT) AS id, round(n//64*125e-3,6) AS x, round(n//8%8*125e-3,6) AS y, round(n%8*125e-3,6) AS z FROM range(512) t(n)")
def lattice_samples(spark, sf_dir):
    return mesh.lattice(spark, 8).select("id", r6("x"), r6("y"), r6("z"))


@query(
    """, p AS (SELECT n, 1-(2*n+1)/500e0 AS z, n*(pi()*(3e0-sqrt(5e0))) AS t FROM range(500) q(n))
SELECT CAST(n AS BIGINT) AS id, round(sqrt(1-z*z)*cos(t),6)+0e0 AS x, round(sqrt(1-z*z)*sin(t),6)+0e0 AS y, round(z,6)+0e0 AS z FROM p""".replace(", p AS", "WITH p AS", 1)
)
def sphere_spiral(spark, sf_dir):
    return rgbd.sphere_spiral(spark, 500).select("id", *[(F.round(c, 6) + 0.0).alias(c) for c in "xyz"])


@query(
    """SELECT vec_id, CAST(i AS INTEGER) AS dim, round(((7*i)%11-5)/10e0*x+((7*i+3)%11-5)/10e0*y+((7*i+6)%11-5)/10e0*z+((7*i+9)%11-5)/10e0*nx+((7*i+12)%11-5)/10e0*ny+((7*i+15)%11-5)/10e0*nz
+((i%5)-2)/10e0,6)+0e0 AS value FROM epts, range(4) t(i)""",
    "epts",
)
def mlp_linear(spark, sf_dir):
    found = mlp.encode(views.epts(spark, sf_dir), ["x", "y", "z", "nx", "ny", "nz"], mlp.synthetic([6, 4]))
    return found.select("vec_id", F.posexplode("latent").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query()
def march_cubes(spark, sf_dir):
    field = mesh.lattice(spark, 24, -1.0, 1.0).withColumn("sdf", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 0.7)
    return mesh.march(field, 2 / 23, (-1.0, -1.0, -1.0))


@query(
    f""", {_G}, c AS (SELECT lin_id, count(*)/1e2 AS std, avg(x)-avg(y) AS sdf FROM g GROUP BY 1)
SELECT lin_id//100+a AS i, lin_id//10%10+b AS j, lin_id%10+c AS k, round(sum(std*sdf)/sum(std),6)+0e0 AS sdf, round(avg(std),6) AS std FROM c, range(2) p(a), range(2) q(b), range(2) r(c) GROUP BY 1,2,3""",
    "pts",
)
def overlap_blend(spark, sf_dir):
    """Corners of the voxel lattice, blended from the eight cells around each with their trilinear weights."""
    cells = grid.occupancy(views.pts(spark, sf_dir), PTS).select("lin_id", (F.col("n") / 100).alias("std"), (F.col("cx") - F.col("cy")).alias("sdf"))
    gx, gy, gz = PTS.axes(F.col("lin_id"))
    corner = F.explode(F.array(*[F.struct(*[F.lit(o).alias(n) for o, n in zip(c, "abc", strict=True)]) for c in mesh.CORNERS]))
    rows = cells.select(gx.alias("gx"), gy.alias("gy"), gz.alias("gz"), "sdf", "std", corner.alias("o"))
    rows = rows.select(*[(F.col(f"g{c}") + F.col(f"o.{o}")).alias(n) for c, o, n in zip("xyz", "abc", "ijk", strict=True)], F.lit(0.125).alias("w"), "sdf", "std", F.lit(True).alias("home"))
    return mesh.blend(rows).select("i", "j", "k", (F.round("sdf", 6) + 0.0).alias("sdf"), r6("std"))


@query()
def gauss_newton_pose(spark, sf_dir):
    """The pose that moves points back onto a plane field and a sphere: (step, energy)."""
    points = views.epts(spark, sf_dir).select("x", "y", "z").cache()

    def residuals(pose):
        moved = geo.transform(geo.vec("x", "y", "z"), (pose @ truth)[:3, :3].tolist(), (pose @ truth)[:3, 3].tolist())
        rows = points.select(*[m.alias(f"m{c}") for m, c in zip(moved, "xyz", strict=True)], "x", "y", "z")
        parts = []
        for axis, c in enumerate("xyz"):
            g = [F.lit(1.0 if k == axis else 0.0) for k in range(3)]
            turn = geo.cross(geo.vec("mx", "my", "mz"), tuple(g))
            parts.append(rows.select((F.col(f"m{c}") - F.col(c)).alias("f"), *[x.alias(f"j{k}") for k, x in enumerate([*g, *turn])]))
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    truth = se3_exp(np.array([0.1, -0.05, 0.02, 0.05, 0.1, -0.08]))
    found = track.gauss_newton(residuals, np.eye(4), 6)
    points.unpersist()
    return spark.createDataFrame([(k, float(e)) for k, e in enumerate(found.energies)], "step int, energy double")


@query("SELECT " + _EG + " AS lin_id, round(avg(x),6)+0e0 AS cx, round(avg(y),6)+0e0 AS cy, round(avg(z),6)+0e0 AS cz, count(*)*1e0 AS obs_count FROM epts GROUP BY 1", "epts")
def stream_voxel_state(spark, sf_dir):
    """The points as a stream of four files into the voxel state: the map after the last batch."""
    from stratavox.sources.shared import fresh_path
    from stratavox.streaming.voxel_state import run_to_end

    work = fresh_path(spark, "stream")
    points = views.epts(spark, sf_dir).select("x", "y", "z")
    points.repartition(4).write.parquet(f"{work}/source")
    found = run_to_end(spark, f"{work}/source", "x double, y double, z double", EPTS, work)
    return found.select("lin_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cy", "cz")], "obs_count")
