"""Queries of the voxel map: lattices and their stitching, changed meshes, keyed state, the distance term, training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import geometry as geo
from stratavox.operators import grid, image, mesh, reduce, sample, volume
from stratavox.plans import views
from stratavox.plans.registered import query, r6

EPTS = grid.Grid((-1.0, -1.0, -1.0), 0.25, (8, 8, 8))
TURN = [[0.36, 0.48, -0.8], [-0.8, 0.6, 0.0], [0.48, 0.64, 0.6]]
R = 4

_AXIS = {c: f"(ceil(({c}+1e0)/25e-2)-1)" for c in "xyz"}
_ID = f"CAST({_AXIS['z']}+8*{_AXIS['y']}+64*{_AXIS['x']} AS BIGINT)"
_V = (
    f"v AS (SELECT {_ID} AS lin_id, count(*)*1e0 AS obs_count, "
    + ", ".join(f"avg(({c}+1e0)/25e-2-{_AXIS[c]}-5e-1) AS l{c}" for c in "xyz")
    + ", min(label) AS least FROM epts GROUP BY 1 HAVING count(*) > 2)"
)
_T = "t AS (SELECT i, j, k FROM range(8) a(i), range(8) b(j), range(8) c(k))"
_SDF = "sqrt((px-lx)*(px-lx)+(py-ly)*(py-ly)+(pz-lz)*(pz-lz))-4e-1"
_STD = "5e-2+1e-1/obs_count"
_S = f"s AS (SELECT *, {_SDF} AS sdf, {_STD} AS std FROM (SELECT *, i*25e-2-1e0 AS px, j*25e-2-1e0 AS py, k*25e-2-1e0 AS pz FROM v, t))"


def _stitched(source: str) -> str:
    """DuckDB text of the corners ``f`` that the lattices of ``source`` stitch to."""
    cells = dict(zip("ijk", ("lin_id//64", "lin_id//8%8", "lin_id%8"), strict=True))
    at = ", ".join(f"{c}*4+{a}-2 AS {a}, {c} AS c{a}" for a, c in cells.items())
    w = "*".join(f"(1-abs({a}/4e0-c{a}-5e-1))" for a in "ijk")
    home = " AND ".join(f"floor({a}/4e0)=c{a}" for a in "ijk")
    ends = " AND ".join(f"(d{a}=0 OR {a}=31)" for a in "ijk")
    return f"""w AS (SELECT i, j, k, sdf, std, {w} AS w, {home} AS home FROM (SELECT {at}, sdf, std FROM {source})),
e AS (SELECT i, j, k, sum(w*std*sdf)/sum(w*std) AS sdf, sum(w*std)/sum(w) AS std FROM w GROUP BY 1,2,3 HAVING bool_or(home)),
f AS (SELECT i+di AS i, j+dj AS j, k+dk AS k, sdf, std FROM e, range(2) a(di), range(2) b(dj), range(2) c(dk) WHERE {ends})"""


def _voxels(points: DataFrame) -> DataFrame:
    cells = EPTS.cells(points)
    place = {c: geo.relative(F.col(c), F.col(f"g{c}"), -1.0, 0.25) for c in "xyz"}
    found = cells.groupBy("lin_id").agg(F.count("*").cast("double").alias("obs_count"), *[F.avg(p).alias(f"l{c}") for c, p in place.items()], F.min("label").alias("least"))
    return found.where("obs_count > 2")


def _decode(rows: DataFrame) -> DataFrame:
    d = [F.col(c) - F.col(f"l{c}") for c in "xyz"]
    return rows.withColumns({"sdf": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - 0.4, "std": 0.05 + 0.1 / F.col("obs_count")})


@query(f", {_V}, {_T}, {_S}, {_stitched('s')} SELECT i, j, k, round(sdf,6)+0e0 AS sdf, round(std,6) AS std FROM f", "epts")
def lattice_blend(spark, sf_dir):
    """Corners of the fine grid, stitched from the overlapping lattices of up to eight voxels by trilinear weights."""
    lattices = volume.decode_lattice(_voxels(views.epts(spark, sf_dir)), R, _decode)
    return volume.stitch(lattices, EPTS, R).select("i", "j", "k", (F.round("sdf", 6) + 0.0).alias("sdf"), r6("std"))


_BASE = {a: f"least(CAST(floor(t.{a}*(3e0/7e0)) AS BIGINT),2)" for a in "ijk"}
_NEAR = " AND ".join(f"c.{a} BETWEEN {_BASE[a]} AND {_BASE[a]}+1" for a in "ijk")
_TENT = "*".join(f"(1-abs(t.{a}*(3e0/7e0)-c.{a}))" for a in "ijk")


@query(
    f""", {_V}, {_T}, c AS (SELECT *, {_SDF} AS sdf, {_STD} AS std FROM (SELECT *, i*(175e-2/3)-1e0 AS px, j*(175e-2/3)-1e0 AS py, k*(175e-2/3)-1e0 AS pz FROM v, t WHERE i<4 AND j<4 AND k<4)),
n AS (SELECT c.lin_id, t.i, t.j, t.k, sum({_TENT}*c.sdf) AS sdf, sum({_TENT}*c.std) AS std FROM t JOIN c ON {_NEAR} GROUP BY 1,2,3,4), {_S}
SELECT n.lin_id, n.i, n.j, n.k, round(CASE WHEN abs(n.sdf) < 5e-2 THEN s.sdf ELSE n.sdf END,6)+0e0 AS sdf FROM n JOIN s USING (lin_id, i, j, k)""",
    "epts",
)
def lattice_refine(spark, sf_dir):
    """Lattices from coarse samples, interpolated, and decoded again near the surface only."""
    found = volume.decode_lattice(_voxels(views.epts(spark, sf_dir)), R, _decode, 0.05)
    return found.select("lin_id", "i", "j", "k", (F.round("sdf", 6) + 0.0).alias("sdf"))


_COUNTS = ", ".join(f"({case},{len(found)})" for case, found in enumerate(mesh.triangle_table()))
_CORNER = ", ".join(f"({n},{a},{b},{c})" for n, (a, b, c) in enumerate(mesh.CORNERS))
_DIRTY = "SELECT lin_id FROM v WHERE least = 0"
_FACES = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) AS o(dx,dy,dz)"


def _dilated(cells: str) -> str:
    part = lambda c, d: f"least(greatest({c}+{d},0),7)"
    return f"SELECT DISTINCT CAST({part('(lin_id%8)', 'dz')}+8*{part('(lin_id//8%8)', 'dy')}+64*{part('(lin_id//64)', 'dx')} AS BIGINT) AS lin_id FROM ({cells}) d, {_FACES}"


@query(
    f""", {_V}, {_T}, {_S}, m AS (SELECT * FROM s WHERE obs_count > 3e0 AND lin_id IN ({_dilated(_DIRTY)})), {_stitched('m')},
q AS (SELECT f.i-o.a AS i, f.j-o.b AS j, f.k-o.c AS k, sum(CASE WHEN sdf < 0 THEN 1 << o.n ELSE 0 END) AS code FROM f, (VALUES {_CORNER}) AS o(n,a,b,c) GROUP BY 1,2,3 HAVING count(*) = 8),
h AS (SELECT CAST(k//4+8*(j//4)+64*(i//4) AS BIGINT) AS lin_id, code FROM q WHERE i >= 0 AND j >= 0 AND k >= 0)
SELECT lin_id, CAST(sum(p.n) AS BIGINT) AS n FROM h JOIN (VALUES {_COUNTS}) AS p(code, n) ON p.code = h.code WHERE lin_id IN ({_DIRTY}) GROUP BY 1 HAVING sum(p.n) > 0""",
    "epts",
)
def dirty_mesh(spark, sf_dir):
    """Triangles of each changed voxel's new mesh; its neighbours are decoded for the stitching but make no mesh."""
    voxels = _voxels(views.epts(spark, sf_dir))
    made = volume.dirty_mesh(voxels, voxels.where("least = 0"), EPTS, R, _decode, 3)
    return made.groupBy("lin_id").agg(F.count("*").alias("n"))


@query(
    f""", {_V}, {_T}, {_S}, p AS (SELECT min(sdf) AS lo, max(sdf) AS hi FROM s) SELECT lin_id, i, j, k, round((lin_id//64+5e-1+px)*25e-2-1e0,6)+0e0 AS x,
 round((lin_id//8%8+5e-1+py)*25e-2-1e0,6)+0e0 AS y, round((lin_id%8+5e-1+pz)*25e-2-1e0,6)+0e0 AS z, round((sdf-lo)/(hi-lo),6)+0e0 AS scaled FROM s, p""",
    "epts",
)
def lattice_dump(spark, sf_dir):
    """All samples of all lattices at their places in the world, with the distance scaled to [0, 1]."""
    from stratavox.sources import sinks

    rows = _decode(volume.lattice_of(_voxels(views.epts(spark, sf_dir)), 2 * R, volume.bounds(R)[0], 1 / R))
    world = [(F.round((g + 0.5 + F.col(c)) * 0.25 - 1.0, 6) + 0.0).alias(c) for g, c in zip(EPTS.axes(F.col("lin_id")), "xyz", strict=True)]
    return sinks.min_max(rows, "sdf", "scaled").select("lin_id", "i", "j", "k", *world, (F.round("scaled", 6) + 0.0).alias("scaled"))


_MOVED = ", ".join(f"least(greatest(CAST(ceil(({c}+1e0)/25e-2+o{c})-1 AS BIGINT),0),7) AS g{c}" for c in "xyz")


@query(
    f""", a AS (SELECT {_ID} AS lin_id, avg(x) AS lx, avg(y) AS ly, avg(z) AS lz, count(*)*1e0 AS obs_count, count(*) >= 6 AS optimized FROM epts WHERE vec_id % 3 = 0 GROUP BY 1),
b AS (SELECT DISTINCT {_ID} AS lin_id FROM epts WHERE vec_id % 3 <> 0 AND label < 8),
n AS (SELECT lin_id FROM ({_dilated("SELECT lin_id FROM b WHERE lin_id NOT IN (SELECT lin_id FROM a)")}) WHERE lin_id NOT IN (SELECT lin_id FROM a)),
s AS (SELECT * FROM a UNION ALL SELECT lin_id, 0e0, 0e0, 0e0, 0e0, false FROM n),
o AS (SELECT p.v AS ox, q.v AS oy, r.v AS oz FROM (VALUES (-5e-1),(5e-1)) p(v), (VALUES (-5e-1),(5e-1)) q(v), (VALUES (-5e-1),(5e-1)) r(v)),
g AS (SELECT x, y, z, {_MOVED} FROM epts, o WHERE vec_id % 3 <> 0 AND label < 8),
d AS (SELECT gz+8*gy+64*gx AS lin_id, count(*) AS n, sum((x+1e0)/25e-2-gx-5e-1) AS sx, sum((y+1e0)/25e-2-gy-5e-1) AS sy, sum((z+1e0)/25e-2-gz-5e-1) AS sz FROM g GROUP BY 1),
m AS (SELECT s.*, coalesce(n, 0) AS n, sx, sy, sz FROM s LEFT JOIN d ON d.lin_id = s.lin_id AND s.obs_count < 18e0)
SELECT lin_id, obs_count+n AS obs_count, {", ".join(f"round(CASE WHEN n > 0 THEN (l{c}*obs_count+s{c})/(obs_count+n) ELSE l{c} END,6)+0e0 AS l{c}" for c in "xyz")},
 optimized, obs_count+n >= 18e0 AND NOT optimized AND lin_id > 0 AS due FROM m""",
    "epts",
)
def state_admission(spark, sf_dir):
    """One key-frame into the keyed state: touched and neighbouring cells admitted, open cells merged, those due for optimisation marked."""
    points = views.epts(spark, sf_dir)
    old = EPTS.cells(points.where("vec_id % 3 = 0")).groupBy("lin_id").agg(F.array(F.avg("x"), F.avg("y"), F.avg("z")).alias("latent"), F.count("*").cast("double").alias("obs_count"))
    came = points.where("vec_id % 3 != 0 AND label < 8")
    state = volume.admit(old.withColumn("optimized", F.col("obs_count") >= 6), EPTS.cells(came), EPTS, 3)
    around = grid.scatter8(came, EPTS, state.where("obs_count < 18"))
    delta = around.groupBy("lin_id").agg(F.count("*").alias("n"), F.array(*[F.sum(f"r{c}") for c in "xyz"]).alias("total"))
    new = volume.integrate(state, delta, 18)
    chosen = volume.due(new, 18).select("lin_id", F.lit(True).alias("due"))
    latents = [(F.round(F.col("latent")[i], 6) + 0.0).alias(f"l{c}") for i, c in enumerate("xyz")]
    return new.join(chosen, "lin_id", "left").select("lin_id", "obs_count", *latents, "optimized", F.coalesce("due", F.lit(False)).alias("due"))


_TURNED = ", ".join(f"(gx*{r[0]}e0+gy*{r[1]}e0+gz*({r[2]}e0))/std AS a{n}" for n, r in enumerate(TURN))


@query(
    f""", {_V}, p AS (SELECT *, sqrt(x*x+y*y+z*z) AS d, 1e-1+5e-2*abs(nx) AS std FROM epts WHERE {_ID} IN (SELECT lin_id FROM v)),
g AS (SELECT *, (d-3e-1)/std AS f, x/d AS gx, y/d AS gy, z/d AS gz FROM p), j AS (SELECT *, {_TURNED}, CASE WHEN abs(f) > 1e0 THEN 1e0/abs(f) ELSE 1e0 END AS w FROM g)
SELECT count(*) AS m, round(avg(w*a0*a0),5) AS h00, round(avg(w*a0*a1),5)+0e0 AS h01, round(avg(w*(y*a2-z*a1)*(y*a2-z*a1)),5) AS h33, round(avg(w*a0*f),5)+0e0 AS g0,
 round(avg(w*(x*a1-y*a0)*f),5)+0e0 AS g5, round(avg(w*f*f),5) AS e FROM j""",
    "epts",
)
def normal_equations_sdf(spark, sf_dir):
    """The signed-distance term of the tracker over points in known voxels, with Huber weights; the field is a sphere's."""
    points = views.epts(spark, sf_dir)
    seen = grid.lookup(points, EPTS, _voxels(points).select("lin_id", "obs_count"), 2).where("known")
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    rows = seen.select(*[F.col(c).alias(f"p{c}") for c in "xyz"], (d - 0.3).alias("sdf"), (0.1 + 0.05 * F.abs("nx")).alias("std"), *[(F.col(c) / d).alias(f"g{c}") for c in "xyz"])
    found = image.normal_equations(volume.sdf_residuals(rows, TURN), geo.huber_weight(F.col("f"), 1.0))
    return found.select("m", *[(F.round(c, 5) + 0.0).alias(c) for c in ("h00", "h01", "h33", "g0", "g5", "e")])


_CENTRE = f"c AS (SELECT lin_id, (lin_id//64+5e-1)*25e-2-1e0 AS cx, (lin_id//8%8+5e-1)*25e-2-1e0 AS cy, (lin_id%8+5e-1)*25e-2-1e0 AS cz FROM (SELECT DISTINCT {_ID} AS lin_id FROM epts))"
_BOX = "b AS (SELECT *, greatest(abs(x-cx),abs(y-cy),abs(z-cz)) AS far FROM c, epts WHERE abs(x-cx)<=25e-2 AND abs(y-cy)<=25e-2 AND abs(z-cz)<=25e-2)"
_KEPT = f"""{_CENTRE}, {_BOX}, k AS (SELECT lin_id, count(*) AS n_near, count_if(far <= 125e-3) AS n_local, count_if(nx > 0)/count(*) AS positive, count(*) AS n_surface FROM b GROUP BY 1
HAVING count_if(far <= 125e-3) >= 2 AND count_if(nx > 0)/count(*) BETWEEN 1e-1 AND 9e-1)"""


@query(f", {_KEPT} SELECT lin_id, n_near, CAST(n_local AS BIGINT) AS n_local, positive, n_surface FROM k", "epts")
def training_voxels(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    samples = points.select(F.col("vec_id").alias("sid"), "x", "y", "z", F.col("nx").alias("sdf"))
    return sample.training_voxels(samples, points.select(F.col("vec_id").alias("pid"), "x", "y", "z"), EPTS, 2.0, 2, 0.1, 0.9)


@query(f", {_KEPT} SELECT lin_id, vec_id AS sid, {', '.join(f'round(({c}-c{c})/25e-2,6)+0e0 AS {c}' for c in 'xyz')}, round(nx/25e-2,6)+0e0 AS sdf FROM b WHERE lin_id IN (SELECT lin_id FROM k)", "epts")
def training_records(spark, sf_dir):
    """The training voxels' samples, relative to their centres and in cells."""
    points = views.epts(spark, sf_dir)
    samples = points.select(F.col("vec_id").alias("sid"), "x", "y", "z", F.col("nx").alias("sdf"))
    kept = sample.training_voxels(samples, points.select(F.col("vec_id").alias("pid"), "x", "y", "z"), EPTS, 2.0, 2, 0.1, 0.9)
    found = sample.training_records(kept, samples, EPTS, 2.0)
    return found.select("lin_id", "sid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "z", "sdf")])


@query(
    """SELECT o_orderkey, (row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey)-1)//64 AS batch FROM orders
QUALIFY batch < (SELECT count(*)//64 FROM orders)"""
)
def shuffled_batches(spark, sf_dir):
    """Orders in shuffled batches of 64; the last, partial one is dropped."""
    from stratavox.sources.tables import read_table

    return sample.batches(read_table(spark, sf_dir, "orders"), "o_orderkey", 64).select("o_orderkey", "batch")


@query(
    """, s AS (SELECT *, label < 5 AS on_ FROM epts), t AS (SELECT *, sqrt(y*y+z*z+x*x) AS n FROM s)
SELECT round(avg(CASE WHEN on_ THEN abs(x) ELSE 0e0 END)*2e0,6) AS sdf_in, round(avg(CASE WHEN on_ THEN 0e0 ELSE exp(-1e2*abs(x)) END)*3e0,6) AS sdf_out,
 round(avg(CASE WHEN on_ THEN 1-(y*nx+z*ny+x*nz)/(n*sqrt(nx*nx+ny*ny+nz*nz)) ELSE 0e0 END)*4e0,6) AS normal, round(avg(abs(n-1))*5e0,6) AS eikonal FROM t""",
    "epts",
)
def siren_loss(spark, sf_dir):
    points = views.epts(spark, sf_dir)
    normal = tuple(F.when(F.col("label") < 5, F.col(c)).otherwise(0.0) for c in ("nx", "ny", "nz"))
    terms = geo.siren_terms(F.col("x"), geo.vec("y", "z", "x"), normal)
    weights = {"sdf_in": 2.0, "sdf_out": 3.0, "normal": 4.0, "eikonal": 5.0}
    return points.agg(*[F.round(F.avg(terms[n]) * w, 6).alias(n) for n, w in weights.items()])


_WIDE = ", ".join(f"round((min({c})+max({c}))/2-(max({c})-min({c})+1e-1)/2,6)+0e0 AS min_{c}, round((min({c})+max({c}))/2+(max({c})-min({c})+1e-1)/2,6)+0e0 AS max_{c}" for c in "xyz")


@query(f"SELECT {_WIDE} FROM epts WHERE vec_id < (SELECT count(*)//3*3 FROM epts) AND vec_id//3%2=0", "epts")
def bbox_expanded(spark, sf_dir):
    """The widened box of the vertices that every other triangle uses."""
    faces = views.tri(spark, sf_dir).where("tri_id % 2 = 0").select(F.explode(F.array(*[F.col("tri_id") * 3 + k for k in range(3)])).alias("vec_id"))
    found = mesh.bounding_box(views.epts(spark, sf_dir), faces, "vec_id", 0.1)
    return found.select(*[(F.round(c, 6) + 0.0).alias(c) for c in found.columns])


@query("SELECT count(*) AS names, round(avg(m),6) AS mean_of_means, round(sum(m),6) AS sum_of_means FROM (SELECT avg(value) AS m FROM frames WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type)", "frames")
def meter_overall(spark, sf_dir):
    """The meters' mean: the mean and the sum of all names' means."""
    found = reduce.overall(views.frames(spark, sf_dir), "event_type", "value")
    return found.select("names", r6("mean_of_means", F.col("mean")), r6("sum_of_means", F.col("total")))
