"""Queries of the online loop: the stream of key-frames into latents and meshes, and the tracker against the decoded map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions import geometry as geo
from stratavox.functions import heads, mlp
from stratavox.operators import distance, image, learn, mesh
from stratavox.plans import views
from stratavox.plans.mapping import _FACES, _ID, _MOVED, _V, EPTS, R, TURN, _stitched, _voxels
from stratavox.plans.registered import query
from stratavox.sources.shared import fresh_path
from stratavox.sources.tables import workers_find_package
from stratavox.streaming.fusion import Fusion, Meshing

#: Observations from which on a voxel takes no more and is optimised, and those beyond which it is meshed.
FREEZE, MESHED = 18, 3

_OFFSETS = "o AS (SELECT p.v AS ox, q.v AS oy, r.v AS oz FROM (VALUES (-5e-1),(5e-1)) p(v), (VALUES (-5e-1),(5e-1)) q(v), (VALUES (-5e-1),(5e-1)) r(v))"


def _around(cells: str, faces: str) -> str:
    part = lambda c, d: f"least(greatest({c}+{d},0),7)"
    return f"SELECT DISTINCT CAST({part('(lin_id%8)', 'dz')}+8*{part('(lin_id//8%8)', 'dy')}+64*{part('(lin_id//64)', 'dx')} AS BIGINT) AS lin_id FROM {cells} d, {faces}"


def _batch(k: int) -> str:
    """DuckDB text of the state ``s{k}`` after batch ``k``, from ``s{k-1}``."""
    before, mine = f"s{k - 1}", f"vec_id % 3 = {k}"
    merged = ", ".join(f"CASE WHEN n > 0 THEN (l{c}*obs_count+s{c})/(obs_count+n) ELSE l{c} END AS l{c}" for c in "xyz")
    return f"""c{k} AS (SELECT DISTINCT {_ID} AS lin_id FROM epts WHERE {mine}), u{k} AS (SELECT lin_id FROM c{k} WHERE lin_id NOT IN (SELECT lin_id FROM {before})),
f{k} AS (SELECT lin_id FROM ({_around(f"u{k}", _FACES)}) WHERE lin_id NOT IN (SELECT lin_id FROM {before})),
a{k} AS (SELECT * FROM {before} UNION ALL SELECT lin_id, 0e0, 0e0, 0e0, 0e0, false FROM f{k}),
g{k} AS (SELECT x, y, z, {_MOVED} FROM epts, o WHERE {mine}),
d{k} AS (SELECT gz+8*gy+64*gx AS lin_id, count(*) AS n, sum((x+1e0)/25e-2-gx-5e-1) AS sx, sum((y+1e0)/25e-2-gy-5e-1) AS sy, sum((z+1e0)/25e-2-gz-5e-1) AS sz FROM g{k} GROUP BY 1),
m{k} AS (SELECT lin_id, obs_count+n AS obs_count, {merged}, optimized, obs_count+n >= {FREEZE}e0 AND NOT optimized AND lin_id > 0 AS due
 FROM (SELECT a{k}.*, coalesce(n, 0) AS n, sx, sy, sz FROM a{k} LEFT JOIN d{k} ON d{k}.lin_id = a{k}.lin_id AND obs_count < {FREEZE}e0)),
s{k} AS (SELECT lin_id, {", ".join(f"CASE WHEN due THEN l{c}/2 ELSE l{c} END AS l{c}" for c in "xyz")}, obs_count, optimized OR due AS optimized FROM m{k})"""


_STATE = f", {_OFFSETS}, s AS (SELECT CAST(0 AS BIGINT) AS lin_id, 0e0 AS lx, 0e0 AS ly, 0e0 AS lz, 0e0 AS obs_count, false AS optimized WHERE false), " + ", ".join(_batch(k) for k in range(3)).replace("s-1", "s")


def _decode(rows: DataFrame) -> DataFrame:
    d = [F.col(c) - F.col("latent")[k] for k, c in enumerate("xyz")]
    return rows.withColumns({"sdf": F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) - 0.4, "std": 0.05 + 0.1 / F.col("obs_count")})


def _played(spark, sf_dir, meshing: Meshing | None = None) -> Fusion:
    """The points as a stream of three batches, dealt by their ids; a latent is the mean place of a voxel's points, halved when it is optimised."""
    work = fresh_path(spark, "fusion")
    points = views.epts(spark, sf_dir).select("vec_id", "x", "y", "z")
    for k in range(3):
        points.where(F.col("vec_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{work}/source")
    halved = lambda due, _: due.withColumn("latent", F.transform("latent", lambda v: v / 2))
    fusion = Fusion(EPTS, work, 3, lambda rows: rows.withColumn("latent", F.array("rx", "ry", "rz")), FREEZE, halved, FREEZE, meshing=meshing, edge=4)
    fusion.play(spark, f"{work}/source", points.schema.simpleString()[7:-1].replace(":", " "))
    return fusion


@query(f"{_STATE} SELECT lin_id, obs_count, {', '.join(f'round(l{c},6)+0e0 AS l{c}' for c in 'xyz')}, optimized FROM s2", "epts")
def stream_latent_state(spark, sf_dir):
    """The voxels' latents after a stream of three key-frames: admitted with their neighbours, merged while open, optimised once."""
    found = _played(spark, sf_dir).state(spark)
    return found.select("lin_id", "obs_count", *[(F.round(F.col("latent")[k], 6) + 0.0).alias(f"l{c}") for k, c in enumerate("xyz")], "optimized")


_TABLE = ", ".join(f"({case},{','.join(str(mesh.EDGES[e][s]) for e in t for s in (0, 1))})" for case, found in enumerate(mesh.triangle_table()) for t in found)
_AT = {c: f"[{','.join(str(o[k]) + 'e0' for o in mesh.CORNERS)}]" for k, c in enumerate("xyz")}


def _vertex(c: str, a: str, b: str) -> str:
    """DuckDB text of one coordinate of the vertex on the edge from corner ``a`` to corner ``b``."""
    p, q = (f"(({dict(x='i', y='j', z='k')[c]}+{_AT[c]}[{e}+1])*625e-4-1e0)" for e in (a, b))
    u, v = f"v[{a}+1]", f"v[{b}+1]"
    return f"CASE WHEN abs({u}) < 1e-5 THEN {p} WHEN abs({v}) < 1e-5 THEN {q} WHEN abs({u}-{v}) < 1e-5 THEN {p} ELSE {p}-{u}/({v}-{u})*({q}-{p}) END"


_CUBES = f"""q AS (SELECT f.i-o.a AS i, f.j-o.b AS j, f.k-o.c AS k, sum(CASE WHEN sdf < 0 THEN 1 << o.n ELSE 0 END) AS code, list(sdf ORDER BY o.n) AS v
 FROM f, (VALUES {", ".join(f"({n},{a},{b},{c})" for n, (a, b, c) in enumerate(mesh.CORNERS))}) AS o(n,a,b,c) GROUP BY 1,2,3 HAVING count(*) = 8),
h AS (SELECT CAST(k//4+8*(j//4)+64*(i//4) AS BIGINT) AS lin_id, {", ".join(f"({_vertex(c, 'a0', 'b0')})+({_vertex(c, 'a1', 'b1')})+({_vertex(c, 'a2', 'b2')}) AS s{c}" for c in "xyz")}
 FROM q JOIN (VALUES {_TABLE}) AS p(code,a0,b0,a1,b1,a2,b2) ON p.code = q.code WHERE i >= 0 AND j >= 0 AND k >= 0)"""
_LATTICE = f"""m AS (SELECT * FROM s2 WHERE obs_count > {MESHED}e0),
l AS (SELECT *, sqrt((px-lx)*(px-lx)+(py-ly)*(py-ly)+(pz-lz)*(pz-lz))-4e-1 AS sdf, 5e-2+1e-1/obs_count AS std FROM (SELECT *, i*25e-2-1e0 AS px, j*25e-2-1e0 AS py, k*25e-2-1e0 AS pz FROM m, range(8) a(i), range(8) b(j), range(8) c(k)))"""


@query(
    f"""{_STATE}, {_LATTICE}, {_stitched('l')}, {_CUBES} SELECT lin_id, count(*) AS n, {", ".join(f"round(sum(s{c}),4)+0e0 AS sum_{c}" for c in "xyz")} FROM h GROUP BY 1""",
    "epts",
)
def stream_mesh(spark, sf_dir):
    """The mesh cache after a stream of three key-frames, of which each replaced only the triangles around what it changed: each voxel's triangles and the sum of their vertices."""
    fusion = _played(spark, sf_dir, Meshing(R, _decode, MESHED))
    total = lambda c: F.sum(F.aggregate("v", F.lit(0.0), lambda a, p: a + p[c]))
    return fusion.mesh(spark).groupBy("lin_id").agg(F.count("*").alias("n"), *[(F.round(total(c), 4) + 0.0).alias(f"sum_{c}") for c in "xyz"])


#: The motion from the previous camera that the tracker's step is taken at, and the previous camera's place.
DELTA = [[0.8, -0.6, 0.0, 0.02], [0.6, 0.8, 0.0, -0.03], [0.0, 0.0, 1.0, 0.01]]
BEHIND = [0.05, -0.02, 0.04]
_HIDDEN = 8


def small_decoder() -> heads.Decoder:
    """One hidden layer over three latents and a place, with synthetic weights."""
    body, ends = mlp.synthetic([6, _HIDDEN]), mlp.synthetic([_HIDDEN, 2])[0]
    return heads.Decoder(body, mlp.Layer(ends.weight[:1], ends.bias[:1]), mlp.Layer(ends.weight[1:], ends.bias[1:]))


def _moved(names: str, rows: list[list[float]], out: str) -> str:
    return ", ".join(f"{names}x*({r[0]}e0)+{names}y*({r[1]}e0)+{names}z*({r[2]}e0)+({r[3]}e0) AS {out}{c}" for r, c in zip(rows, "xyz", strict=True))


_WEIGHT = "((7*i+3*{j})%11-5)/10e0"
_HEAD = "list_dot_product(list_transform(range({n}), lambda j: ((7*{i}+3*j)%11-5)/10e0), list_transform(h, lambda a: greatest(a, 0e0)))+({i}-2)/10e0"
_SLOPE = "list_sum(list_transform(range({n}), lambda i: CASE WHEN h[i+1] > 0 THEN (3*i%11-5)/10e0*{w} ELSE 0e0 END))"
_HS = [f"h{a}{b}" for a in range(6) for b in range(a, 6)]
_SUMS = ", ".join([f"round(avg(w*j{h[1]}*j{h[2]}),5)+0e0 AS {h}" for h in _HS] + [f"round(avg(w*j{k}*f),5)+0e0 AS g{k}" for k in range(6)])
_POSE_STEP = f""", {_V}, a1 AS (SELECT {_moved("", DELTA, "p")} FROM epts), a2 AS (SELECT *, {_moved("p", [[*r, t] for r, t in zip(TURN, BEHIND, strict=True)], "w")} FROM a1),
a3 AS (SELECT *, ceil((wx+1e0)/25e-2)-1 AS cx, ceil((wy+1e0)/25e-2)-1 AS cy, ceil((wz+1e0)/25e-2)-1 AS cz FROM a2 WHERE wx > -1 AND wx <= 1 AND wy > -1 AND wy <= 1 AND wz > -1 AND wz <= 1),
a4 AS (SELECT px, py, pz, [lx, ly, lz, (wx+1e0)/25e-2-cx-5e-1, (wy+1e0)/25e-2-cy-5e-1, (wz+1e0)/25e-2-cz-5e-1] AS u FROM a3 JOIN v ON lin_id = CAST(cz+8*cy+64*cx AS BIGINT)),
a5 AS (SELECT *, list_transform(range({_HIDDEN}), lambda i: list_dot_product(list_transform(range(6), lambda j: {_WEIGHT.format(j="j")}), u)+(i%5-2)/10e0) AS h FROM a4),
a6 AS (SELECT *, tanh({_HEAD.format(n=_HIDDEN, i=0)}) AS sdf, 5e-2+ln(1+exp({_HEAD.format(n=_HIDDEN, i=1)}))/2 AS std FROM a5),
a7 AS (SELECT *, sdf/std AS f, {", ".join(f"(1-sdf*sdf)*{_SLOPE.format(n=_HIDDEN, w=_WEIGHT.format(j=3 + k))}/25e-2 AS g{c}" for k, c in enumerate("xyz"))} FROM a6),
a8 AS (SELECT *, {", ".join(f"(gx*({TURN[0][k]}e0)+gy*({TURN[1][k]}e0)+gz*({TURN[2][k]}e0))/std AS j{k}" for k in range(3))}, CASE WHEN abs(f) > 1e0 THEN 1e0/abs(f) ELSE 1e0 END AS w FROM a7),
a9 AS (SELECT *, py*j2-pz*j1 AS j3, pz*j0-px*j2 AS j4, px*j1-py*j0 AS j5 FROM a8)
SELECT count(*) AS m, {_SUMS}, round(avg(w*f*f),5) AS e FROM a9"""


@query(_POSE_STEP, "epts")
def distance_step(spark, sf_dir):
    """One step's sums of the distance term: points moved into the map, decoded with their voxel's latent, and the network's gradient as the pose's Jacobian."""
    workers_find_package(spark)
    points = views.epts(spark, sf_dir)
    voxels = _voxels(points).select("lin_id", F.array("lx", "ly", "lz").alias("latent"), "obs_count")
    previous, delta = np.eye(4), np.vstack([np.array(DELTA), [0, 0, 0, 1]])
    previous[:3, :3], previous[:3, 3] = TURN, BEHIND
    rows = distance.Field(EPTS, voxels, small_decoder()).residuals(points.select("x", "y", "z"), previous, delta, lambda f: geo.huber_weight(f, 1.0))
    found = image.normal_equations(rows)
    return found.select("m", *[(F.round(c, 5) + 0.0).alias(c) for c in found.columns if c != "m"])


_CODE = ", ".join(f"avg({'+'.join(f'{u}*({((7 * i + 3 * j) % 11 - 5) / 10}e0)' for j, u in enumerate(('rx', 'ry', 'rz', 'nx', 'ny', 'nz')))}+({(i % 5 - 2) / 10}e0)) AS l{i}" for i in range(3))
_TRAIN_STEP = f""", b1 AS (SELECT {_ID} AS lin_id, {", ".join(f"(({c}+1e0)/25e-2-(ceil(({c}+1e0)/25e-2)-1)-5e-1) AS r{c}" for c in "xyz")}, nx, ny, nz FROM epts),
b2 AS (SELECT lin_id, {_CODE} FROM b1 GROUP BY 1),
b3 AS (SELECT greatest(least(nx*2e-1,1e-1),-1e-1) AS goal, [l0, l1, l2, rx, ry, rz] AS u, sqrt(l0*l0+l1*l1+l2*l2) AS far FROM b1 JOIN b2 USING (lin_id)),
b4 AS (SELECT *, list_transform(range({_HIDDEN}), lambda i: list_dot_product(list_transform(range(6), lambda j: {_WEIGHT.format(j="j")}), u)+(i%5-2)/10e0) AS h FROM b3),
b5 AS (SELECT *, {_HEAD.format(n=_HIDDEN, i=0)} AS d, {_HEAD.format(n=_HIDDEN, i=1)} AS s FROM b4),
b6 AS (SELECT *, greatest(least(tanh(d),1e-1),-1e-1)-goal AS error, 5e-2+ln(1+exp(s))/2 AS std FROM b5),
b7 AS (SELECT *, CASE WHEN abs(tanh(d)) <= 1e-1 THEN error/(std*std)*(1-tanh(d)*tanh(d)) ELSE 0e0 END AS bd, (1/std-error*error/(std*std*std))/(1+exp(-s))/2 AS bs FROM b6),
b8 AS (SELECT 'distance' AS part, i, avg(bd*CASE WHEN i < {_HIDDEN} THEN greatest(h[i+1], 0e0) ELSE 1e0 END) AS g FROM b7, range({_HIDDEN + 1}) t(i) GROUP BY ALL
 UNION ALL SELECT 'deviation', i, avg(bs*CASE WHEN i < {_HIDDEN} THEN greatest(h[i+1], 0e0) ELSE 1e0 END) FROM b7, range({_HIDDEN + 1}) t(i) GROUP BY ALL
 UNION ALL SELECT 'loss', 0, avg(error*error/(2*std*std)+ln(std)+ln(2*pi())/2+5e-3*far) FROM b7)
SELECT part, CAST(i AS BIGINT) AS place, round(g,5)+0e0 AS g FROM b8"""


def training_rows(spark, sf_dir) -> DataFrame:
    """Every point as a sample and a surface point of its voxel, its place relative to it."""
    cells = EPTS.cells(views.epts(spark, sf_dir))
    places = [((F.col(c) + 1.0) / 0.25 - F.col(f"g{c}") - 0.5).alias(c) for c in "xyz"]
    return cells.select("lin_id", *places, "nx", "ny", "nz", (F.col("nx") * 0.2).alias("sdf"))


@query(_TRAIN_STEP, "epts")
def training_gradient(spark, sf_dir):
    """The first training step's loss, and its gradient by the weights and biases of both heads: samples met latents pooled from surface points."""
    workers_find_package(spark)
    rows = training_rows(spark, sf_dir)
    trainer = learn.Trainer(small_decoder(), mlp.synthetic([6, 3]), (lambda e: 0.01, lambda e: 0.01), learn.Loss(0.1, 0.5, 100))
    by_decoder, _, loss = trainer.gradients(rows, rows, 1)
    ends = by_decoder[-2 * (_HIDDEN + 1) :].reshape(2, -1).tolist()
    found = [(name, k, g) for name, values in zip(("distance", "deviation"), ends, strict=True) for k, g in enumerate(values)] + [("loss", 0, loss)]
    return spark.createDataFrame(found, "part string, place long, g double").withColumn("g", F.round("g", 5) + 0.0)
