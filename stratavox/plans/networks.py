"""Queries of the networks over points: encoders, decoders, and latents under optimisation. Weights are made by a rule, so DuckDB can say them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratavox.functions import augment, heads, mlp, motion
from stratavox.functions import geometry as geo
from stratavox.operators import grid, latent, reduce, scan
from stratavox.plans import views
from stratavox.plans.registered import query
from stratavox.sources.tables import workers_find_package

INPUTS = ["x", "y", "z", "nx", "ny", "nz"]
ENCODER = [6, 32, 64, 256, 29]
DECODER = [32, 128, 128, 96, 128]
EPTS = grid.Grid((-1.0, -1.0, -1.0), 0.25, (8, 8, 8))

_X = "e0 AS (SELECT vec_id, [x,y,z,nx,ny,nz] AS h FROM epts)"


def _layer(name: str, before: str, n_in: int, n_out: int, value: str, again: str | None = None, first: int = 0) -> str:
    """DuckDB text of one dense layer: ``value`` says what comes of the weighted sum ``s`` and the bias ``b`` of output ``i``."""
    h = "h" if again is None else f"list_concat(h, {again})"
    keep = "" if again is None else f", any_value({again}) AS {again}"
    w = f"list_transform(range({n_in}), lambda j: ((7*i+3*j)%11-5)/10e0)"
    return (
        f"{name}w AS (SELECT i-{first} AS i, {w} AS w, (i%5-2)/10e0 AS b FROM range({first},{first + n_out}) t(i)), "
        f"{name} AS (SELECT vec_id{keep}, list({value.format(s=f'list_dot_product(w, {h})')} ORDER BY i) AS h FROM {before}, {name}w GROUP BY vec_id)"
    )


def _encoder(inner: str) -> str:
    last = len(ENCODER) - 2
    parts = [_layer(f"e{k + 1}", f"e{k}", ENCODER[k], ENCODER[k + 1], "{s}+b" if k == last else inner) for k in range(last + 1)]
    return ", ".join([_X, *parts])


_PLAIN = _encoder("greatest({s}+b, 0e0)")
_NORM = "greatest(({s}-(i%5-2)/10e0)/sqrt(1e0+(i%7)/10e0+1e-5)*(1e0+(i%3)/10e0)+(i%4-1)/10e0, 0e0)"
_FROM = "d0 AS (SELECT vec_id, list_concat(e4.h, [x,y,z]) AS h, list_concat(e4.h, [x,y,z]) AS x0 FROM e4 JOIN epts USING (vec_id))"


def _decoder(inner: str) -> str:
    parts, n_in = [], DECODER[0]
    for k, n_out in enumerate(DECODER[1:]):
        keeps = _layer(f"d{k + 1}", f"d{k}", n_in + (DECODER[0] if k == 3 else 0), n_out, inner, "x0" if k == 3 else None)
        parts.append(keeps if k == 3 else keeps.replace("SELECT vec_id, list(", "SELECT vec_id, any_value(x0) AS x0, list("))
        n_in = n_out
    return ", ".join([_FROM, *parts])


_EXPLODED = "SELECT vec_id, CAST(i AS INTEGER) AS dim, round(h[i+1],6)+0e0 AS value FROM e4, range(29) t(i)"


def _encoded(spark, sf_dir):
    return mlp.encode(views.epts(spark, sf_dir), INPUTS, mlp.synthetic(ENCODER))


def _exploded(df):
    return df.select("vec_id", F.posexplode("latent").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query(f", {_PLAIN} {_EXPLODED}", "epts")
def mlp_encode(spark, sf_dir):
    workers_find_package(spark)
    return _exploded(_encoded(spark, sf_dir))


_HEADS = "list_dot_product(h, list_transform(range({n}), lambda j: ((7*{i}+3*j)%11-5)/10e0))+({i}%5-2)/10e0"
_OUT = (
    f"y AS (SELECT vec_id, {_HEADS.format(n=128, i=0)} AS a, {_HEADS.format(n=128, i=1)} AS b FROM d4) "
    "SELECT vec_id, round(tanh(a),6)+0e0 AS sdf, round(5e-2+(greatest(b,0e0)+ln(1e0+exp(-abs(b))))/2e0,6) AS std FROM y"
)


@query(f", {_PLAIN}, {_decoder('greatest({s}+b, 0e0)')}, {_OUT}", "epts")
def mlp_decode(spark, sf_dir):
    workers_find_package(spark)
    found = mlp.decode(_encoded(spark, sf_dir), "latent", ["x", "y", "z"], mlp.synthetic([*DECODER, 2], (3,)))
    return found.select("vec_id", (F.round("sdf", 6) + 0.0).alias("sdf"), F.round("std", 6).alias("std"))


def normed_encoder() -> list[mlp.Layer]:
    """The encoder with batch norms of made-up statistics after all layers but the last; those before a norm have no bias."""
    layers = mlp.synthetic(ENCODER)
    for k, layer in enumerate(layers[:-1]):
        i = np.arange(len(layer.bias))
        bare = mlp.Layer(layer.weight, np.zeros(len(i)))
        layers[k] = heads.batch_normed(bare, 1 + i % 3 / 10, (i % 4 - 1) / 10, (i % 5 - 2) / 10, 1 + i % 7 / 10)
    return layers


@query(f", {_encoder(_NORM)} {_EXPLODED}", "epts")
def encoder_normed(spark, sf_dir):
    """The encoder with batch norms, a latent for each point."""
    workers_find_package(spark)
    return _exploded(mlp.encode(views.epts(spark, sf_dir), INPUTS, normed_encoder()))


@query(f", {_encoder(_NORM)} SELECT label, CAST(i AS INTEGER) AS dim, round(avg(h[i+1]),6)+0e0 AS value FROM e4 JOIN epts USING (vec_id), range(29) t(i) GROUP BY 1, 2", "epts")
def encoder_pooled(spark, sf_dir):
    """The same encoder pooled: one mean latent for each label."""
    workers_find_package(spark)
    coded = mlp.encode(views.epts(spark, sf_dir), INPUTS, normed_encoder())
    found = reduce.group_vectors(coded.select("label", "latent"), "label", "latent", ENCODER[-1], "avg")
    return found.select("label", F.posexplode("latent").alias("dim", "value")).withColumn("value", F.round("value", 6) + 0.0)


def two_heads() -> heads.Decoder:
    """A decoder whose body's weight rows have lengths 1, 1.5 and 2 by turns."""
    body = [heads.weight_normed(layer, 1 + np.arange(len(layer.bias)) % 3 / 2) for layer in mlp.synthetic(DECODER, (3,))]
    ends = mlp.synthetic([DECODER[-1], 2])[0]
    one = lambda k: mlp.Layer(ends.weight[k : k + 1], ends.bias[k : k + 1])
    return heads.Decoder(body, one(0), one(1))


@query(f", {_PLAIN}, {_decoder('greatest({s}*(1e0+(i%3)/2e0)/sqrt(list_dot_product(w, w))+b, 0e0)')}, {_OUT}", "epts")
def decode_two_heads(spark, sf_dir):
    """Signed distances and deviations by the weight-normed decoder, at most 100 rows at a time through the network."""
    workers_find_package(spark)
    found = heads.decode(_encoded(spark, sf_dir), "latent", ["x", "y", "z"], two_heads(), 100)
    return found.select("vec_id", (F.round("sdf", 6) + 0.0).alias("sdf"), F.round("std", 6).alias("std"))


@query()
def latent_optimise(spark, sf_dir):
    """Mean loss of five steps on the latents of all voxels, from points moved off the surface: (step, loss)."""
    workers_find_package(spark)
    points = views.epts(spark, sf_dir)
    samples = EPTS.cells(latent.off_surface(points, "vec_id"))
    start = samples.select("lin_id").distinct().withColumn("latent", F.array_repeat(F.lit(0.1), 5))
    small = mlp.synthetic([8, 16, 16])
    ends = mlp.synthetic([16, 2])[0]
    decoder = heads.Decoder(small, mlp.Layer(ends.weight[:1] / 8, ends.bias[:1]), mlp.Layer(ends.weight[1:] / 8, ends.bias[1:]))
    _, losses = latent.optimise(samples, start, decoder, 5, 5, decay=1e-4)
    return spark.createDataFrame([(k + 1, float(x)) for k, x in enumerate(losses)], "step int, loss double")


def _seeded(name: str) -> str:
    return f"CAST('0x'||substr(md5(CAST(label AS VARCHAR)||':{name}'),1,8) AS BIGINT)/4294967296e0"


@query(
    f", t AS (SELECT *, floor({_seeded('quarter')}*4)*(pi()/2)+{_seeded('jitter')}*(pi()/6) AS a FROM epts) "
    "SELECT vec_id, round(x*cos(a)+z*sin(a),6)+0e0 AS x, round(y,6)+0e0 AS y, round(z*cos(a)-x*sin(a),6)+0e0 AS z FROM t",
    "epts",
)
def rotation_augment(spark, sf_dir):
    """Points turned about the y axis by a quarter turn or several and up to 30 degrees more, by a hash of the label."""
    p = augment.turned(geo.vec("x", "y", "z"), F.col("label"), "y")
    return views.epts(spark, sf_dir).select("vec_id", *[(F.round(x, 6) + 0.0).alias(c) for x, c in zip(p, "xyz", strict=True)])


@query(
    """, g AS (SELECT vec_id, x/sqrt(x*x+y*y+z*z) AS a0, y/sqrt(x*x+y*y+z*z) AS a1, z/sqrt(x*x+y*y+z*z) AS a2, nx, ny, nz FROM epts),
h AS (SELECT *, nx-(a0*nx+a1*ny+a2*nz)*a0 AS c0, ny-(a0*nx+a1*ny+a2*nz)*a1 AS c1, nz-(a0*nx+a1*ny+a2*nz)*a2 AS c2 FROM g),
k AS (SELECT *, c0/sqrt(c0*c0+c1*c1+c2*c2) AS b0, c1/sqrt(c0*c0+c1*c1+c2*c2) AS b1, c2/sqrt(c0*c0+c1*c1+c2*c2) AS b2 FROM h)
SELECT vec_id, round(a0,6)+0e0 AS r00, round(a1,6)+0e0 AS r10, round(a2,6)+0e0 AS r20, round(b0,6)+0e0 AS r01, round(b1,6)+0e0 AS r11, round(b2,6)+0e0 AS r21,
 round(a1*b2-a2*b1,6)+0e0 AS r02, round(a2*b0-a0*b2,6)+0e0 AS r12, round(a0*b1-a1*b0,6)+0e0 AS r22 FROM k""",
    "epts",
)
def continuous_rotation(spark, sf_dir):
    """Rotations from six numbers: the two columns made orthonormal, and their cross product."""
    rotation = motion.orthonormal(geo.vec("x", "y", "z"), geo.vec("nx", "ny", "nz"))
    return views.epts(spark, sf_dir).select("vec_id", *[(F.round(x, 6) + 0.0).alias(f"r{i}{j}") for i, row in enumerate(rotation) for j, x in enumerate(row)])


@query(
    """, r AS (SELECT event_type, frame_id, user_id % 2 AS side, row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY frame_id) AS place FROM frames)
SELECT a.event_type, a.place, a.frame_id AS first_id, b.frame_id AS second_id FROM r a JOIN r b ON a.event_type=b.event_type AND a.place=b.place AND a.side=0 AND b.side=1""",
    "frames",
)
def trajectory_difference(spark, sf_dir):
    """Edges between the frames in the same place of two trajectories (even and odd users) of each event type."""
    rows = views.frames(spark, sf_dir).select("event_type", "frame_id", (F.col("user_id") % 2).alias("side"))
    rows = scan.numbered(rows, ["event_type", "side"], "frame_id")
    first, second = (rows.where(F.col("side") == k).select("event_type", F.col("place").cast("long").alias("place"), F.col("frame_id").alias(n)) for k, n in ((0, "first_id"), (1, "second_id")))
    return first.join(second, ["event_type", "place"])


@query("SELECT tri_id, ax, ay, az, (SELECT count(*) FROM tri) > 50 AS overflow FROM tri ORDER BY tri_id LIMIT 50", "epts", "tri")
def limit_triangles_flagged(spark, sf_dir):
    """The first 50 triangles, with a flag that tells whether there were more."""
    from stratavox.operators import mesh

    return mesh.limited(views.tri(spark, sf_dir).select("tri_id", "ax", "ay", "az"), "tri_id", 50)


@query("SELECT CAST(i AS BIGINT) AS epoch FROM range(1, 301) t(i) WHERE i % 40 = 0 OR i IN (5, 70, 290)")
def snapshot_plan(spark, sf_dir):
    """Epochs of a run of 300 with a snapshot."""
    from stratavox.sources.settings import snapshot_epochs

    return spark.createDataFrame([(e,) for e in snapshot_epochs(300, 40, (5, 70, 290, 400))], "epoch long")
