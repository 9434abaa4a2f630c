"""The online map: what a stream leaves equals batches by plain Python, a batch that runs again changes nothing, and the mesh cache equals a mesh of all voxels."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from stratavox.operators import volume
from stratavox.operators.grid import Grid
from stratavox.streaming.fusion import Fusion, Meshing

GRID = Grid((0.0, 0.0, 0.0), 1.0, (5, 4, 3))
FREEZE = 12


def batches():
    rnd = random.Random(3)
    near = lambda n, at: [tuple(a + rnd.uniform(0.05, 0.95) for a in at) for _ in range(n)]
    return [near(9, (0, 0, 0)) + near(5, (1, 1, 1)), near(6, (1, 1, 1)) + near(7, (2, 1, 1)) + [(9.0, 1.0, 1.0)], near(4, (4, 3, 2)) + near(9, (0, 0, 0)), []]


def brute(parts):
    """{cell: (latent, count, optimised)} after the batches, latents as means of places, halved when optimised."""
    state = {}
    line = lambda g: g[2] + 3 * g[1] + 12 * g[0]
    inside = lambda g: all(0 <= a < n for a, n in zip(g, GRID.shape, strict=True))
    clamp = lambda g: tuple(min(max(a, 0), n - 1) for a, n in zip(g, GRID.shape, strict=True))
    for part in parts:
        cells = {}
        points = [p for p in part if inside(tuple(math.ceil(x) - 1 for x in p))]
        absent = {g for g in (tuple(math.ceil(x) - 1 for x in p) for p in points) if line(g) not in state}
        for g in absent:
            for k, d in [(0, 0), *itertools.product(range(3), (-1, 1))]:
                near = list(g)
                near[k] += d
                state.setdefault(line(clamp(near)), ([0.0] * 3, 0.0, False))
        for p in points:
            for o in itertools.product((-0.5, 0.5), repeat=3):
                g = clamp([math.ceil(x + d) - 1 for x, d in zip(p, o, strict=True)])
                cells.setdefault(line(g), []).append([x - a - 0.5 for x, a in zip(p, g, strict=True)])
        for c, rows in cells.items():
            if c in state and state[c][1] < FREEZE:
                latent, n, done = state[c]
                total = [sum(r[k] for r in rows) for k in range(3)]
                latent, n = [(a * n + t) / (n + len(rows)) for a, t in zip(latent, total, strict=True)], n + len(rows)
                if n >= FREEZE and not done and c > 0:
                    latent, done = [a / 2 for a in latent], True
                state[c] = (latent, n, done)
    return state


def decode(rows):
    d = sum(((F.col(c) - F.col("latent")[k]) * (F.col(c) - F.col("latent")[k]) for k, c in enumerate("xyz")), F.lit(0.0))
    return rows.withColumns({"sdf": F.sqrt(d) - 0.4, "std": 0.05 + 0.1 / F.col("obs_count")})


def frame(spark, part):
    return spark.createDataFrame(part, "x double, y double, z double")


def fusion(work, **more):
    return Fusion(GRID, str(work), 3, lambda rows: rows.withColumn("latent", F.array("rx", "ry", "rz")), FREEZE, lambda due, _: due.withColumn("latent", F.transform("latent", lambda v: v / 2)), FREEZE, edge=2, **more)


def held(df):
    return {r.lin_id: (pytest.approx(list(r.latent)), r.obs_count, r.optimized) for r in df.collect()}


@pytest.mark.parametrize("every", [2])
def test_stream_equals_batches_and_runs_again(spark, tmp_path, every):
    parts = batches()
    map_ = fusion(tmp_path, compact_every=every)
    for k, part in enumerate(parts):
        if part:
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    map_.play(spark, f"{tmp_path}/source", "x double, y double, z double")
    want = brute(parts)
    assert held(map_.state(spark)) == want
    assert held(map_.state(spark, 1)) == brute(parts[:1])
    map_.step(frame(spark, parts[1]), 1)
    map_.step(frame(spark, parts[2]), 2)
    assert held(map_.state(spark)) == want
    map_.step(frame(spark, []), 3)
    assert held(map_.state(spark)) == want


def test_cache_equals_a_mesh_of_all_voxels(spark, tmp_path):
    map_ = fusion(tmp_path, meshing=Meshing(2, decode, 1), compact_every=2)
    for k, part in enumerate(batches()[:3]):
        map_.step(frame(spark, part), k)
    state = map_.state(spark)
    whole = volume.dirty_mesh(state, state, GRID, 2, decode, 1, corners=True)
    said = lambda df: {(r.lin_id, r.i, r.j, r.k, r.tri_no, tuple(round(x, 9) for p in r.v for x in p)) for r in df.collect()}
    found = said(map_.mesh(spark))
    assert found and found == said(whole)
    again = found
    map_.step(frame(spark, batches()[2]), 2)
    assert said(map_.mesh(spark)) == again


def test_one_hot_cell_is_summed_before_the_shuffle(spark, tmp_path):
    points = spark.range(20000).select((0.2 + F.col("id") % 10 / 100).alias("x"), F.lit(0.3).alias("y"), F.lit(0.3).alias("z"))
    map_ = fusion(tmp_path)
    map_.step(points, 0)
    found = map_.state(spark).where("lin_id = 0").first()
    # each point comes eight times, as its cell is the grid's corner
    assert found.obs_count == 160000 and found.latent[0] == pytest.approx(0.245 - 0.5)
