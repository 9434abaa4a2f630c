"""op11 against brute force: codes, errors and codebooks with plain loops over integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.llm import registry, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Codebooks and {row number: (code, error)} by full search."""
    kept = [(k, i, [math.floor(256 * float(np.float32(x))) for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, _, v in kept if len(v) % parts == 0), default=0)
    kept = [r for r in kept if len(r[2]) == longest]
    width = longest // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    ids = sorted({i for _, i, _ in kept if i is not None})[:entries]
    books = [[cut(min(v for _, j, v in kept if j == i))[p] for i in ids] for p in range(parts)]

    def assign():
        found = {}
        for k, _, v in kept:
            best = [min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), n) for n, e in enumerate(books[p])) for p, x in enumerate(cut(v))]
            found[k] = best
        return found

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for n in range(len(ids)):
                own = [cut(v)[p] for k, _, v in kept if found[k][p][1] == n]
                if own:
                    books[p][n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return books, {k: ("".join(f"{n:02x}" for _, n in x), sum(d for d, _ in x)) for k, x in assign().items()}


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def hostile(n=150, length=32, seed=5):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([rnd.gauss(0, 0.2), 0.0, -0.0, 0.5]) for _ in range(length)], rnd.choice([0, 0, 0, 1, None])) for i in range(n)]
    rows += [(None, [0.1] * length, 1), (7, rows[7][1], 2), (7, [-1.0] * length, 2), (900, rows[0][1], None)] + [(901 + i, [0.25] * length, 9) for i in range(40)]
    rows += [(-5, None, 1), (-4, [None] + [0.0] * (length - 1), 1), (-3, [float("nan")] * length, 0), (-2, [float("inf")] + [0.0] * (length - 1), 0), (-1, [0.5] * 17, 0), (-6, [], 0), (-7, [0.5] * 16, 0)]
    rnd.shuffle(rows)
    return rows


def test_codes_equal_brute_force(spark):
    rows = hostile()
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", row int").repartition(5).withColumn("code", F.lit(3)).withColumn("error", F.lit("x"))
    books = vectors.fit(df)
    want, codes = brute(rows)
    assert books.entries.tolist() == want
    assert books.sha256() == digest(want)
    found = {r.row: (r.code, r.error) for r in vectors.encode(df, books).collect()}
    assert found == codes


def test_query_equals_brute_force(spark, tmp_path):
    rows = hostile(90, 16, 8)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    books, codes = brute(rows)
    sums = {}
    for k, (_, error) in codes.items():
        sums[rows[k][2]] = sums.get(rows[k][2], 0) + error
    want = sorted((str(rows[k][0]), code, error, sums[rows[k][2]], digest(books)) for k, (code, error) in codes.items())
    found = registry.QUERIES["op11_vectors"](spark, str(tmp_path))
    assert found.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()) == want


def test_empty_tables_and_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    books = vectors.fit(none)
    assert books.entries.shape == (16, 0, 0) and books.sha256() == hashlib.sha256(b"").hexdigest()
    assert vectors.encode(none, books).count() == 0
    only = spark.createDataFrame([(1, [], 0), (2, [], 0), (3, None, 0)], SCHEMA)
    books = vectors.fit(only)
    assert {r.vec_id: (r.code, r.error) for r in vectors.encode(only, books).collect()} == {1: ("00" * 16, 0), 2: ("00" * 16, 0)}


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 16])
def test_bounds_drop_no_nearest_entry(width):
    rnd = np.random.default_rng(width)
    for scale in (3, 300, 1 << 26):
        entries = rnd.integers(-scale, scale, (64, width))
        entries[5] = entries[3]
        x = np.concatenate([rnd.integers(-scale, scale, (500, width)), entries, entries + rnd.integers(-1, 2, (64, width))])
        distance = ((x[:, None] - entries) ** 2).sum(2)
        cols, least, _ = vectors.SegmentMeans(entries).nearest(x)
        assert (cols == distance.argmin(1)).all() and (least == distance.min(1)).all()


def test_bounds_leave_few_exact_distances():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-60, 60, (2000, 4))
    _, _, computed = vectors.SegmentMeans(x[:64]).nearest(x)
    assert computed < 0.3 * 64 * len(x)


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(32)], 0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    books = vectors.fit(df, entries=8)
    for r in vectors.decode(vectors.encode(df, books), books).collect():
        steps = [math.floor(256 * x) - round(256 * y - 0.5) for x, y in zip(r.embedding, r.vector, strict=True)]
        assert sum(s * s for s in steps) == r.error


def test_sums_by_key_with_and_without_heavy_keys(spark):
    rows = [(i, i % 7 if i % 3 else None, i) for i in range(400)] + [(1000 + i, 1000 + i // 2, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, label int, error long")
    want = {}
    for _, label, error in rows:
        want[label] = want.get(label, 0) + error
    found = vectors.with_sums(df, "error", "label", "total").collect()
    assert len(found) == len(rows) and all(r.total == want[r.label] for r in found)
