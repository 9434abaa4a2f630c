"""Spatial joins over grid buckets: radius, k nearest, box ranges; outliers, normals and sign votes built on them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.functions.geometry import dot, sub, vec, with_smallest_eigenvector
from stratavox.operators.scan import placed
from stratavox.sources.shared import settle

_AXES = "xyz"


def _buckets(c: Column, edge: float) -> Column:
    return F.floor(c / edge).cast("long")


def near_pairs(queries: DataFrame, points: DataFrame, radius: float, chebyshev: bool = False) -> DataFrame:
    """All (``qid``, ``pid``, ``d2``) within ``radius``: queries (qid, x, y, z) against points (pid, x, y, z).

    The box predicate becomes an equi-join: a query is repeated for the 27
    buckets of edge ``radius`` around it, so each pair meets in exactly one. The
    squared distance is strict for the Euclidean metric, inclusive for the other;
    rows with NaN meet nothing.
    """
    clean = lambda d: d.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    left = clean(queries).withColumnsRenamed({c: f"q{c}" for c in _AXES})
    around = [F.struct(*[(_buckets(F.col(f"q{c}"), radius) + o).alias(f"b{c}") for c, o in zip(_AXES, offset, strict=True)]) for offset in product((-1, 0, 1), repeat=3)]
    left = left.withColumn("b", F.explode(F.array(*around)))
    left = left.select("*", "b.*").drop("b")
    right = clean(points).withColumns({f"b{c}": _buckets(F.col(c), radius) for c in _AXES})
    pairs = left.join(right, [f"b{c}" for c in _AXES])
    d = sub(vec("x", "y", "z"), vec("qx", "qy", "qz"))
    pairs = pairs.withColumn("d2", dot(d, d))
    if chebyshev:
        return pairs.where(F.greatest(*[F.abs(x) for x in d]) <= radius).drop("bx", "by", "bz")
    return pairs.where(F.col("d2") < radius * radius).drop("bx", "by", "bz")


def k_nearest(queries: DataFrame, points: DataFrame, k: int, radius: float | None = None, grow: float = 2.0) -> DataFrame:
    """The ``k`` nearest points of each query, (``qid``, ``pid``, ``d2``, ``rank``); ties go to the smaller ``pid``.

    Equal to brute force. Without ``radius`` leaves are searched that are as small as
    the points are dense (:class:`Packed`). With it, queries that don't find ``k``
    points within it try again with one that is ``grow`` times as large, until all
    have them. Points and queries with a NaN are left out; a radius that isn't
    positive, or infinite coordinates, are an error.
    """
    if radius is None:
        return _ranked_in_blocks(queries, points, k).select("qid", "pid", "d2", "rank")
    if not radius > 0 or not grow > 1:
        raise ValueError("radius must be positive and grow over 1")
    n_points = points.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).count()
    k = min(k, n_points)
    spark = queries.sparkSession
    found = spark.createDataFrame([], "qid long, pid long, d2 double, rank int")
    if not k:
        return found
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "pid"))
    left = queries.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))
    while not left.isEmpty():
        if math.isinf(radius):
            raise ValueError("points or queries have infinite coordinates")
        ranked = near_pairs(left, points, radius).withColumn("rank", rank).where(F.col("rank") <= k)
        ranked = settle(ranked.select("qid", "pid", "d2", "rank"), "nearest")
        full = ranked.where(F.col("rank") == k).select("qid")
        found = found.unionByName(ranked.join(full, "qid", "left_semi"))
        left = settle(left.join(full, "qid", "left_anti"), "queries")
        radius *= grow
    return found


#: Points of a leaf and queries of a block; distances that a task holds at once; ranges of an axis that are sorted each by itself.
SPLIT, HELD, RANGES = 512, 1 << 18, 128

_LEVELS = ("slab", "strip", "leaf")


@dataclass(frozen=True)
class Packed:
    """Rows (id, x, y, z) dealt by place into leaves of like size: slabs of the widest axis, strips of a slab, leaves of a strip.

    ``rows`` have their ``slab``, ``strip`` and ``leaf``. Places break ties by the other axes and the id, so no leaf grows with copies or planes.
    """

    rows: DataFrame
    leaves: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, size: int, name: str) -> Packed | None:
        """At least ``size`` rows to a leaf, if there are as many; None without rows."""
        shares = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
        ends = rows.agg(F.count("*").alias("n"), *[F.max(F.abs(c)).alias(f"far{c}") for c in _AXES], *[F.expr(f"percentile_approx({c}, array({shares}), 2000)").alias(c) for c in _AXES]).first()
        n = ends.n
        if not n:
            return None
        if any(math.isinf(ends[f"far{c}"]) for c in _AXES):
            raise ValueError("points or queries have infinite coordinates")
        wide = {c: ends[c][-RANGES // 20] - ends[c][RANGES // 20] for c in _AXES}
        first, second, third = sorted(_AXES, key=lambda c: -wide[c])
        # As many cuts along each axis as make leaves cubes, the narrowest axis first; rounded down, so no leaf gets too few.
        left, cuts = max(1, n // size), {}
        for k, c in enumerate((third, second, first)):
            others = math.prod(wide[c] / wide[o] if wide[o] else 0.0 for o in (third, second, first)[k:])
            cuts[c] = max(1, min(left, int((left * others) ** (1 / (3 - k)) + 1e-9))) if c != first else left
            left //= cuts[c]
        ticks = [-math.inf, *sorted(set(ends[first])), math.inf]
        each = ", ".join(f"({i}L, double('{a!r}'), double('{b!r}'))" for i, (a, b) in enumerate(zip(ticks, ticks[1:], strict=False)))
        ranges = rows.sparkSession.sql(f"SELECT * FROM VALUES {each} AS ranges(range, low, high)")
        met = rows.join(F.broadcast(ranges), (F.col(first) >= F.col("low")) & (F.col(first) < F.col("high"))).drop("low", "high")
        dealt = placed(met, F.col("range"), [first, second, third, "id"]).drop("range").withColumn("n", F.lit(n).cast("long"))
        dealt = cls._deal(dealt, "slab", F.lit(0).cast("long"), cuts[first])
        inside = lambda node, *order: F.row_number().over(Window.partitionBy(node).orderBy(*order, "id")) - 1
        dealt = cls._deal(dealt.withColumn("place", inside("slab", second, third, first)), "strip", F.col("slab"), cuts[second])
        dealt = cls._deal(dealt.withColumn("place", inside("strip", third, first, second)), "leaf", F.col("strip"), cuts[third])
        found = settle(dealt.select(*_LEVELS, "id", *_AXES), name)
        return cls(found, settle(found.groupBy(*_LEVELS).agg(*_box(*_AXES)), "leaves"))

    @staticmethod
    def _deal(rows: DataFrame, node: str, up: Column, parts: int) -> DataFrame:
        """Places of ``n`` rows dealt to as many as ``parts`` nodes below ``up``; ``n`` becomes that of the node."""
        part = F.expr(f"place * {parts} div n")
        start = lambda k: f"({k} * n + {parts - 1}) div {parts}"
        sized = rows.withColumn("part", part).withColumn("n", F.expr(f"{start('(part + 1)')} - {start('part')}"))
        return sized.withColumn(node, up * parts + F.col("part")).drop("part")

    def nodes(self, level: str) -> DataFrame:
        """(the level above, level, lox, hix, ..): the box of each node."""
        k = _LEVELS.index(level)
        names = _LEVELS[max(0, k - 1) : k + 1]
        return self.leaves.groupBy(*names).agg(*[f(f"{e}{c}").alias(f"{e}{c}") for c in _AXES for f, e in ((F.min, "lo"), (F.max, "hi"))])

    def below(self, blocks: DataFrame, level: str) -> DataFrame:
        """Blocks with each node of ``level`` below the node that they have, and ``apart``, the squared distance between the two boxes."""
        nodes = self.nodes(level)
        met = blocks.crossJoin(F.broadcast(nodes)) if level == _LEVELS[0] else blocks.join(nodes, _LEVELS[_LEVELS.index(level) - 1])
        return met.withColumn("apart", _apart("lo{}", "hi{}"))

    def homes(self, blocks: DataFrame) -> DataFrame:
        """(block, leaf): for each block (block, qlox, qhix, ..) a leaf by its centre."""
        names = [f"q{e}{c}" for c in _AXES for e in ("lo", "hi")]
        at = blocks.select("block", *[((F.col(f"qlo{n[-1]}") + F.col(f"qhi{n[-1]}")) / 2).alias(n) for n in names])
        for level in _LEVELS:
            at = self.below(at, level).groupBy("block", *names).agg(F.min_by(level, F.struct("apart", level)).alias(level))
        return at.select("block", "leaf")

    def within(self, blocks: DataFrame) -> DataFrame:
        """(block, id, x, y, z): the points whose squared distance from a block's box (block, qlox, qhix, .., r2) is at most ``r2``."""
        for level in _LEVELS:
            blocks = self.below(blocks, level).where("apart <= r2").select("block", "r2", *[f"q{e}{c}" for c in _AXES for e in ("lo", "hi")], level)
        return self.rows.select("leaf", "id", *_AXES).join(blocks, "leaf").where(_apart("{}", "{}") <= F.col("r2")).select("block", "id", *_AXES)


def _box(*names: str, to: str = "") -> list[Column]:
    return [f(c).alias(f"{to}{e}{c}") for c in names for f, e in ((F.min, "lo"), (F.max, "hi"))]


def _apart(low: str, high: str) -> Column:
    """The squared distance of a box or point from the box (qlox, qhix, ..); rounded as distances of points are, so never above one of theirs."""
    found = F.lit(0.0)
    for c in _AXES:
        gap = F.greatest(F.col(low.format(c)) - F.col(f"qhi{c}"), F.col(f"qlo{c}") - F.col(high.format(c)), F.lit(0.0))
        found = found + gap * gap
    return found


class _Best:
    """The ``k`` nearest points so far of the queries of a block."""

    def __init__(self, k: int, ids: np.ndarray, at: np.ndarray, limit: np.ndarray):
        self.k, self.ids, self.at, self.limit = k, ids, at, limit.copy()
        self.row, self.d2, self.pid, self.points = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty((0, 3))

    def meet(self, pids: np.ndarray, points: np.ndarray) -> None:
        step = max(1, HELD * 4 // len(self.ids))
        for i in range(0, len(pids), step):
            self._meet(pids[i : i + step], points[i : i + step])

    def _meet(self, pids: np.ndarray, points: np.ndarray) -> None:
        d2 = 0.0
        for c in range(3):
            d = points[None, :, c] - self.at[:, c, None]
            d2 = d2 + d * d
        near = d2 <= self.limit[:, None]
        if len(pids) >= self.k and np.count_nonzero(near) > 4 * self.k * len(self.ids):
            self.limit = np.minimum(self.limit, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1])
            near = d2 <= self.limit[:, None]
        row, col = np.nonzero(near)
        row, d2, pid, points = (np.concatenate(x) for x in ((self.row, row), (self.d2, d2[row, col]), (self.pid, pids[col]), (self.points, points[col])))
        order = np.lexsort((pid, d2, row))
        order = order[self.ranks(row[order]) <= self.k]
        self.row, self.d2, self.pid, self.points = row[order], d2[order], pid[order], points[order]
        last = self.ranks(self.row) == self.k
        self.limit[self.row[last]] = self.d2[last]

    @staticmethod
    def ranks(row: np.ndarray) -> np.ndarray:
        """Places 1, 2, .. within runs of equal rows."""
        return np.arange(len(row)) - np.searchsorted(row, row) + 1


def _streamed(k: int, blocks: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Best]]:
    """Each block of rows (block, asked, id, x, y, z, r2), its queries before its points, with what it found: only a block's queries and results are held."""
    now, queries, best = None, [], None

    def begun() -> _Best:
        ids, at, limit = (np.concatenate(x) for x in zip(*queries, strict=True))
        return _Best(k, ids, at, limit)

    for batch in blocks:
        block, asked, ids, x, y, z, r2 = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("block", "asked", "id", *_AXES, "r2"))
        at = np.stack((x, y, z), axis=1)
        ends = np.flatnonzero((np.diff(block) != 0) | (np.diff(asked) != 0)) + 1
        for i, j in zip((0, *ends), (*ends, len(block)), strict=True):
            if i == j:
                continue
            if block[i] != now:
                if queries:
                    yield now, best or begun()
                now, queries, best = block[i], [], None
            if asked[i] == 0:
                queries.append((ids[i:j], at[i:j], r2[i:j]))
            elif queries:
                best = best or begun()
                best.meet(ids[i:j], at[i:j])
    if queries:
        yield now, best or begun()


def _bounds(k: int):
    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _streamed(k, blocks):
            yield pa.RecordBatch.from_pydict({"block": np.full(len(b.ids), block), "id": b.ids, **dict(zip(_AXES, b.at.T, strict=True)), "r2": b.limit})

    return run


def _found(k: int):
    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _streamed(k, blocks):
            at = {f"q{c}": v[b.row] for c, v in zip(_AXES, b.at.T, strict=True)}
            yield pa.RecordBatch.from_pydict({"qid": b.ids[b.row], **at, "pid": b.pid, **dict(zip(_AXES, b.points.T, strict=True)), "d2": b.d2, "rank": b.ranks(b.row).astype(np.int32)})

    return run


_FOUND = "qid long, qx double, qy double, qz double, pid long, x double, y double, z double, d2 double, rank int"


def _ranked_in_blocks(queries: DataFrame, points: DataFrame, k: int, radius: float = math.inf) -> DataFrame:
    """The ``k`` nearest points within ``radius`` (exclusive) of each query: (qid, qx, qy, qz, pid, x, y, z, d2, rank).

    Queries and points are dealt into leaves. A leaf near a block of queries
    bounds the distance of each one's last neighbour; queries of a block with
    like bounds then meet the points that lie within them. Pairs live in NumPy,
    a block at a time: only queries, points and results are written or shuffled.
    Of points in one place the ``k`` with the smallest ids are enough.
    """
    clean = lambda d, key: d.where(~(F.isnan("x") | F.isnan("y") | F.isnan("z"))).select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in _AXES])
    alike = F.row_number().over(Window.partitionBy(*_AXES).orderBy("id"))
    asked = Packed.of(settle(clean(queries, "qid"), "queries"), min(SPLIT, max(1, HELD // max(1, k))), "queries")
    known = Packed.of(settle(clean(points, "pid").withColumn("alike", alike).where(F.col("alike") <= k).drop("alike"), "points"), max(SPLIT, k), "points")
    if asked is None or known is None or k < 1:
        return queries.sparkSession.createDataFrame([], _FOUND)
    limit = radius * radius
    rows = asked.rows.select(F.col("leaf").alias("block"), "id", *_AXES, F.lit(limit).alias("r2"))
    home = known.homes(rows.groupBy("block").agg(*_box(*_AXES, to="q")))
    near = known.rows.join(home, "leaf").select("block", "id", *_AXES)
    rows = _together(rows, near).mapInArrow(_bounds(k), "block long, id long, x double, y double, z double, r2 double")
    like = F.greatest(F.least(F.coalesce(F.floor(F.log2(F.least("r2", F.lit(1e300))) / 4), F.lit(-128)), F.lit(127)), F.lit(-128))  # bounds within a factor of 16
    rows = settle(rows.withColumn("block", F.col("block") * 256 + like + 128), "bounds")
    near = known.within(rows.groupBy("block").agg(*_box(*_AXES, to="q"), F.max("r2").alias("r2")))
    return _together(rows, near).mapInArrow(_found(k), _FOUND).where(F.col("d2") < limit if math.isfinite(radius) else F.lit(True))


def _together(queries: DataFrame, points: DataFrame) -> DataFrame:
    """Queries and points of each block in one task, queries first."""
    rows = queries.withColumn("asked", F.lit(0)).unionByName(points.withColumns({"asked": F.lit(1), "r2": F.lit(0.0)}))
    return rows.repartition("block").sortWithinPartitions("block", "asked")


def radius_top(queries: DataFrame, points: DataFrame, radius: float, most: int) -> DataFrame:
    """Up to ``most`` nearest points within ``radius`` (exclusive) of each query, ranked, ties by ``pid``: (qid, qx, qy, qz, pid, x, y, z, d2, rank).

    Pairs within the radius are never listed, as there may be many more than ``most``.
    """
    finite = lambda d: d.where(" AND ".join(f"abs({c}) < double('infinity')" for c in _AXES))
    return _ranked_in_blocks(finite(queries), finite(points), most, radius)


def radius_counts(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """How many points lie within ``radius`` of each query that has any."""
    return near_pairs(queries, points, radius).groupBy("qid").agg(F.count("*").alias("n"))


def remove_outliers(points: DataFrame, neighbours: int, radius: float) -> DataFrame:
    """Points with at least ``neighbours`` points, themselves included, within ``radius``."""
    pairs = near_pairs(points.select(F.col("pid").alias("qid"), *_AXES), points.select("pid", *_AXES), radius)
    kept = pairs.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= neighbours).select(F.col("qid").alias("pid"))
    return points.join(kept, "pid", "left_semi")


def estimate_normals(points: DataFrame, neighbours: int, radius: float, camera: tuple[float, float, float] = (0.0, 0.0, 0.0), least: int = 5) -> DataFrame:
    """(``pid``, ``n``, ``nx``, ``ny``, ``nz``): the direction of least spread of the nearest points, turned to the camera.

    Neighbours are those of rank 2 to ``neighbours`` within ``radius``; with fewer
    than ``least`` the normal is NaN. Covariances are sums of moments, so nothing is collected.
    """
    near = radius_top(points.select(F.col("pid").alias("qid"), *_AXES), points.select("pid", *_AXES), radius, neighbours).where("rank > 1")
    d = {c: F.col(c) - F.col(f"q{c}") for c in _AXES}
    sums = [F.sum(d[c]).alias(f"s{c}") for c in _AXES]
    squares = [F.sum(d[a] * d[b]).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    m = near.groupBy("qid").agg(F.count("*").alias("n"), *sums, *squares)
    cov = [F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    m = with_smallest_eigenvector(m, cov, ["ex", "ey", "ez"])
    normal = vec("ex", "ey", "ez")
    rows = points.select("pid", *_AXES).join(m.withColumnRenamed("qid", "pid"), "pid", "left")
    away = dot(normal, tuple(F.col(c) - v for c, v in zip(_AXES, camera, strict=True)))  # type: ignore[arg-type]
    nan = F.lit(float("nan"))
    made = [F.when(F.col("n") >= least, F.when(away > 0, -x).otherwise(x)).otherwise(nan).alias(f"n{c}") for c, x in zip(_AXES, normal, strict=True)]
    return rows.select("pid", F.coalesce("n", F.lit(0)).alias("n"), *made)


def vote_sdf(samples: DataFrame, surface: DataFrame, votes: int, sigma: float, radius: float | None = None, furthest: float | None = None) -> DataFrame:
    """(``qid``, ``sdf``): a signed distance for each sample (qid, x, y, z) by its nearest surface points (pid, x, y, z, nx, ny, nz).

    The size is the distance to the nearest one, along its normal if that is
    closer than ``sigma``; the sign is the side on which all ``votes`` normals
    see the sample, and NaN where they disagree or the nearest is too far.
    """
    near = k_nearest(samples, surface.select("pid", *_AXES), votes, radius)
    rows = near.join(surface, "pid").join(samples.select("qid", *[F.col(c).alias(f"q{c}") for c in _AXES]), "qid")
    ray = sub(vec("qx", "qy", "qz"), vec("x", "y", "z"))
    side = dot(vec("nx", "ny", "nz"), ray)
    first = F.min_by(F.struct("d2", side.alias("side")), F.col("rank"))
    votes_ = rows.groupBy("qid").agg(first.alias("f"), F.sum(F.when(side > 0, 1).otherwise(0)).alias("plus"), F.count("*").alias("n"))
    distance = F.sqrt("f.d2")
    size = F.when(distance < sigma, F.abs(F.col("f.side"))).otherwise(distance)
    nan = F.lit(float("nan"))
    sdf = F.when(F.col("plus") == F.col("n"), size).when(F.col("plus") == 0, -size).otherwise(nan)
    return votes_.select("qid", (sdf if furthest is None else F.when(distance > furthest, nan).otherwise(sdf)).alias("sdf"))
