"""Vector codes: each part of a vector as the index of the nearest entry of its codebook.

Components are scaled and floored to integers, so every distance is exact. Entries
are searched for by segment means: the sums of a part's blocks, first of one block,
then of twice as many each time, and the norm of what the means leave bound the
distance from below. Only entries whose bounds don't exceed the distance to the
likeliest ones get their exact distance, so what is found equals a full search.

Codebooks are trained in rounds of one aggregate each: tasks sum the parts of their
own rows by entry, so the rows shuffled are as many as there are entries in all
codebooks, for each task, and only as many sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.tables import settle
from stratavox.llm.words import Batches, returning

#: Rows whose bounds are held at once.
ROWS = 4096
#: A label counts as heavy if it has more than one of so many rows: there are fewer heavy labels than this.
HEAVY = 1000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, integers, and the scale by which components were multiplied."""

    entries: np.ndarray
    scale: int = 256

    @property
    def length(self) -> int:
        """Components of a vector."""
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        """The digest of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _limit(length: int) -> int:
    """The largest integer component: with it no sum of squared differences leaves 64 bits."""
    return 1 << (62 - max(length - 1, 0).bit_length()) // 2 - 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All components, where each row's begin (one more at the end), and which rows are neither null nor hold a null or non-finite one."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return values, bounds, there & (bad[bounds[1:]] == bad[bounds[:-1]])


def _integers(values: np.ndarray, starts: np.ndarray, length: int, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        found = np.floor(scale * values[starts[:, None] + np.arange(length)])
    return np.clip(found, -_limit(length), _limit(length)).astype(np.int64)


class SegmentMeans:
    """The search for the nearest of ``entries`` (entry, position), with block sums and residual norms from coarse to fine."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        width = entries.shape[1]
        self.levels, blocks = [], 1
        while blocks < width:
            sizes = np.array([len(x) for x in np.array_split(np.arange(width), blocks)])
            self.levels.append((sizes, *self._shape(entries, sizes)))
            blocks *= 2
        self.norms = (entries.astype(np.float64) ** 2).sum(1)

    @staticmethod
    def _shape(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block sums over the root of the block's size, and the norms of what the block's means leave: as coordinates, they are never farther apart than what they are of."""
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(x, starts, axis=1)
        left = x - np.repeat(sums / sizes, sizes, axis=1)
        return sums / np.sqrt(sizes), np.sqrt(np.add.reduceat(left**2, starts, axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of ``x`` the nearest entry (of ties the first) and its squared distance; and how many distances were computed."""
        n = len(x)
        if not self.levels:
            rows, cols = np.divmod(np.arange(n * len(self.entries)), len(self.entries))
            return *self._least(x, rows, cols), len(rows)
        # floats err by less than this share of the norms, so nothing that can be nearest is dropped
        slack = 1e-11 * ((x.astype(np.float64) ** 2).sum(1) + self.norms.max() + 1)
        each, most = np.arange(n), np.full(n, np.inf)
        rows = cols = each
        for k, (sizes, sums, left) in enumerate(self.levels):
            own_sums, own_left = self._shape(x, sizes)
            if k == 0:
                bounds = (own_sums - sums.T) ** 2 + (own_left - left.T) ** 2
                likely = bounds.argmin(1)
            else:
                bound = ((own_sums[rows] - sums[cols]) ** 2 + (own_left[rows] - left[cols]) ** 2).sum(1)
                least = np.minimum.reduceat(bound, np.searchsorted(rows, each))
                ties = np.flatnonzero(bound == least[rows])
                likely = cols[ties[np.searchsorted(rows[ties], each)]]
            most = np.minimum(most, ((x - self.entries[likely]) ** 2).sum(1) + slack)
            if k == 0:
                rows, cols = np.nonzero(bounds <= most[:, None])
            else:
                rows, cols = rows[bound <= most[rows]], cols[bound <= most[rows]]
        return *self._least(x, rows, cols), len(rows)

    def _least(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact distances of the pairs, by rows; of each row the least, and the first entry that has it."""
        distance = ((x[rows] - self.entries[cols]) ** 2).sum(1)
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.minimum.reduceat(distance, np.searchsorted(rows, np.arange(len(x))))
        ties = np.flatnonzero(distance == least[rows])
        return cols[ties[np.searchsorted(rows[ties], np.arange(len(x)))]], least


class _Coder:
    """Codes of whole vectors."""

    def __init__(self, books: Codebooks) -> None:
        self.books = books
        self.searches = [SegmentMeans(e) for e in books.entries]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) indexes of entries, and squared distances alike."""
        parts, _, width = self.books.entries.shape
        found = np.zeros((2, len(x), parts), np.int64)
        for at in range(0, len(x), ROWS):
            rows = x[at : at + ROWS]
            for part, search in enumerate(self.searches):
                found[0, at : at + ROWS, part], found[1, at : at + ROWS, part], _ = search.nearest(rows[:, part * width : (part + 1) * width])
        return found[0], found[1]

    def kept(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are kept, and their integer components."""
        values, bounds, there = _flat(column)
        there &= (np.diff(bounds) == self.books.length) & (self.books.entries.shape[1] > 0)
        return there, _integers(values, bounds[:-1][there], self.books.length, self.books.scale)


def first_vectors(df: DataFrame, id: str, vector: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """The integer vectors of the smallest ids: each task gives at most ``entries`` rows for each length of vectors."""

    def run(batches: Batches) -> Batches:
        best: dict[int, dict] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            values, bounds, there = _flat(batch.column(1))
            there &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            lengths = np.diff(bounds)
            for length in np.unique(lengths[there]).tolist():
                if length % parts:
                    continue
                at = np.flatnonzero(there & (lengths == length))
                ids = batch.column(0).take(pa.array(at))
                known = best.setdefault(length, {})
                wanted = set(sorted({*known, *ids.unique().to_pylist()})[:entries])
                for i, x in zip(ids.to_pylist(), at.tolist(), strict=True):
                    if i in wanted:
                        row = _integers(values, bounds[x : x + 1], length, scale)[0].tolist()
                        known[i] = min(known.get(i, row), row)
                best[length] = {i: known[i] for i in wanted}
        for length, known in best.items():
            made = [pa.array([length] * len(known), pa.int32()), pa.array(list(known), kind), pa.array(list(known.values()), pa.list_(pa.int64()))]
            yield pa.record_batch(made, ["length", "id", "v"])

    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    schema = T.StructType([T.StructField("length", T.IntegerType()), rows.schema["id"], T.StructField("v", T.ArrayType(T.LongType()))])
    firsts = rows.mapInArrow(returning(run), schema).groupBy("length", "id").agg(F.min("v").alias("v"))
    found = firsts.orderBy(F.desc("length"), "id").limit(entries).collect()
    longest = [r.v for r in found if r.length == found[0].length]
    return np.array(longest, np.int64).reshape(len(longest), found[0].length if found else 0)


def fit(df: DataFrame, id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Train a codebook for each of ``parts`` equal parts on every vector of ``df``.

    Components become floor(scale * x). Codebooks start as the vectors with the
    ``entries`` (256 at most) smallest ids, of repeated ids the smallest vector,
    fewer if there are fewer. In each of the rounds every part goes to the nearest
    entry of its codebook, and each entry becomes the floored mean of its parts; an
    entry without parts stays. Repeated rows count as often as they are there.

    Null vectors and those with a null or non-finite component are dropped. So are
    those of another length than the longest that can be cut into equal parts; rows
    without an id are trained on, but no entry starts as one. Integers are cut off
    where sums of squares would leave 64 bits (for 64 components, beyond 2^27). An
    empty table gives codebooks without entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    first = first_vectors(df, id, vector, parts, entries, scale)
    width = first.shape[1] // parts
    books = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2)), scale)
    for _ in range(rounds if len(first) else 0):
        books = _trained(df, vector, books)
    return books


def _trained(df: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """The codebooks after one round."""
    parts, entries, width = books.entries.shape
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Batches) -> Batches:
        coder = _Coder(shared.value)
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            _, x = coder.kept(batch.column(0))
            codes, _ = coder.codes(x)
            for at in range(0, len(x), ROWS):
                rows, code = x[at : at + ROWS], codes[at : at + ROWS]
                for part in range(parts):
                    n[part] += np.bincount(code[:, part], minlength=entries)
                    for i in range(width):
                        weights = rows[:, part * width + i]  # sums of so few rows are exact as floats
                        sums[part, :, i] += np.bincount(code[:, part], weights, entries).astype(np.int64)
        part, entry = np.nonzero(n)
        made = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.record_batch(made, ["part", "entry", "n", "sums"])

    found = df.select(F.col(vector).alias("vector")).mapInArrow(returning(run), "part int, entry int, n long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    after = books.entries.copy()
    for row in totals.collect():  # as many rows as entries at most
        after[row.part, row.entry] = [row[f"s{i}"] // row.n for i in range(width)]
    shared.unpersist()
    return Codebooks(after, books.scale)


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """The rows that :func:`fit` keeps, with ``code``, two hexadecimal digits for each part, and ``error``, the squared distance to the vector it stands for.

    Columns of these names are replaced, all others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(books)
    names = [c for c in df.columns if c not in ("code", "error")]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        coder = _Coder(shared.value)
        digits = 2 * shared.value.entries.shape[0]
        for batch in batches:
            there, x = coder.kept(batch.column(names.index(vector)))
            codes, distances = coder.codes(x)
            written = codes.astype(np.uint8).tobytes().hex()
            made = [pa.array([written[i * digits : (i + 1) * digits] for i in range(len(x))], pa.string()), pa.array(distances.sum(1))]
            yield pa.record_batch([*batch.filter(pa.array(there)).columns, *made], [*names, "code", "error"])

    kept = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*kept.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.mapInArrow(returning(run), schema)


def decode(df: DataFrame, books: Codebooks, code: str = "code", out: str = "vector") -> DataFrame:
    """Add ``out``, the vector that a code stands for (the middle of its integers' steps); null for a null code."""
    parts, entries, _ = books.entries.shape
    table = F.lit(None).cast("array<array<double>>")
    if entries:
        rows = ((books.entries + 0.5) / books.scale).reshape(parts * entries, -1).tolist()
        table = F.from_json(F.lit(str(rows)), "array<array<double>>")
    places = F.sequence(F.lit(0), F.lit(parts - 1))
    index = lambda p: F.conv(F.substring(F.col(code), 2 * p + 1, F.lit(2)), 16, 10).cast("int") + p * entries
    return df.withColumn(out, F.when(F.col(code).isNotNull(), F.flatten(F.transform(places, lambda p: F.get(table, index(p))))))


def with_sums(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``value`` over all rows of equal ``key``, nulls together.

    Keys with more than a thousandth of all rows, fewer than ``HEAVY``, are looked
    up in a broadcast table; only rows of other keys are shuffled. ``df`` is read
    more than once, so it should be a table.
    """
    helpers = {"_key": F.col(f"`{key}`")}
    sums = settle(df.groupBy(helpers["_key"].alias("_key")).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n")), "sums")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    large = sums.where(F.col("_n") * HEAVY > total).drop("_n")
    small = sums.where(F.col("_n") * HEAVY <= total).drop("_n")
    same = F.col(f"`{key}`").eqNullSafe(F.col("_key"))
    often = df.join(F.broadcast(large), same, "inner")
    rare = df.join(F.broadcast(large.select("_key")), same, "leftanti").join(small, same, "inner")
    return often.unionByName(rare).withColumnRenamed("_sum", out).drop("_key")
