"""Exact n-gram Jaccard join with a token-group matrix.

A document's set holds its distinct word shingles. A set is cut into parts by the
hash of its shingles, into so many that two sets which reach the coefficient must
have some parts in common, shingle for shingle. Each document lists as many of its
rarest parts as make sure that any partner lists one of them too; such a part is a
token. Documents that are alike are put into groups: all that share a token are
compared with one of them, and what passes falls together. The matrix then says
which groups can still hold partners of a document outside: it lists groups by
their tokens, each group's union of shingles (as bits) bounds the overlap with a
query, and only groups whose bound is high enough are opened. What is left is
decided on the whole sets.

No task ever holds the pairs within a group: copies are one set, a member meets
its group's leader once, and between groups only qualifying ones are opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.components import components
from stratavox.llm.tables import forget, settle, small_batches
from stratavox.llm.words import SPACE_WORDS, mix, pieces, returning, shingle_sets, word_hashes, word_spans

#: Counters of the frequency sketch, bits of the map of shared tokens, and the parts in which such arrays are shuffled.
SKETCH_BITS, MAP_BITS, ARRAY_PARTS = 20, 25, 64
#: Documents of one group at most; a larger set of like documents becomes several groups.
GROUP = 64
#: Ids of documents (8 bytes each) that are broadcast at most.
FEW_IDS = 1_000_000


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, data, bounds in pieces(column):
        starts, ends, counts = word_spans(data, bounds, SPACE_WORDS)
        yield from shingle_sets(word_hashes(data, starts, ends), counts, n)


def _gathered(rows: DataFrame, fill: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], size: int, dtype: type, wide: type, join: np.ufunc) -> np.ndarray:
    """One array of ``size`` over all rows: each task fills one of its own, and they are joined by parts in two steps.

    What any task or the driver gets is bounded by the array's size, whatever the number of tasks.
    """
    width = size // ARRAY_PARTS
    small, large = np.dtype(dtype).itemsize * width, np.dtype(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, dtype)
        fill(batches, own)
        task = TaskContext.get().partitionId() % 1024
        for k in range(ARRAY_PARTS):
            part = own[k * width : (k + 1) * width]
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["part", "task", "array"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, large)
        for x in frame["array"]:
            join(total, np.frombuffer(x, dtype if len(x) == small else large), out=total)
        return frame.iloc[:1].assign(array=[total.tobytes()])

    schema = "part int, task int, array binary"
    parts = rows.mapInArrow(returning(run), schema).groupBy("part", "task").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema)
    whole = np.zeros(size, large)
    for row in parts.collect():
        whole[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["array"], large)
    return whole


def frequencies(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents hold the shingles that fall on each counter of a sketch, over all documents.

    A shingle that a fixed share of all documents holds stands out however many documents there are.
    """

    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            for one in _sets(batch.column(0), n):
                np.add.at(own, (one >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)

    sketch = _gathered(docs.select("text"), fill, 1 << SKETCH_BITS, np.int32, np.int64, np.add)
    return np.minimum(sketch, (1 << 32) - 1).astype(np.uint32)


def _map_places(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (tokens & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
    return at >> 3, np.left_shift(1, at & 7).astype(np.uint8)


def _token_map(shared: DataFrame) -> np.ndarray:
    """Shared tokens as a map of bits of fixed size: it passes every one of them, and few others while they are few."""

    def fill(batches: Iterator[pa.RecordBatch], own: np.ndarray) -> None:
        for batch in batches:
            np.bitwise_or.at(own, *_map_places(batch.column(0).to_numpy().view(np.uint64)))

    return _gathered(shared.select("token"), fill, 1 << (MAP_BITS - 3), np.uint8, np.uint8, np.bitwise_or)


def _bits(one: np.ndarray) -> np.ndarray:
    """A set as bits, four to eight for each shingle: a power of two of them, so that a longer row folds onto a shorter one."""
    size = 1 << max(6, int(4 * len(one) - 1).bit_length())
    row = np.zeros(size, np.uint8)
    row[(one & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(row, bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set over ``words`` words, which are not more than it has."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def _most_shared(query: np.ndarray, size: int, union: np.ndarray) -> int:
    """A bound of the overlap of a set of ``size`` shingles with a union: each bit that only the set has is a shingle of its own."""
    words = min(len(query), len(union))
    return size - int(np.bitwise_count(_folded(query, words) & ~_folded(union, words)).sum())


def _tokens(one: np.ndarray, seen: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a sorted set; ``seen`` says how often each shingle occurs. Sets that reach the coefficient and aren't equal share one.

    Sizes fall into levels, each twice as large as the one before. A pair meets in the larger set's level, so a set lists
    tokens for its own level and for those that larger partners can be in. Two sets of sizes a and b that reach the
    coefficient differ in h <= (a + b) (1 - t) / (1 + t) shingles. Of the p parts of a level, h at most then differ, so
    any h + 1 that come first in an order which both sets share (rarest parts first) have an equal one among them.
    """
    size, found = len(one), []
    most = size * 100 // percent
    level = max(size, 1).bit_length() - 1
    while 1 << level <= most and size:
        top = (2 << level) - 1
        differ = (100 - percent) * (size + min(top, most)) // (100 + percent)
        if differ:
            parts = 3 * ((100 - percent) * 2 * top // (100 + percent) + 1) // 2
            part = ((one >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
            place, least = part[starts], np.minimum.reduceat(seen, starts)
            sums = mix(np.add.reduceat(one, starts))
            if len(starts) <= differ:  # empty parts come last
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), place)
                place, sums = np.concatenate([place, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
                least = np.concatenate([least, np.full(len(empty), np.iinfo(seen.dtype).max, seen.dtype)])
            with np.errstate(over="ignore"):
                tokens = mix(sums + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
            found.append(tokens[np.lexsort((tokens, least))[: differ + 1]])
        level += 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    bounds = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))


def _profiles(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, size, digest, bits, tokens): each document's set by size, digest and bits, and the tokens, one of which any partner shares."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bits, tokens = [], [], [], []
            for one in _sets(batch.column(1), n):
                sizes.append(len(one))
                digests.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest())
                bits.append(_bits(one).tobytes())
                tokens.append(_tokens(one, shared.value[(one >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], percent))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), _lists(tokens)]
            yield pa.record_batch(columns, ["doc_id", "size", "digest", "bits", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(returning(run), "doc_id long, size long, digest binary, bits binary, tokens array<long>")


def _postings(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, doc, size): of each class's first document, the tokens that other documents list too.

    Tokens are counted first. A map of the shared ones of fixed size then takes nearly all others out where the documents
    lie, so that few rows are shuffled by document; those that it passes wrongly share a token with nobody.
    """
    counts = profiles.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    shared = settle(counts.where("n > 1").select("token"), "shared")
    passed = profiles.sparkSession.sparkContext.broadcast(_token_map(shared))
    forget(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat, bounds = column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            at, bit = _map_places(flat)
            keep = (passed.value[at] & bit) != 0
            kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(flat[keep].view(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], ["doc", "size", "tokens"]).filter(pa.array(np.diff(kept) > 0))

    rows = profiles.where("size > 0 AND doc_id IS NOT NULL").select("doc_id", "size", "tokens").mapInArrow(returning(run), "doc long, size long, tokens array<long>")
    return settle(rows.join(classes, "doc", "leftsemi").select(F.explode("tokens").alias("token"), "doc", "size"), "postings")


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` for a join: few go to where the rows are, more than ``FEW_IDS`` are joined by a shuffle."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def _only(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``doc`` is one of ``ids``."""
    return table.join(_few(ids), "doc", "leftsemi")


def without(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` is none of the column of that name in ``ids``; rows with a null key stay."""
    return table.join(_few(ids), key, "leftanti").select(*table.columns)


def _set_table(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc, set) of the documents ``ids``: sorted shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([one.tobytes() for one in _sets(batch.column(1), n)], pa.binary())], ["doc", "set"])

    rows = _only(docs.select(F.col("doc_id").alias("doc"), "text"), ids)
    return settle(rows.mapInArrow(returning(run), "doc long, set binary"), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()


def _overlap(a: bytes, b: bytes) -> tuple[int, int, int]:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0, len(x), len(y)


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose bits still allow the coefficient; none that reaches it is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, m, y, k in zip(*(batch.column(c) for c in ("x", "m", "y", "k")), strict=True):
                m, k = m.as_py(), k.as_py()
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = min(_most_shared(x, m, y), _most_shared(y, k, x))
                keep.append(100 * both >= percent * (m + k - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = bits.select(F.col("doc").alias("a"), F.col("bits").alias("x"), F.col("size").alias("m"))
    right = bits.select(F.col("doc").alias("b"), F.col("bits").alias("y"), F.col("size").alias("k"))
    whole = pairs.select("a", "b").join(left, "a").join(right, "b").where(f"100 * least(m, k) >= {percent} * greatest(m, k)")
    return whole.select("a", "b", "x", "m", "y", "k").mapInArrow(returning(run), "a long, b long")


def _linked(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the settled pairs (a, b) those whose Jaccard coefficient is at least ``percent`` / 100, by their whole sets."""
    sets = _set_table(docs, _ends(pairs), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both, m, k = _overlap(x.as_py(), y.as_py())
                keep.append(100 * both >= percent * (m + k - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("set").alias("y"))
    whole = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    found = settle(whole.mapInArrow(returning(run), "a long, b long"), "linked")
    forget(sets, pairs)
    return found


def _open_groups(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents (a, b) of different components that pairs of groups (``x``, ``y``: their members) may hold, by bits.

    A group's union bounds what each document of the other can share with any of its members. Members are looked at one
    by one, as bits, only for the documents whose bound is high enough.
    """

    def fold(rows: list[np.ndarray], words: int) -> np.ndarray:
        return np.stack([_folded(x, words) for x in rows])

    def meet(x: list[dict], y: list[dict]) -> Iterator[tuple[int, int]]:
        xs, ys = ([np.frombuffer(r["bits"], np.uint64) for r in side] for side in (x, y))
        words = min(map(len, xs + ys))
        left, right = fold(xs, words), fold(ys, words)
        union = np.bitwise_or.reduce(right, axis=0)
        docs, owners, sizes = (np.array([r[k] for r in y], np.int64) for k in ("doc", "c", "size"))
        for query, whole, row in zip(x, xs, left, strict=True):
            most = query["size"] - int(np.bitwise_count(row & ~union).sum())
            if 100 * most < percent * max(query["size"], int(sizes.min())):
                continue
            both = np.minimum(query["size"] - np.bitwise_count(row & ~right).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(right & ~row).sum(axis=1, dtype=np.int64))
            likely = (100 * both >= percent * (query["size"] + sizes - both)) & (owners != query["c"])
            for k in np.flatnonzero(likely).tolist():
                shared = min(_most_shared(whole, query["size"], ys[k]), _most_shared(ys[k], int(sizes[k]), whole))
                if 100 * shared >= percent * (query["size"] + int(sizes[k]) - shared):
                    yield min(query["doc"], int(docs[k])), max(query["doc"], int(docs[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                found = sorted(set(meet(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())))
                yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return pairs.select("x", "y").mapInArrow(returning(run), "a long, b long").distinct()


def _between_groups(docs: DataFrame, postings: DataFrame, bits: DataFrame, tested: DataFrame, labels: DataFrame, n: int, percent: int) -> DataFrame | None:
    """Links between documents of different components, through the token-group matrix; None if it leaves no pair to test.

    Groups are blocks of a component, or of single documents that have their most frequent token in common. A row of the
    matrix is a pair of groups that share a token, so a token that many documents list gives few rows.
    """
    known = labels.select(F.col("node").alias("doc"), "component")
    rows = postings.join(known, "doc", "left").withColumn("c", F.coalesce("component", "doc"))
    shared = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("token", "n")
    rows = settle(rows.join(shared, "token"), "cells")
    owner = F.when(F.col("component").isNull(), F.max_by("token", F.struct("n", "token"))).otherwise(F.first("c"))
    members = rows.groupBy("doc", "c", "component").agg(owner.alias("owner")).withColumn("lone", F.col("component").isNull())
    counts = members.groupBy("lone", "owner").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    block = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    members = members.join(counts, ["lone", "owner"]).select("doc", "c", "lone", F.concat_ws(":", "lone", "owner", block).alias("g"))
    members = settle(members, "members")
    cells = rows.select("token", "doc", "size").join(members, "doc").groupBy("token", "g").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("c").alias("c"), F.first("lone").alias("lone"))
    cells = settle(cells, "cells")
    x, y = cells.alias("x"), cells.alias("y")
    meet = (F.col("x.token") == F.col("y.token")) & (F.col("x.g") <= F.col("y.g")) & (F.col("x.lone") | F.col("y.lone") | (F.col("x.c") != F.col("y.c")))
    sizes = (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
    pairs = settle(x.join(y, meet & sizes).where("x.g < y.g OR x.lone").select(F.col("x.g").alias("gx"), F.col("y.g").alias("gy")).distinct(), "pairs")
    bits = _only(bits, members.select("doc").distinct())
    matrix = members.join(bits, "doc").groupBy("g").agg(F.collect_list(F.struct("doc", "c", "size", "bits")).alias("members"))  # a block's
    matrix = settle(matrix, "matrix")
    opened = pairs.join(matrix.select(F.col("g").alias("gx"), F.col("members").alias("x")), "gx").join(matrix.select(F.col("g").alias("gy"), F.col("members").alias("y")), "gy")
    # What was compared already needs no second look.
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = settle(_open_groups(opened, percent).join(done, ["a", "b"], "leftanti"), "possible")
    forget(rows, members, cells, pairs, matrix)
    if left.isEmpty():
        forget(left)
        return None
    return _linked(docs, left, n, percent)


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_shingles`` (its set's size) and ``component_id``.

    Words are runs without ASCII white space, A-Z as a-z. Two documents link when
    100 * |intersection| >= ``percent`` * |union| of their sets of ``n``-word
    shingles; with fewer words the whole sequence is one shingle; a null or
    wordless text has none and links with nothing. ``component_id`` is the
    smallest id that links lead to, the document's own included. Repeated rows
    each give a row. An id names one document: where it stands on several texts,
    what links with any of them may be joined through it. A row with a null id
    gets a null component.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        return _joined(docs, n, percent)


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    profiles = settle(_profiles(docs, n, percent, frequencies(docs, n)), "profiles")
    classes = profiles.where("size > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc"))
    classes = settle(classes, "classes")
    postings = _postings(profiles, classes)
    leaders = postings.groupBy("token").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader < last").drop("last")
    star = postings.join(leaders, "token").where("doc != leader").select(F.col("leader").alias("a"), F.col("doc").alias("b"))
    tested = settle(star.distinct(), "star")
    bits = profiles.select(F.col("doc_id").alias("doc"), "size", "bits").where("doc IS NOT NULL AND size > 0")
    links = _linked(docs, settle(_possible(tested, _only(bits, _ends(tested)), percent), "possible"), n, percent)
    labels = settle(components(links), "labels")
    more = _between_groups(docs, postings, bits, tested, labels, n, percent)
    forget(postings, tested)
    if more is not None and not more.isEmpty():
        merged = settle(components(links.unionByName(more)), "labels")
        forget(labels, more)
        labels = merged
    found = profiles.select("doc_id", "size", "digest").join(classes, "digest", "left")
    found = found.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", F.when(F.col("size") > 0, F.col("doc")), "doc_id"))
    found = settle(found.select("doc_id", F.col("size").alias("n_shingles"), own.alias("component_id")), "components")
    forget(profiles, classes, links, labels)
    return found
