"""Benchmark decontamination with an FM-index for each shard of documents.

A shard's words become symbols: the words of the test phrases, and one separator
for every other word. Between separators only stretches that are long enough to
hold a phrase enter the index; no other place can hold one. Phrases are searched
backward through wavelet-matrix ranks, all at once; occurrences are located by
sampled suffix positions, and the words they cover merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.words import ALNUM_WORDS, pieces, returning, word_hashes, word_spans

#: Bytes of text of one shard (a task needs about 60 bytes for each); every how manieth position is sampled; symbols of one stretch at most (longer ones overlap).
SHARD = 1 << 19
SAMPLE = 8
STRETCH = 64
#: Bytes of benchmark text whose phrases are broadcast together; a larger benchmark is searched for in several blocks.
BLOCK = 4 << 20


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases as rows of word ids (1 up, right-aligned, 0 before shorter ones) and the items of each."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    lengths: np.ndarray
    item_bounds: np.ndarray
    items: list[str | None]


def phrases_of(items: list[tuple[str | None, str]], n: int) -> Phrases:
    """Every window of ``n`` words of the items; an item with fewer words, but not none, is one window."""
    owners: dict[bytes, set[str | None]] = {}
    data = pa.array([text for _, text in items], pa.string())
    for row, part, bounds in pieces(data):
        starts, ends, counts = word_spans(part, bounds, ALNUM_WORDS)
        hashes = word_hashes(part, starts, ends)
        for k, (a, b) in enumerate(zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True)):
            for at in range(a, max(b - n, a) + 1) if b > a else ():
                owners.setdefault(hashes[at : min(at + n, b)].tobytes(), set()).add(items[row + k][0])
    rows = [np.frombuffer(x, np.uint64) for x in owners]
    vocabulary = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.uint64)
    symbols = np.zeros((len(rows), n), np.int64)
    for k, row in enumerate(rows):
        symbols[k, n - len(row) :] = np.searchsorted(vocabulary, row) + 1
    listed = [sorted(x for x in o if x is not None) for o in owners.values()]
    return Phrases(vocabulary, symbols, np.array([len(x) for x in rows], np.int64), np.cumsum([0, *map(len, listed)]), [x for o in listed for x in o])


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Symbols by bit planes from the highest down; each plane puts the symbols with a 0 first."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.planes: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> shift) & 1 != 0
            self.planes.append((shift, Bits(one), len(symbols) - int(one.sum())))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        self.first = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.planes:
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1 != 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, at) - self.first[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.planes:
            one, ones = bits.get(at), bits.rank(at)
            symbol |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return symbol


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; each separator (0) is smaller than all symbols and than the separators after it."""
    n = len(symbols)
    apart = symbols == 0
    rank = np.where(apart, np.cumsum(apart), symbols + int(apart.sum()))
    width, reach = int(rank.max()) + 1, 2
    padded = np.concatenate([rank, [0, 0]])
    key = padded[:n] * width + padded[1 : n + 1]
    if width < 1 << 20:
        key, reach = key * width + padded[2 : n + 2], 3
    while True:
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[1], 1 + np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - reach, 0)] = rank[reach:]
        key, reach = rank * (n + 1) + after, 2 * reach


class FmIndex:
    """An FM-index of stretches of symbols (from 1 up), each with a separator (0) after it."""

    def __init__(self, symbols: np.ndarray, heads: np.ndarray, sigma: int) -> None:
        order = suffix_array(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        sampled = np.arange(len(symbols)) % SAMPLE == 0
        sampled[heads] = True  # a walk never leaves its stretch
        self.sampled = Bits(sampled[order])
        self.positions = order[sampled[order]]
        self.size = len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase that occurs, and which phrase it is."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for step in range(phrases.shape[1]):
            symbol = phrases[which, phrases.shape[1] - 1 - step]
            going = step < lengths[which]
            down = np.where(going, self.smaller[symbol] + self.matrix.rank(symbol, low), low)
            up = np.where(going, self.smaller[symbol] + self.matrix.rank(symbol, high), high)
            keep = down < up
            which, low, high = which[keep], down[keep], up[keep]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row's suffix: backward to a sampled one, and as many steps on."""
        steps, at, found = np.zeros(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            there = self.sampled.get(at[open_])
            done = open_[there]
            found[done] = self.positions[self.sampled.rank(at[done])] + steps[done]
            open_ = open_[~there]
            symbol = self.matrix.access(at[open_])
            at[open_] = self.smaller[symbol] + self.matrix.rank(symbol, at[open_])
            steps[open_] += 1
        return found


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` of them."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def occurrences(ids: np.ndarray, counts: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in a shard; ``ids`` are the words' ids (0: in no phrase), ``counts`` the rows' bounds."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(ids):
        return none, none
    known = ids > 0
    first = known.copy()
    first[1:] &= ~known[:-1]
    bounds = counts[1:-1][counts[1:-1] < len(ids)]
    first[bounds] = known[bounds]
    start = np.flatnonzero(first)
    last = known.copy()
    last[:-1] &= ~known[1:]
    last[bounds[bounds > 0] - 1] = known[bounds[bounds > 0] - 1]
    size = np.flatnonzero(last) + 1 - start
    long = size >= phrases.lengths.min()
    start, size = start[long], size[long]
    if not len(start):
        return none, none
    overlap = int(phrases.lengths.max()) - 1
    most = max(STRETCH, 4 * overlap)
    parts = np.maximum(1, -(-(size - overlap) // (most - overlap)))
    number = _ranges(np.zeros(len(parts), np.int64), parts)
    start = np.repeat(start, parts) + number * (most - overlap)
    size = np.minimum(most, np.repeat(size, parts) - number * (most - overlap))
    heads = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int((size + 1).sum()), np.int64)
    words = np.zeros(len(symbols), np.int64)
    into, from_ = _ranges(heads, size), _ranges(start, size)
    symbols[into], words[into] = ids[from_], from_
    index = FmIndex(symbols, heads, len(phrases.vocabulary) + 1)
    which, low, high = index.search(phrases.symbols, phrases.lengths)
    found = words[index.locate(_ranges(low, high - low))]
    pairs = np.unique(np.stack([found, np.repeat(which, high - low)]), axis=1)  # overlapping stretches tell some twice
    return pairs[0], pairs[1]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_MADE = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("removal_spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def _rows(data: np.ndarray, bounds: np.ndarray, phrases: Phrases, before: tuple[list, list] | None) -> list[tuple]:
    """(words, hit words, spans, items) of each text of a shard."""
    starts, ends, counts = word_spans(data, bounds, ALNUM_WORDS)
    hashes = word_hashes(data, starts, ends)
    at = np.searchsorted(phrases.vocabulary, hashes)
    if len(phrases.vocabulary):
        at = np.minimum(at, len(phrases.vocabulary) - 1)
        ids = np.where(phrases.vocabulary[at] == hashes, at + 1, 0)
    else:
        ids = np.zeros(len(hashes), np.int64)
    first, which = occurrences(ids, counts, phrases)
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + phrases.lengths[which], -1)
    hit = np.cumsum(change[:-1]) > 0
    text_of = np.searchsorted(counts, first, "right") - 1
    items: dict[int, set[str]] = {}
    for row, phrase in zip(text_of.tolist(), which.tolist(), strict=True):
        items.setdefault(row, set()).update(phrases.items[phrases.item_bounds[phrase] : phrases.item_bounds[phrase + 1]])
    out = []
    for row in range(len(bounds) - 1):
        a, b = int(counts[row]), int(counts[row + 1])
        spans: list[dict[str, int]] = []
        earlier = before[0][row] if before else []
        if row in items or earlier or hit[a:b].any():
            body = data[bounds[row] : bounds[row + 1]]
            points = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
            left, right = points[starts[a:b] - bounds[row]], points[ends[a:b] - bounds[row]]
            marked = hit[a:b].copy()
            for span in earlier:
                marked[np.searchsorted(left, span["start"]) : np.searchsorted(right, span["end"], "right")] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], marked, [0]])))
            spans = [{"start": int(left[x]), "end": int(right[y - 1])} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            n_hit = int(marked.sum())
        else:
            n_hit = 0
        listed = items.get(row, set()) | set(before[1][row] if before else [])
        out.append((b - a, n_hit, spans, sorted(listed)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """Find every window of ``n`` words of the benchmark's items in every document.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence), ``removal_spans``
    (merged, in code points, end exclusive) and ``items`` (ids as strings, in
    order, each once); columns of these names are replaced, all others stay.
    Words are runs of ASCII digits, letters (A-Z as a-z) and non-ASCII characters. A
    null text has no words; an item without words occurs nowhere, one with a null
    id marks words but isn't listed. The phrases of at most ``BLOCK`` bytes of
    benchmark text are broadcast at once; a larger benchmark takes one pass for each block.
    """
    made = [f.name for f in _MADE]
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK))
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, *_MADE])
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        shared = docs.sparkSession.sparkContext.broadcast(phrases_of([(r["i"], r["t"]) for r in part.collect()], n))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, again: bool = block > 0) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in batches:
                for row, data, bounds in pieces(batch.column(names.index(text)), SHARD):
                    shard = batch.slice(row, len(bounds) - 1)
                    before = (shard.column(len(names) + 2).to_pylist(), shard.column(len(names) + 3).to_pylist()) if again else None
                    found = list(zip(*_rows(data, bounds, phrases, before), strict=True))
                    columns = [pa.array(x, f) for x, f in zip(found, (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())), strict=True)]
                    yield pa.record_batch([*shard.columns[: len(names)], *columns], [*names, *made])

        kept = kept.mapInArrow(returning(run), schema)
    return kept
