"""Language identification by Bloom filters over character n-grams, bit-sliced by language.

Row i of the filter table holds bit i of the filters of all languages, one bit
for each language. The AND of an n-gram's rows is the bitmask of all languages
that contain it; the popcounts of a text by language, corrected for the rate at
which a filter answers yes by chance, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.bpe import runs, text_runs
from stratavox.llm.words import mix, returning

#: Lengths of the n-grams; a word's start and end count as a character.
GRAM_SIZES = (3, 4)
#: Characters of texts whose n-grams are looked up together.
RUN_CHARS = 1 << 18
#: Slots (rows) of the filter table, and rows looked up for an n-gram: three of 20 bits of one hash.
SLOT_BITS, PROBES = 20, 3
#: An n-gram belongs to each language in which it is at least this often as frequent as in its most frequent one.
SHARE = 0.5
UNKNOWN = "und"
#: Rows of a language, if it has them, that are learned from however many languages there are.
LEAST_EACH = 200


@dataclass(frozen=True)
class Model:
    """The bit-sliced filters: ``table[slot, word]`` holds one bit for each language."""

    languages: list[str]
    table: np.ndarray
    by_chance: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, the bounds of each text's, and the texts' numbers of letters."""
    low = [x.lower() for x in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
    inside = _letters()[codes]
    codes = np.where(inside, codes, 0).astype(np.uint64)
    bounds = np.cumsum([0, *(len(x) + 1 for x in low)])
    sums = np.concatenate([[0], np.cumsum(inside)])
    found, at = [], []
    for n in GRAM_SIZES:
        size = max(len(codes) - n + 1, 0)
        good = np.ones(size, bool)
        for k in range(1, n - 1):
            good &= inside[k : k + size]
        start = np.flatnonzero(good)
        key = np.full(len(start), n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + codes[start + k]
        found.append(mix(key))
        at.append(start)
    # A gram that begins at the separator before a text belongs to that text.
    limits = [np.searchsorted(x, bounds) for x in at]
    order = [np.concatenate([x[a[i] : b[i]] for x, a, b in zip(found, [y[:-1] for y in limits], [y[1:] for y in limits], strict=True)]) for i in range(len(low))]
    sizes = np.cumsum([0, *(len(x) for x in order)])
    return np.concatenate(order) if order else np.zeros(0, np.uint64), sizes, sums[bounds[1:]] - sums[bounds[:-1]]


def _slots(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1) for k in range(PROBES)]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", grams_each: int = 40_000) -> Model:
    """Count n-grams by language on Spark; keep the ``grams_each`` most frequent of each language's own.

    What comes to the driver is bounded by ``grams_each`` n-grams for each
    language. Rows with a null text or language teach nothing; without any
    labelled row the model knows no language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(names)):
                for run in runs([t for t, x in zip(texts, names, strict=True) if x == name], RUN_CHARS):
                    keys, n = np.unique(grams(run)[0], return_counts=True)
                    yield pa.record_batch([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    counted = rows.mapInArrow(returning(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    most = F.max("share").over(Window.partitionBy("gram"))
    own = counted.withColumn("share", share).withColumn("most", most).where(F.col("share") >= SHARE * F.col("most"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = own.withColumn("rank", rank).where(F.col("rank") <= grams_each).select("lang", "gram").toPandas()
    languages = sorted(set(kept["lang"]))
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    fill = np.zeros(len(languages))
    for i, name in enumerate(languages):
        keys = kept.loc[kept["lang"] == name, "gram"].to_numpy(np.int64).view(np.uint64)
        for slot in _slots(keys):
            table[slot, i // 64] |= np.uint64(1 << i % 64)
        fill[i] = np.mean((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
    return Model(languages, table, fill**PROBES)


def evidence(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language the share of n-grams that the language contains, corrected for chance; and the letters."""
    keys, bounds, letters = grams(texts)
    slots = _slots(keys)
    shares = np.zeros((len(texts), len(model.languages)))
    total = np.maximum(np.diff(bounds), 1)
    for word in range(model.table.shape[1]):
        column = model.table[:, word]
        masks = column[slots[0]]
        for slot in slots[1:]:
            masks &= column[slot]
        for bit in range(min(64, len(model.languages) - 64 * word)):
            sums = np.concatenate([[0], np.cumsum((masks >> np.uint64(bit)) & np.uint64(1))])
            shares[:, 64 * word + bit] = np.diff(sums[bounds].astype(np.int64)) / total
    return np.maximum(shares - model.by_chance, 0) / (1 - model.by_chance), letters


def identify(df: DataFrame, model: Model, text: str = "text", least: float = 0.05) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``accepted``; columns of these names are replaced, all others stay.

    ``score`` is the best language's part of the evidence for all languages, 0 to
    1. A text that is null or has no letter is ``und`` with score 0, and so is
    every text where the model knows no language; ties go to the language first
    by name. A text is accepted if it isn't ``und`` and at least the share
    ``least`` of its n-grams belongs to its language.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c not in ("lang_pred", "score", "accepted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        languages = np.array([*known.languages, UNKNOWN], object)
        for batch in batches:
            for row, texts in text_runs(batch.column(names.index(text)), RUN_CHARS):
                shares, letters = evidence(known, texts)
                if known.languages:
                    best, sums = shares.argmax(1), shares.sum(1)
                    top = shares[np.arange(len(texts)), best]
                else:
                    best = sums = top = np.zeros(len(texts), np.int64)
                sure = (letters > 0) & (len(known.languages) > 0)
                score = np.where(sure & (sums > 0), top / np.where(sums > 0, sums, 1), 0.0)
                part = batch.slice(row, len(texts))
                made = [pa.array(np.where(sure, languages[best], UNKNOWN), pa.string()), pa.array(score), pa.array(sure & (top >= least))]
                yield pa.record_batch([*part.columns, *made], [*names, "lang_pred", "score", "accepted"])

    kept = df.select(*[F.col(f"`{c}`") for c in names])
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    schema = T.StructType([*kept.schema.fields, *made])
    return kept.mapInArrow(returning(run), schema)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rows_each(counts: list[int], most: int) -> int:
    """The largest bound for each language with which all languages together have at most ``most`` rows, but ``LEAST_EACH`` at least."""
    left = most
    for k, n in enumerate(sorted(counts)):
        each = left // (len(counts) - k)
        if n > each:
            return max(each, LEAST_EACH)
        left -= n
    return max(counts, default=LEAST_EACH)


def training_rows(docs: DataFrame, most: int = 20_000) -> DataFrame:
    """Labelled documents, none of them held out, picked by a hash of the id; null ids teach nothing.

    Up to ``most`` rows all are taken. Beyond, about ``rows_each`` of each
    language, and all rows of a language that has fewer; the row of the smallest
    hash is always among them, so every labelled language is learned.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 48))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()
    if sum(r.n for r in counts) <= most:
        return rows
    each = rows_each([r.n for r in counts], most)
    limits = [(r.lang, max((1 << 48) * min(each, r.n) // r.n, r.first + 1)) for r in counts]
    bounds = docs.sparkSession.createDataFrame(limits, "lang string, _below long")
    return rows.join(F.broadcast(bounds), "lang").where(place < F.col("_below")).select(*docs.columns)
