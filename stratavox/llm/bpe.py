"""BPE encoding and decoding with a pair occurrence index.

Texts are cut at white space; the distinct chunks that a task hasn't met yet are
merged together. One index maps each pair of adjacent symbols to all its
positions in them. Active ranks are taken in ascending order: all positions of a
pair merge at once, and only the lists of the pairs beside them change.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stratavox.llm.words import Batches, returning

#: Characters of one run of texts, and remembered chunks after which a task forgets them all.
RUN_CHARS = 1 << 20
MEMORY_CHUNKS = 150_000

# Fixed values of the tokenizer's format: its pattern for lower-case ASCII, and white space that str.split() knows but \s does not.
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_CHUNK = regex.compile(r"\S+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizer file of kind BPE with word ends; read once by each Python worker."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, added = spec["model"], spec["added_tokens"]
        ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.tokens = [""] * (max([*ids.values(), *(x["id"] for x in added)]) + 1)
        for token, i in [*ids.items(), *((x["content"], x["id"]) for x in added)]:
            self.tokens[i] = token
        self.special = {x["content"]: x["id"] for x in added}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        library = Tokenizer.from_str(text)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        letters = byte_letters()
        self.byte = {c: b for b, c in enumerate(letters)}
        self.plain = np.array([ids.get(c, -1) for c in letters], np.int64)
        self.closing = np.array([ids.get(c + self.suffix, -1) for c in letters], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        merged = [a + b for a, b in pairs]
        if len(set(merged)) < len(merged):
            raise ValueError("two merges make the same token: merging all positions of a rank at once would not be exact")
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.pair = keys
        self.made = np.array([ids[x] for x in merged], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def words(self, chunk: str) -> list[bytes]:
        """The UTF-8 words of a chunk without white space, normalised and split as the file says.

        ASCII and plain Latin words take a short way; for all others the library's
        own normaliser and splitter decide, as they fix the Unicode version.
        """
        low = chunk.lower()
        if chunk.isascii():
            return [low.encode()] if chunk.isalpha() else [x.encode() for x in _ASCII_WORD.findall(low)]
        if low.isalpha() and max(low) < "\u0250":
            return [low.encode()]
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return [bytes(map(self.byte.__getitem__, x)) for x, _ in found]


@lru_cache(maxsize=1)
def token_list(path: str) -> list[str]:
    """The tokens of a tokenizer file by id: all that decoding needs."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    named = [*spec["model"]["vocab"].items(), *((x["content"], x["id"]) for x in spec["added_tokens"])]
    tokens = [""] * (max(i for _, i in named) + 1)
    for token, i in named:
        tokens[i] = token
    return tokens


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def once(at: np.ndarray) -> np.ndarray:
    """``at`` in order, each position once."""
    at = np.sort(at)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


class PairIndex:
    """All symbols of many words in a row, and the positions of each pair that can merge."""

    def __init__(self, vocab: Vocabulary, words: list[bytes]) -> None:
        self.vocab = vocab
        lengths = np.array([len(x) for x in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        self.ends = np.cumsum(lengths)
        self.symbols = vocab.plain[data]
        last = self.ends[lengths > 0] - 1
        self.symbols[last] = vocab.closing[data[last]]
        self.after = np.arange(1, len(data) + 1)
        self.after[last] = -1
        self.before = np.arange(-1, len(data) - 1)
        self.before[self.ends[:-1][lengths[1:] > 0]] = -1
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.after >= 0))

    def _add(self, at: np.ndarray) -> None:
        """List the pairs that start at ``at`` under their ranks."""
        rank = self.vocab.ranks(self.symbols[at], self.symbols[self.after[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for one, r in zip(np.split(at, cuts), rank[np.r_[0, cuts]].tolist() if len(rank) else [], strict=False):
            if r not in self.positions:
                self.positions[r] = []
                heapq.heappush(self.active, r)
            self.positions[r].append(one)

    def merge_all(self) -> None:
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.positions.pop(rank)
            at = lists[0] if len(lists) == 1 else once(np.concatenate(lists))
            left, right = int(self.vocab.pair[rank]) >> 32, int(self.vocab.pair[rank]) & 0xFFFFFFFF
            at = at[(self.symbols[at] == left) & (self.after[at] >= 0)]
            at = at[self.symbols[self.after[at]] == right]
            if left == right and len(at) > 1:
                at = self._from_the_left(at)
            if not len(at):
                continue
            gone = self.after[at]
            then = self.after[gone]
            self.symbols[at], self.symbols[gone] = self.vocab.made[rank], -1
            self.after[at] = then
            self.before[then[then >= 0]] = at[then >= 0]
            prior = self.before[at]
            self._add(once(np.concatenate([prior[prior >= 0], at[then >= 0]])))

    def _from_the_left(self, at: np.ndarray) -> np.ndarray:
        """Of overlapping positions of a pair of equal symbols, every second one from the left of each run."""
        joined = np.zeros(len(at), bool)
        joined[1:] = self.after[at[:-1]] == at[1:]
        heads = np.flatnonzero(~joined)
        place = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
        return at[place % 2 == 0]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's end."""
        alive = self.symbols >= 0
        return self.symbols[alive].astype(np.int32), np.concatenate([[0], np.cumsum(alive)])[self.ends]


def gather(values: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``at`` of ``values`` in a row, and their ends."""
    size = bounds[at + 1] - bounds[at]
    ends = np.cumsum(size)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[at] - (ends - size), size)
    return values[take], ends


class Encoder:
    """Ids of texts; remembers the chunks of the task, so each distinct one is merged once."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.word_index: dict[bytes, int] = {}
        self.word_ids, self.word_bounds = self.ids, self.bounds

    def learn(self, chunks: list[str]) -> None:
        """Merge the words of new chunks together through one pair index."""
        counts, at, new = [], [], {}
        known, first = self.word_index, len(self.word_index)
        for chunk in chunks:
            found = self.vocab.words(chunk)
            counts.append(len(found))
            for word in found:
                k = known.get(word)
                at.append(new.setdefault(word, first + len(new)) if k is None else k)
        if new:
            merging = PairIndex(self.vocab, list(new))
            merging.merge_all()
            ids, ends = merging.tokens()
            known.update(new)
            self.word_bounds = np.concatenate([self.word_bounds, ends + len(self.word_ids)])
            self.word_ids = np.concatenate([self.word_ids, ids])
        ids, ends = gather(self.word_ids, self.word_bounds, np.array(at, np.int64))
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        self.index.update(zip(chunks, range(len(self.index), len(self.index) + len(chunks)), strict=True))
        self.bounds = np.concatenate([self.bounds, last + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their bounds."""
        if len(self.index) > MEMORY_CHUNKS:
            self.forget()
        parts = [self._parts(x) for x in texts]
        seen = set().union(*parts)
        special = seen & self.vocab.special.keys()
        new = [x for x in seen if x not in self.index and x not in special]
        if new:
            self.learn(new)
        if special:  # each is one more chunk, of one id
            for mark in special - self.index.keys():
                self.index[mark] = len(self.index)
                self.ids = np.append(self.ids, np.int32(self.vocab.special[mark]))
                self.bounds = np.append(self.bounds, len(self.ids))
        counts = np.array([len(x) for x in parts], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        ids, ends = gather(self.ids, self.bounds, at)
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def _parts(self, text: str) -> list[str]:
        """Chunks without white space; a special token is a chunk of its own."""
        if self.vocab.at_special and any(x in text for x in self.vocab.special):
            out: list[str] = []
            for k, part in enumerate(self.vocab.at_special.split(text)):
                out += [part] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if _NOT_SPACE.search(text) else text.split()


def runs(texts: list[str], limit: int = RUN_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters."""
    run: list[str] = []
    size = 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def text_runs(column: pa.Array, limit: int = RUN_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about ``limit`` bytes, made into strings one run at a time; a null is empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, row = np.cumsum(sizes, dtype=np.int64), 0
    while row < len(ends):
        done = ends[row - 1] if row else 0
        end = min(len(ends), max(row + 1, int(np.searchsorted(ends, done + limit, "right"))))
        yield row, [x or "" for x in column.slice(row, end - row).to_pylist()]
        row = end


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    if name in batch.schema.names:
        return batch.set_column(batch.schema.get_field_index(name), name, column)
    return batch.append_column(name, column)


def _schema(df: DataFrame | T.StructType, name: str, kind: T.DataType) -> T.StructType:
    fields = df.fields if isinstance(df, T.StructType) else df.schema.fields
    made = [T.StructField(f.name, kind) if f.name == name else f for f in fields]
    return T.StructType(made if any(f.name == name for f in fields) else [*made, T.StructField(name, kind)])


def _encoding(path: str, text: str, ids: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            for row, texts in text_runs(batch.column(text)):
                values, bounds = encoder.encode(texts)
                made = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
                yield _with(batch.slice(row, len(texts)), ids, made)

    return run


def _decoding(path: str, ids: str, decoded: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        tokens = token_list(path)
        last = len(tokens)
        for batch in batches:
            for row in range(0, batch.num_rows, 128):
                part = batch.slice(row, 128)
                lists = part.column(ids)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                good = len(flat) == 0 or lists.flatten().null_count == 0 and 0 <= flat.min() and flat.max() < last
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes).tolist()
                names = [tokens[int(x)] if x == x and 0 <= x < last else "" for x in flat] if not good else list(map(tokens.__getitem__, flat.tolist()))
                out = [" ".join(names[b - n : b] if good else filter(None, names[b - n : b])) for n, b in zip(sizes.tolist(), ends, strict=True)]
                yield _with(part, decoded, pa.array(out, pa.string()))

    return run


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the token ids of column ``text`` as an array; a column of that name is replaced.

    The whole text is encoded as the tokenizer file at ``path`` says, special
    tokens in it included. A null or empty text gives an empty array. Rows, their
    order in a partition and all other columns stay as they are.
    """
    return df.mapInArrow(returning(_encoding(path, text, ids)), _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of token ids: the tokens joined by spaces, as the file names no decoder; special tokens stay.

    Null or empty ids give an empty text; ids outside the vocabulary are left out.
    """
    return df.mapInArrow(returning(_decoding(path, ids, decoded)), _schema(df, decoded, T.StringType()))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one pass over each partition, in one Python worker; column ``text`` goes."""
    encoding, decoding = _encoding(path, text, ids), _decoding(path, ids, decoded)

    def coded(batches: Batches) -> Batches:
        for batch in encoding(batches):
            yield batch.drop_columns([text])

    schema = _schema(_schema(df.drop(text), ids, T.ArrayType(T.IntegerType())), decoded, T.StringType())
    return df.mapInArrow(returning(lambda batches: decoding(coded(batches))), schema)
