"""What a worker needs for a shard, and what it keeps after one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stratavox.llm import decontaminate, words


def shards(column, phrases, size):
    """Rows of all shards of ``size`` bytes, and bytes needed at most beside them."""
    rows, most = [], 0
    for _, data, bounds in words.pieces(column, size):
        tracemalloc.start()
        found = decontaminate._rows(data, bounds, phrases, None)
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        rows += found
    return rows, most


@pytest.fixture
def texts():
    rnd = random.Random(5)
    known = [f"w{i}" for i in range(60)]
    items = [(f"i{k}", " ".join(rnd.choices(known, k=14))) for k in range(50)]
    docs = [" ".join(rnd.choices(known, k=1200) if k % 3 else [f"v{rnd.random()}", items[k % 50][1], *rnd.choices(known, k=1180)]) for k in range(900)]
    return pa.array([*docs, None, ""]), decontaminate.phrases_of(items, 10)


def test_a_shard_of_decontamination_fits_beside_an_executor(texts, monkeypatch):
    monkeypatch.setattr(words, "_powers", (np.ones(1, np.uint64),) * 2)
    rows, most = shards(*texts, decontaminate.SHARD)
    assert most < 60e6  # 120 MB with shards of 2 MB; every word here is in a phrase: the worst case
    assert sum(r[1] > 0 for r in rows) == 300
    assert rows == shards(*texts, 1 << 14)[0] == shards(*texts, 2 << 20)[0]


def test_powers_for_a_long_text_are_not_kept(monkeypatch):
    monkeypatch.setattr(words, "_powers", (np.ones(1, np.uint64),) * 2)
    text = b"ab cd " * 500_000
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.word_spans(data, np.array([0, len(data)]), words.SPACE_WORDS)
    found = words.word_hashes(data, starts, ends)
    short = words.word_hashes(data[:5], starts[:2], ends[:2])
    assert len(found) == 1_000_000 and (found[::2] == short[0]).all() and (found[1::2] == short[1]).all()
    assert sum(x.nbytes for x in words._powers) <= 16 * words.KEPT
