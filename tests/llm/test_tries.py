"""op12 against brute force: every prefix of every rebuilt conversation in a dict."""

import hashlib
import random
import re
import zlib

import pytest

from stratavox.llm import registry, tries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    said = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:32]
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, said(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, own_ in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + (len(own_) - 1) * words
    out = []
    for node, own_ in members.items():
        ends = ",".join(str(c) for c in sorted(own_) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_), len(node), parent, len(own_), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def hostile(seed, convs=90, long=0):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(convs), -7, -25, 1003, 2040]:
        if rnd.random() < 0.2:
            continue  # so some bases are absent
        for t in range(rnd.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rnd.choice([t, t, 2, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "a b c", "", None, "x" * t, " \x0b é "])))
    rows += [(c, t, "user", f"copy {t} of it") for c in range(3000, 3060) for t in range(4)]
    rows += [(5000, t, "user", f"t{t % 7}") for t in range(long)] + [(5001, t, "user", f"t{t % 7}") for t in range(long // 2)]
    rows += [rows[3], rows[3], (None, 1, "user", "nobody")] * 3
    rnd.shuffle(rows)
    return rows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def test_query_equals_brute_force(spark, tmp_path):
    rows = hostile(1)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", n int").withColumnRenamed("n", "digest")
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["op12_tries"](spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert found(got) == brute(rows)


def test_long_conversations_span_tasks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 16)
    monkeypatch.setattr(tries, "MEMBERS", 8)
    rows = hostile(2, 30, long=300)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "7"), strict=True):
        spark.conf.set(n, v)
    try:
        turns, convs = tries.in_order(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert turns.where("conv = 5000").select("pos").distinct().count() == 300
        assert found(tries.trie(*tries.share_openings(turns, convs))) == brute(rows)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")], [(1, None, None, None)], [(1, 0, "user", "x")] * 5])
def test_small_tables(spark, rows):
    turns, convs = tries.in_order(spark.createDataFrame(rows, SCHEMA))
    assert found(tries.trie(*tries.share_openings(turns, convs))) == brute(rows)


def test_often_named_nodes_give_the_same_rows(spark, monkeypatch):
    rows = hostile(3, 40)
    turns, convs = tries.in_order(spark.createDataFrame(rows, SCHEMA))
    for heavy in (1, 1 << 40):
        monkeypatch.setattr(tries, "HEAVY", heavy)
        assert found(tries.trie(*tries.share_openings(turns, convs))) == brute(rows)
