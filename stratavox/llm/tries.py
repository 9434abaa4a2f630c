"""A trie of conversations by their opening turns, rolled up by pointer jumping.

Turns are numbered in one sort by ranges, so a conversation may be longer than any
task. A prefix is named by a digest that grows by one term a turn (bitwise, so
running digests are window sums in blocks); equal prefixes have equal digests, and
the digest without its last term is the parent's: edges need no join. Sums over
subtrees take as many rounds as the logarithm of the depth: each round adds what the
nodes at most 2^k below have gathered to their ancestor at 2^k, then every node's
pointer jumps to the one that its ancestor points to.

Hot nodes (the root, a common first turn) are never one task's: counts and sums are
combined before they are shuffled, look-ups of often named nodes are broadcast (there
are fewer than ``HEAVY`` of them at any size), and members meet in blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.tables import forget, settle
from stratavox.llm.words import Batches, returning

#: Turns of a block in which running digests are computed, and ids of one block of a node's members.
BLOCK, MEMBERS = 4096, 1024
#: A node counts as often named if more than one of so many rows name it.
HEAVY = 1000
#: Words of a text, by the contract's white space.
WORD = r"[^\x20\x09-\x0D]+"


def _numbers(batches: Batches) -> Batches:
    """Number the sorted rows of a task within their conversations; a row is held back until it is known whether it is the last."""
    part, before, at, held = TaskContext.get().partitionId(), None, 0, None

    def closed(last: bool) -> pa.RecordBatch:
        return pa.record_batch([*held.columns, pa.array([last])], ["conv", "digest", "words", "part", "at", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        new = np.concatenate([[before is None or conv[0] != before], conv[1:] != conv[:-1]])
        if held is not None:
            yield closed(bool(new[0]))
        starts = np.flatnonzero(new)
        count = np.arange(len(conv))
        run = np.searchsorted(starts, count, "right") - 1
        places = np.where(run >= 0, count - starts[run] if len(starts) else 0, count + at)
        last = np.concatenate([new[1:], [False]])
        rows = pa.record_batch([batch.column("conv"), batch.column("digest"), batch.column("words"), pa.array(np.full(len(conv), part, np.int32)), pa.array(places)], ["conv", "digest", "words", "part", "at"])
        done = rows.slice(0, len(conv) - 1)
        yield pa.record_batch([*done.columns, pa.array(last[:-1])], ["conv", "digest", "words", "part", "at", "last"])
        held, before, at = rows.slice(len(conv) - 1), conv[-1], int(places[-1]) + 1
    if held is not None:
        yield closed(True)


def in_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation as (``conv``, ``pos``, ``digest``, ``words``, ``last``), and conversations as (``conv``, ``n``).

    Positions count from 0 by ``turn``, null first, ties by the digest of role and
    text. A null role or text is empty. Rows without a conversation are left out;
    repeated rows are turns of their own. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    # the row's number only lets many equal rows go to several tasks
    sorted_ = rows.repartitionByRange("conv", "turn", "digest", "row").sortWithinPartitions("conv", "turn", "digest")
    schema = "conv long, digest binary, words long, part int, at long, last boolean"
    placed = settle(sorted_.select("conv", "digest", "words").mapInArrow(returning(_numbers), schema), "turns")
    whole = Window.partitionBy("conv")
    earlier = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    pieces = placed.where("last").select("conv", "part", (F.col("at") + 1).alias("n"))
    pieces = pieces.select("conv", "part", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n"), (F.col("part") == F.max("part").over(whole)).alias("final"))
    pieces = settle(pieces, "pieces")
    # a task has one piece at most that began before it, and one that goes on after it
    cut = pieces.where("before > 0 OR NOT final").select("conv", "part", "before", "final")
    turns = placed.join(F.broadcast(cut), ["conv", "part"], "left").select(
        "conv",
        (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"),
        "digest",
        "words",
        (F.col("last") & F.coalesce("final", F.lit(True))).alias("last"),
    )
    return turns, pieces.where("final").select("conv", "n")


def share_openings(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c: the first h turns of c - c % ``every``, then its own turns after its first h; h = crc32(c) % ``most``.

    Of fewer than h turns all are taken, of an absent conversation none. Returns
    what :func:`in_order` returns; conversations without turns are among them.
    """
    opening = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    info = convs.select("conv", "n", opening(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    info = info.join(base, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    info = settle(info.select("conv", "n", "h", "base", "m"), "openings")
    moved = info.where("m < h AND n > h").select("conv", (F.col("m") - F.col("h")).alias("shift"))
    own = turns.where(F.col("pos") >= opening(F.col("conv"))).join(moved, "conv", "left")
    own = own.select("conv", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "digest", "words", "last")
    first = turns.where((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv").alias("base"), "pos", "digest", "words")
    copied = first.join(info.where("h > 0"), "base").where("pos < h")
    copied = copied.select("conv", "pos", "digest", "words", ((F.col("n") <= F.col("h")) & (F.col("pos") == F.col("m") - 1)).alias("last"))
    return own.unionByName(copied), info.select("conv", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _key(depth: Column, x: Column, y: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), x.cast("string"), y.cast("string")).cast("binary")))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one too: (``key``, ``parent``, ``depth``, ``conv``, ``words``, ``last``).

    A turn's term is a digest of it and its position; a prefix's digest is the
    exclusive or of its terms, 120 bits.
    """
    term = F.sha2(F.concat(F.col("digest"), F.col("pos").cast("string").cast("binary")), 256)
    lanes = {c: F.conv(F.substring(term, 1 + 15 * i, 15), 16, 10).cast("long") for i, c in enumerate("xy")}
    rows = turns.withColumns({"block": F.floor(F.col("pos") / BLOCK), **lanes})
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"in_x": F.bit_xor("x").over(inside), "in_y": F.bit_xor("y").over(inside)})
    rows = settle(rows, "terms")
    # only a block that is full has one after it, and its last turn has the whole block's digest
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    full = rows.where(F.col("pos") % BLOCK == BLOCK - 1)
    carried = full.select("conv", (F.col("block") + 1).alias("block"), F.bit_xor("in_x").over(earlier).alias("b_x"), F.bit_xor("in_y").over(earlier).alias("b_y"))
    later = rows.where("block > 0").join(carried, ["conv", "block"], "left").withColumns({c: F.col(c).bitwiseXOR(F.coalesce(b, F.lit(0))) for c, b in (("in_x", "b_x"), ("in_y", "b_y"))})
    rows = rows.where("block = 0").unionByName(later.drop("b_x", "b_y"))
    depth = F.col("pos") + 1
    before = _key(F.col("pos"), F.col("in_x").bitwiseXOR(F.col("x")), F.col("in_y").bitwiseXOR(F.col("y")))
    rows = rows.select(_key(depth, F.col("in_x"), F.col("in_y")).alias("key"), before.alias("parent"), depth.alias("depth"), "conv", "words", "last")
    zero = F.lit(0).cast("long")
    roots = convs.select(_key(zero, zero, zero).alias("key"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), "conv", zero.alias("words"), (F.col("n") == 0).alias("last"))
    return rows.unionByName(roots)


def _hash_members(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Digests of sorted blocks of ids, fed to the hash one after another: however many members a node has, one block is held."""
    key, state = None, None
    for batch in batches:
        keys, digests = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.as_py().encode())
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def _members(ends: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, ascending and joined by commas."""
    blocks = ends.groupBy("key", F.floor(F.col("conv") / MEMBERS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    laid = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids")
    return laid.mapInArrow(returning(_hash_members), "key binary, ends_sha256 string")


def _looked_up(rows: DataFrame, by: str, table: DataFrame, often: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``table`` on ``by``. ``often`` tells how many rows (``n``) name each value: those with more than a thousandth are broadcast."""
    many = often.where(F.col("n") * HEAVY > total).select(by)
    some = rows.join(F.broadcast(table.join(F.broadcast(many), by, "leftsemi")), by)
    rest = rows.join(F.broadcast(many), by, "leftanti").join(table, by)
    return some.unionByName(rest)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations, given as :func:`in_order` returns them, one row each.

    ``conv_id`` is the smallest member, ``depth`` the number of turns,
    ``parent_conv_id`` the parent's smallest member (null for the root), ``n_convs``
    the members, ``n_children`` the children, ``n_leaves`` the childless nodes of
    the subtree, ``saved_tokens`` the words that members share with another one,
    summed over the subtree, and ``ends_sha256`` a digest of the members that end
    here. No conversations give no nodes; a conversation without turns is a member
    of the root alone.
    """
    met = settle(prefixes(turns, convs), "prefixes")
    nodes = met.groupBy("key").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("words").alias("words"),
        F.count_if("last").alias("ends"),
    )
    # a member that doesn't end here goes on to a child, so a node where all end has none
    nodes = settle(
        nodes.select("key", "parent", "depth", "conv_id", "n_convs", (F.col("ends") == F.col("n_convs")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")),
        "nodes",
    )
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    active = nodes.where("depth > 0").select("key", "depth", F.col("parent").alias("up"), "leaves", "saved")
    gains, reach = [], 1
    while reach <= deepest:
        gain = settle(active.groupBy("up").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("n")), "gains")
        gains.append(gain)
        if 2 * reach <= deepest:
            jumps = active.select(F.col("key").alias("up"), F.col("up").alias("next"))
            deep = _looked_up(active.where(F.col("depth") >= 2 * reach), "up", jumps, gain, active.count()).drop("up").withColumnRenamed("next", "up")
            more = gain.select(F.col("up").alias("key"), F.col("leaves").alias("l"), F.col("saved").alias("s"))
            deep = deep.join(more, "key", "left")
            new = settle(deep.select("key", "depth", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "jumped")
            if reach > 1:
                forget(active)
            active = new
        reach *= 2
    none = F.lit(None)
    rows = nodes.withColumns({"n": none.cast("long"), "ends_sha256": none.cast("string")})
    for k, gain in enumerate(gains):
        rows = rows.unionByName(gain.select(F.col("up").alias("key"), "leaves", "saved", (F.col("n") if k == 0 else none.cast("long")).alias("n")), allowMissingColumns=True)
    rows = rows.unionByName(_members(met.where("last").select("key", "conv")), allowMissingColumns=True)
    own = [F.max(c).alias(c) for c in ("parent", "depth", "conv_id", "n_convs")]
    total = rows.groupBy("key").agg(*own, F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("n_children"), F.max("ends_sha256").alias("ends_sha256"))
    total = settle(total.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie")
    named = total.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    often = total.select(F.col("key").alias("parent"), F.col("n_children").alias("n"))
    below = _looked_up(total.where("depth > 0"), "parent", named, often, total.count())
    found = below.unionByName(total.where("depth = 0").withColumn("parent_conv_id", none.cast("long")))
    forget(met, *gains, *([active] if len(gains) > 1 else []))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
