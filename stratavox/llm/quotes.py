"""Chat formatting by quotation linking, with DataFrame functions.

Quoted lines are parsed by their nesting level; runs of one level are passages.
Passages, their sentences and their lines are normalised and hashed; the hashes
find the latest earlier message of the conversation that holds the same as its
own, however a mail client wrapped the quote. Messages then follow the messages
that they answer, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratavox.llm.tables import forget, settle

#: Turns of one block of the search for the latest earlier line; a key's rows are never all in one task.
BLOCK = 1024

# Possessive: Java matches it in a loop, so that a line of very many marks needs no stack.
_MARK = r"^((?:[ \t]{0,3}+>)++)[ \t]?"
#: Ends of sentences in a normalised passage, and what is hashed, the strongest last.
_SENTENCE = r"(?<=[.!?]) "
KINDS = ("line", "sentence", "passage")


def level_of(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARK, 1), "[^>]", ""))


def content_of(line: Column) -> Column:
    """A line without its quote marks."""
    return F.regexp_replace(line, _MARK, "")


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def own_text(text: Column) -> Column:
    """A message without quoted lines, and without the blank lines around what is left."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: level_of(x) == 0)
    return F.rtrim(F.regexp_replace(F.array_join(lines, "\n"), r"^\s*+(?<=\n)", ""), F.lit(" \t\n\x0b\f\r"))


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, kind, unit): the normalised lines, sentences and passages of each message, by quote level.

    A passage is a run of lines of one level without a blank one, joined by single spaces. ``kind`` is a place in ``KINDS``.
    """
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(level_of(x).alias("level"), _normalised(content_of(x)).alias("line")))
    rows = messages.select("conv_id", "turn", F.transform(lines, lambda x: F.struct(F.when(x["line"] == "", -1).otherwise(x["level"]).alias("level"), x["line"].alias("line"))).alias("lines"))
    rows = rows.withColumn("starts", F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 OR lines[i].level != lines[i - 1].level)"))
    runs = "transform(starts, (s, k) -> struct(lines[s].level AS level, array_join(transform(slice(lines, s + 1, coalesce(get(starts, k + 1), size(lines)) - s), x -> x.line), ' ') AS unit))"
    rows = rows.withColumn("runs", F.filter(F.expr(runs), lambda x: x["level"] >= 0))

    def of(kind: int, level: Column, unit: Column) -> Column:
        return F.struct(level.alias("level"), F.lit(kind).alias("kind"), unit.alias("unit"))

    every = F.concat(
        F.transform(F.filter("lines", lambda x: x["level"] >= 0), lambda x: of(0, x["level"], x["line"])),
        F.flatten(F.transform("runs", lambda x: F.transform(F.split(x["unit"], _SENTENCE), lambda y: of(1, x["level"], y)))),
        F.transform("runs", lambda x: of(2, x["level"], x["unit"])),
    )
    return rows.select("conv_id", "turn", F.explode(every).alias("u")).select("conv_id", "turn", "u.*")


def _latest_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """To each row the latest ``own`` of the same keys at a smaller ``turn``, in two steps: over blocks of turns, then within one.

    A hot key's rows spread over its blocks; only one row for each block meets in one window.
    """
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = rows.groupBy(*keys, "block").agg(F.max("own").alias("last"))
    over_blocks = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.max("last").over(over_blocks).alias("earlier"))
    within = Window.partitionBy(*keys, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.max("own").over(within)).join(blocks, [*keys, "block"]).withColumn("origin", F.coalesce("inside", "earlier"))


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages whose outermost quote was found in an earlier message.

    A quoted unit belongs to the latest earlier message that has it as its own. The
    parent is the message to which most level-1 passages belong; where none is found,
    sentences decide, then lines; of several messages it is the latest. Deeper levels
    decide only where level 1 is found nowhere.
    """
    found = units(messages).select("conv_id", "turn", "level", "kind", F.xxhash64("unit").alias("h1"), F.hash("unit").alias("h2"))
    keys = ["conv_id", "kind", "h1", "h2"]
    rows = found.groupBy(*keys, "turn", "level").agg(F.count("*").alias("n"))
    wanted = found.where("level > 0").select(*keys).distinct()
    rows = rows.join(wanted, keys, "leftsemi").withColumn("own", F.when(F.col("level") == 0, F.col("turn")))
    found = _latest_before(rows, keys).where("level > 0 AND origin IS NOT NULL")
    votes = found.groupBy("conv_id", "turn", "level", "kind", "origin").agg(F.sum("n").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "kind", "n", "origin")).alias("b"))
    return best.select("conv_id", "turn", F.col("b.origin").alias("parent_turn"))


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the first message of each linked message's chain, by pointer doubling."""
    now = settle(links.select("conv_id", "turn", F.col("parent_turn").alias("thread")), "threads")
    while True:
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        step = settle(now.join(above, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")), "threads")
        forget(now)
        now = step.drop("moved")
        if not step.where("moved").head(1):
            return now


def link(messages: DataFrame) -> DataFrame:
    """One row for each message: ``conv_id``, ``turn``, ``role``, ``content`` (without quotes), ``parent_turn``, ``thread``, ``depth``, ``n_quoted``.

    ``thread`` is the first turn of the chain of parents, the message's own where
    nothing is quoted. Rows come ordered by conversation, thread and turn: every
    reply after what it answers. ``depth`` is the deepest quote level and
    ``n_quoted`` the number of quoted lines. Null texts are empty. Messages with a
    null conversation or turn link with nothing and are their own thread. Of rows that
    repeat a conversation and turn each gives a row; they have one parent.
    """
    rows = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    found = settle(parents(rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")), "parents")
    chains = found.join(roots(found), ["conv_id", "turn"])
    levels = F.transform(F.split("text", "\n", -1), level_of)
    rows = rows.withColumns({"content": own_text(F.col("text")), "_levels": levels})
    out = rows.join(chains, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "content",
        "parent_turn",
        F.coalesce("thread", "turn").alias("thread"),
        F.array_max("_levels").cast("long").alias("depth"),
        F.size(F.filter("_levels", lambda x: x > 0)).cast("long").alias("n_quoted"),
    )
    return out.orderBy("conv_id", "thread", "turn")
