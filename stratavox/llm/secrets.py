"""Secret scans with DataFrame functions only: fixed patterns, and Markov models of characters for all else.

Two first-order models, of random strings and of ordinary identifiers, are
trained from labelled samples. A run of token characters that the patterns left
is a secret if the ratio of its likelihoods is high enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.tables import set_aside, settle

# The patterns of the contract by kind, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Runs that the models judge, the characters that they know, and the mean log-likelihood ratio a transition from which on a run is a secret.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_RATIO = 0.25
#: A token character, and what stands for it where a pattern's match covers it (a private character; the text's own are taken for ``OTHER``, which no pattern holds either).
TOKEN, COVERED, OTHER = "[A-Za-z0-9+/_=-]", "\ue000", "\ue001"
#: Rows of a chunk of an array, and characters of a piece of a text.
CHUNK, PIECE = 256, 4096


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratios (random over ordinary) of the transitions between two characters; place 0 is any other one."""

    values: list[float]


def _classes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(labelled: DataFrame, value: str = "value", random: str = "random") -> Ratios:
    """Count transitions of the labelled samples (a string, and whether it is random) on Spark.

    What comes to the driver are counts by label and transition, bounded by the
    alphabet. Every transition counts once more than it was seen, so that an
    untrained model's ratios are 0. Null values or labels teach nothing.
    """
    size = len(ALPHABET) + 1
    rows = labelled.select(F.col(value).alias("v"), F.col(random).alias("r")).dropna()
    rows = rows.select("r", _classes(F.col("v")).alias("c")).where(F.size("c") > 1)
    step = F.expr(f"explode(transform(sequence(1, size(c) - 1), i -> c[i - 1] * {size} + c[i]))")
    counts = {True: [1.0] * size * size, False: [1.0] * size * size}
    for row in rows.select("r", step.alias("t")).groupBy("r", "t").count().collect():
        counts[row["r"]][row["t"]] += row["count"]
    logs = {}
    for label, n in counts.items():
        sums = [sum(n[a * size : a * size + size]) for a in range(size)]
        logs[label] = [math.log(n[k] / sums[k // size]) for k in range(size * size)]
    return Ratios([round(a - b, 4) for a, b in zip(logs[True], logs[False], strict=True)])


def mean_ratio(value: Column, ratios: Ratios) -> Column:
    """The mean log-likelihood ratio of the transitions of a string; null if it has none."""
    size = len(ALPHABET) + 1
    table = F.split(F.lit(" ".join(map(str, ratios.values))), " ").cast("array<double>")

    def of(c: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda a, i: a + F.get(table, F.get(c, i - 1) * size + F.get(c, i)))
        return F.when(F.size(c) > 1, total / (F.size(c) - 1))

    return F.element_at(F.transform(F.array(_classes(value)), of), 1)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _before(rows: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of the values of all rows before each, from 0 on.

    Rows go in chunks, first chunk by chunk, then within each: an array that grew row by row would be copied for every row.
    """

    def grown(rows: Column, start: Column, value: Callable[[Column], Column]) -> Column:
        empty = F.struct(start.alias("at"), F.expr("CAST(array() AS array<int>)").alias("all"))
        step = lambda a, x: F.struct(join(a["at"], value(x)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
        return F.aggregate(rows, empty, step, lambda a: a["all"])

    last = F.floor((F.size(rows) - 1) / CHUNK).cast("int")
    chunks = F.when(F.size(rows) > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))).otherwise(F.slice(F.array(rows), 1, 0))

    def within(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: join(a, value(x))))
        starts = grown(totals, F.lit(0), lambda t: t)
        return F.flatten(F.zip_with(chunks, starts, lambda ch, start: grown(ch, start, value)))

    return _let(chunks, within)


def _parts(text: Column, pattern: str, group: int = 0) -> tuple[Column, Column]:
    """What stands before each leftmost non-overlapping match (``b``), the match (``m``) and a group of it (``v``); and all that stands between them."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m"), values.alias("v")), between


def _found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: what stands between matches and the matches, laid end to end."""
    order = F.lit(KINDS.index(kind))

    def spans(rows: Column) -> Column:
        before = _before(rows, lambda x: F.length(x["b"]) + F.length(x["m"]), lambda a, n: a + n)
        start = lambda x, at: at + F.length(x["b"])
        made = F.zip_with(rows, before, lambda x, at: F.struct(start(x, at).alias("start"), order.alias("kind"), (start(x, at) + F.length(x["m"])).alias("end"), x["v"].alias("value")))
        return F.filter(made, lambda x: F.length(x["value"]) >= least) if least else made

    return _let(_parts(text, pattern, group)[0], spans)


def _masked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text with ``COVERED`` in place of the token characters of all matches."""
    rows, between = _parts(text, pattern, group)
    hidden = lambda x: F.when(F.length(x["v"]) >= least, F.regexp_replace(x["m"], TOKEN, COVERED)).otherwise(x["m"])
    return F.concat(F.array_join(F.transform(rows, lambda x: F.concat(x["b"], hidden(x))), ""), F.element_at(between, -1))


_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def scan(df: DataFrame, ratios: Ratios, text: str = "text") -> DataFrame:
    """Add ``spans``, the array of all spans of secrets in column ``text`` (replaced if there), by start and then kind.

    A span has ``start`` and ``end`` (code points, end exclusive), ``kind`` (its
    place in ``KINDS``) and ``value``. Patterns are searched for leftmost and
    non-overlapping, each kind by itself. Of the runs of token characters that
    overlap none of these spans, those whose mean ratio is at least
    ``LEAST_RATIO`` and that hold a letter and a digit are spans of kind markov.
    A null or empty text has none. Time is linear in a text, however many matches it has.
    """
    helpers = ("_assign", "_access", "_hex", "_hidden", "_runs", "_base", "_more")
    df, back = set_aside(df, *helpers)
    body = F.coalesce(F.col({v: k for k, v in back.items()}.get(text, text)), F.lit(""))
    low = F.lower(body)
    none = F.expr(f"CAST(array() AS {_SPANS})")
    hint = F.lit(False)
    for word in _KEYWORDS:
        hint = hint | F.contains(low, F.lit(word))
    searches = {"_assign": (ASSIGN, "assign", 2, 6), "_access": (ACCESS, "access"), "_hex": (HEX, "hex")}
    df = df.drop("spans").withColumns(
        {
            "_assign": F.when(hint, _found(body, *searches["_assign"])).otherwise(none),
            "_access": F.when(F.contains(body, F.lit("AKIA")), _found(body, *searches["_access"])).otherwise(none),
            "_hex": F.when(body.rlike(HEX), _found(body, *searches["_hex"])).otherwise(none),
        }
    )
    df = df.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    # the runs of the text, and the same runs with what each pattern found in them hidden
    able = body.rlike(CANDIDATE)
    plain = F.translate(body, COVERED, OTHER)
    runs = F.lit(CANDIDATE.replace("A-Z", f"{COVERED}A-Z"))
    hidden = [F.when(able & (F.size(c) > 0), F.regexp_extract_all(_masked(plain, p, *more), runs, F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)")) for c, (p, _, *more) in searches.items()]
    df = df.withColumns({"_runs": F.when(able, _found(plain, CANDIDATE, "markov")).otherwise(none), "_hidden": F.struct(*[h.alias(f"h{k}") for k, h in enumerate(hidden)])})

    def judged(x: Column) -> Column:
        apart = F.lit(True)
        for k in range(len(hidden)):
            apart = apart & ~F.coalesce(F.contains(x[f"h{k}"], F.lit(COVERED)), F.lit(False))
        value = x["r"]["value"]
        return apart & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (mean_ratio(value, ratios) >= LEAST_RATIO)

    met = F.arrays_zip(F.col("_runs").alias("r"), *[F.col(f"_hidden.h{k}").alias(f"h{k}") for k in range(len(hidden))])
    df = df.withColumn("_more", F.transform(F.filter(met, judged), lambda x: x["r"]))
    df = df.withColumn("spans", F.array_sort(F.concat("_base", "_more")))
    return df.drop(*helpers).withColumnsRenamed(back)


def written(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace in column ``text`` each stretch that spans of column ``spans`` cover by ``mark``; all else stays. Drops ``spans``.

    Spans are in the order of their starts; where they overlap or touch the same characters, one mark stands for all of them.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """The characters from ``start`` to before ``end``, of the pieces that hold them only."""
        first = lambda c: F.greatest(start - c * PIECE, F.lit(0))
        part = lambda c: F.substring(F.get(pieces, c), first(c) + 1, F.least(end - c * PIECE, F.lit(PIECE)) - first(c))
        held = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
        return F.when(end > start, F.array_join(F.transform(held, part), "")).otherwise(F.lit(""))

    def whole(x: Column) -> Column:
        spans, reach, pieces = x["spans"], x["reach"], x["pieces"]
        gap = lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(cut(pieces, at, s["start"]), F.lit(mark)))
        end = F.greatest(F.element_at(reach, -1), F.element_at(spans, -1)["end"])
        return F.concat(F.array_join(F.zip_with(spans, reach, gap), ""), cut(pieces, end, x["size"]))

    reach = _before(F.col("spans"), lambda s: s["end"], lambda a, e: F.greatest(a, e))
    given = F.struct(F.col("spans"), reach.alias("reach"), pieces.alias("pieces"), F.length(F.col(text)).alias("size"))
    return df.withColumn(text, F.when(F.size("spans") > 0, _let(given, whole)).otherwise(F.col(text))).drop("spans")


def training_sample(docs: DataFrame, text: str = "text", rows: int = 2000, strings: int = 3000, most_pairs: int = 20_000) -> DataFrame:
    """Labelled samples: (``value``, ``random``), from at most about ``rows`` texts, ``most_pairs`` word pairs and ``strings`` of each random form.

    Random are digests as hexadecimal digits, Base64 and capitals with digits.
    Ordinary are the documents' words and identifiers put together from pairs of
    neighbouring words, with capitals, underscores, hyphens and numbers. Texts and
    pairs are picked by their hashes, each once however often it is repeated, so
    the samples don't depend on how the rows are partitioned.
    """
    spark = docs.sparkSession
    ids = spark.range(strings).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("d"))
    forms = [F.col("d"), F.base64(F.unhex("d")), F.translate(F.upper(F.base64(F.unhex("d"))), "+/=", "7Q2"), F.translate(F.base64(F.unhex("d")), "+/=", "-_")]
    random = ids.select(F.explode(F.array(*forms)).alias("value"), F.lit(True).alias("random"))
    few = _share(docs.select(F.col(text).alias("t")), docs.count(), rows).distinct()
    words = F.regexp_extract_all(F.coalesce(F.col("t"), F.lit("")), F.lit(r"[A-Za-z]{2,24}(?![A-Za-z])"), F.lit(0))
    met = F.transform("w", lambda x, i: F.struct(F.lower(x).alias("a"), F.lower(F.coalesce(F.get("w", i + 1), x)).alias("b")))
    pairs = settle(few.select(words.alias("w")).select(F.explode(met).alias("p")).select("p.*").distinct(), "pairs")
    pairs = _share(pairs, pairs.count(), most_pairs)
    a, b = F.col("a"), F.col("b")
    number = F.pmod(F.xxhash64("a", "b"), F.lit(1000)).cast("string")
    joined = [a, F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat(a, F.lit("-"), b), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(a, F.lit("_"), number), F.concat(a, F.lit("/"), b, F.lit("/"))]
    ordinary = pairs.select(F.explode(F.array(*joined)).alias("value"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def _share(df: DataFrame, total: int, most: int) -> DataFrame:
    """The rows whose hash falls into the share that leaves about ``most`` of ``total``; all if there are no more."""
    if total <= most:
        return df
    return df.where(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)) < (1 << 40) * most // total)
