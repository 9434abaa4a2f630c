"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule's cost and the share of rows that it rejects are estimated on a
sample; rules are then tried in the order of rejections per cost, and a rejected
row is tried no further. Where a caller doesn't want the measures as columns,
each rule computes what it needs from the text itself, so a rejected row is
spared the measures of all rules after the one that rejected it.
"""

from __future__ import annotations

import math
import re
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.tables import set_aside

#: Words of the windows whose repetition counts.
REPEAT_WINDOW = 8

#: Rules of the catalogue: name, and the SQL predicate over the measures that rejects a row.
RULES = {
    "few_words": "n_words < 20",
    "repeated_passages": "100 * n_repeat_words > 30 * n_words",
    "repeated_lines": "n_lines > 4 AND 2 * n_dup_lines > n_lines",
    "symbols": "n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 25 * n_words",
    "shouting": "n_words >= 20 AND 2 * length(regexp_replace({text}, '[^A-Z]+', '')) > word_chars",
}


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of column ``text``, all long; columns of these names are replaced, all others stay.

    Words are runs without ASCII white space. ``n_words``, ``word_chars`` (code
    points in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_lines`` (lines with a
    word), ``n_dup_lines`` (such lines equal to an earlier one) and
    ``n_repeat_words`` (words in windows of eight words that stand twice or more
    in the text, the first included). A null or empty text has 0 of each.
    """
    n = REPEAT_WINDOW
    helpers = ("_words", "_lines", "_hashes", "_windows", "_repeats")
    df, back = set_aside(df, *helpers)
    text = {v: k for k, v in back.items()}.get(text, text)
    body = F.coalesce(F.col(text), F.lit(""))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    df = df.withColumn("_words", F.array_remove(F.split(body, r"[\x20\x09-\x0D]+", -1), ""))
    df = df.withColumn("_lines", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_hashes": F.transform("_words", lambda x: F.xxhash64(x)),
        }
    )
    # The lambda over an array of one binds a value that is read many times.
    items = ", ".join(f"h[i + {k}]" for k in range(n))
    windows = f"element_at(transform(array(_hashes), h -> transform(sequence(0, size(h) - {n}), i -> xxhash64({items}))), 1)"
    df = df.withColumn("_windows", F.expr(f"CASE WHEN size(_hashes) > {n} THEN {windows} END"))
    df = df.withColumn("_repeats", F.expr("coalesce(size(array_distinct(_windows)) < size(_windows), false)"))
    starts = """
        element_at(transform(array(array_sort(transform(_windows, (x, i) -> struct(x, i)))), s ->
            array_sort(transform(
                filter(s, (y, k) -> y.x <=> get(s, k - 1).x OR y.x <=> get(s, k + 1).x),
                z -> z.i))), 1)"""
    covered = f"""
        aggregate({starts}, struct(0 AS reached, 0 AS n),
            (a, p) -> struct(greatest(a.reached, p + {n}) AS reached, a.n + p + {n} - greatest(a.reached, p) AS n),
            a -> a.n)"""
    df = df.withColumn("n_repeat_words", F.expr(f"CAST(CASE WHEN _repeats THEN {covered} ELSE 0 END AS BIGINT)"))
    return df.drop(*helpers).withColumnsRenamed(back)


_WORDS = r"array_remove(split({body}, r'[\x20\x09-\x0D]+', -1), '')"
_LINES = r"filter(split({body}, r'\n', -1), x -> x rlike r'[^\x20\x09-\x0D]')"
_WINDOWS = f"transform(sequence(0, size(h) - {REPEAT_WINDOW}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(REPEAT_WINDOW))}))"
_COVERED = f"""aggregate(
    array_sort(transform(filter(s, (y, k) -> y.x <=> get(s, k - 1).x OR y.x <=> get(s, k + 1).x), z -> z.i)),
    struct(0 AS reached, 0 AS n),
    (a, p) -> struct(greatest(a.reached, p + {REPEAT_WINDOW}) AS reached, a.n + p + {REPEAT_WINDOW} - greatest(a.reached, p) AS n),
    a -> a.n)"""


def _let(name: str, value: str, then: str) -> str:
    """SQL for ``then`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


#: Each measure of :func:`measures` as SQL over the text alone.
FROM_TEXT = {
    "n_words": f"size({_WORDS})",
    "word_chars": r"length(regexp_replace({body}, r'[\x20\x09-\x0D]+', ''))",
    "n_symbols": "length(regexp_replace({body}, '[^#*$%&|<>]+', ''))",
    "n_lines": f"size({_LINES})",
    "n_dup_lines": _let("l", _LINES, "size(l) - size(array_distinct(l))"),
    "n_repeat_words": _let(
        "h",
        f"transform({_WORDS}, x -> xxhash64(x))",
        f"""CASE WHEN size(h) > {REPEAT_WINDOW} THEN {_let("v", _WINDOWS, f"CASE WHEN size(array_distinct(v)) < size(v) THEN {_let('s', 'array_sort(transform(v, (x, i) -> struct(x, i)))', _COVERED)} ELSE 0 END")} ELSE 0 END""",
    ),
}
_NAMES = re.compile(r"\b(" + "|".join(FROM_TEXT) + r")\b")


def from_text(predicate: str, text: str = "text") -> str:
    """A rule's predicate with each measure replaced by its computation from the text column."""
    body = f"coalesce(`{text}`, '')"
    return _NAMES.sub(lambda m: f"CAST({FROM_TEXT[m[1]].replace('{body}', body)} AS BIGINT)", predicate)


def sample_of(df: DataFrame, rows: int = 1000, seed: int = 1) -> DataFrame:
    """About ``rows`` rows of ``df``: what the estimates are made on."""
    total = df.count()
    return df if total <= rows else df.sample(rows / total, seed)


def order_rules(sample: DataFrame, rules: dict[str, str], repeats: int = 2) -> list[str]:
    """The rules by rejections per cost on the sample, highest first; ties by name.

    A rule's cost is the time that evaluating its predicate on the sample takes
    beyond counting it: the least of ``repeats`` runs after one that compiles, up
    to the next power of two of milliseconds, so that noise seldom changes the
    order. The order only changes how soon a row is rejected, never whether: no
    rule looks at another. Rules that reject nothing come last, the cheapest first.
    """

    def least(rows: DataFrame) -> tuple[int, float]:
        n, times = rows.count(), []
        for _ in range(repeats):
            began = time.perf_counter()
            rows.count()
            times.append(time.perf_counter() - began)
        return n, min(times)

    _, idle = least(sample)
    found = []
    for name, predicate in rules.items():
        rejected, seconds = least(sample.where(F.coalesce(F.expr(predicate), F.lit(False))))
        cost = 2 ** math.ceil(math.log2(max((seconds - idle) * 1000, 1.0)))
        found.append((-rejected / cost, cost, name))
    return [name for *_, name in sorted(found)]


def first_rejection(rules: dict[str, str], order: list[str]) -> Column:
    """The name of the first rule in ``order`` that rejects the row, or null; later rules aren't evaluated then."""
    found: Column | None = None
    for name in order:
        rejects = F.coalesce(F.expr(rules[name]), F.lit(False))
        found = F.when(rejects, name) if found is None else found.when(rejects, name)
    return F.lit(None).cast("string") if found is None else found


def cascade(df: DataFrame, rules: dict[str, str] | None = None, text: str = "text", sample_rows: int = 1000, measured: bool = True) -> DataFrame:
    """Add ``rejected_by`` (null for a kept row) and ``kept``, and the measures if ``measured``; columns of these names are replaced.

    Without the measures as columns, each rule computes its own from the text when
    its turn comes, so what a row costs ends with the rule that rejects it. Rules
    are timed on the sample in the form in which they run. In a predicate
    ``{text}`` stands for the text column. A predicate that is null doesn't
    reject. An empty table gives an empty result.
    """
    rules = {name: predicate.replace("{text}", f"`{text}`") for name, predicate in (RULES if rules is None else rules).items()}
    sample = sample_of(df.select(text), sample_rows)
    if not measured:
        rules = {name: from_text(predicate, text) for name, predicate in rules.items()}
    sample = (measures(sample, text) if measured else sample).persist()
    order = order_rules(sample, rules)
    sample.unpersist()
    df = (measures(df, text) if measured else df).drop("rejected_by", "kept")
    found = first_rejection(rules, order)
    return df.withColumn("rejected_by", found).withColumn("kept", F.col("rejected_by").isNull())
