"""URL filters: host and path rules and block globs as one bit-parallel wildcard automaton.

All patterns lie one behind the other in multiword bit vectors. Each character of
a canonical URL moves all states of all patterns at once (Shift-And): a state
steps to the next symbol if the character fits it, and stays where a star stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.llm.tables import set_aside

_SLASH = ord("/")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract (verdict, host, path), and globs of hosts that a text corpus shouldn't hold.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BLOCK_GLOBS = ["*.adult-**", "*casino**", "*-pills.**", "*.free-bets.**", "*.spam-**", "*.ads-**", "*.adserver.**", "*.porn**", "*.xxx/**"]


@dataclass(frozen=True)
class Automaton:
    """``steps[c]`` has the states that character c may enter, ``stays[c]`` those that it may stay in."""

    steps: np.ndarray
    stays: np.ndarray
    start: np.ndarray
    finals: list[int]


def compile_globs(globs: list[str]) -> Automaton:
    """``**`` fits any characters, ``*`` any but slashes, ``?`` one but a slash; all else stands for itself (in UTF-8)."""
    bits = sum(len(g.encode()) + 1 for g in globs)
    words = max(1, -(-bits // 64))
    steps, stays = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start, finals, at = np.zeros(words, np.uint64), [], 0
    every = np.arange(256)
    for glob in globs:
        start[at // 64] |= np.uint64(1 << at % 64)
        data, k = glob.encode(), 0
        while k < len(data):
            if data[k : k + 1] == b"*":
                double = data[k : k + 2] == b"**"
                stays[every if double else every[every != _SLASH], at // 64] |= np.uint64(1 << at % 64)
                k += 1 + double
                continue
            at += 1
            fits = every[every != _SLASH] if data[k : k + 1] == b"?" else [data[k]]
            steps[fits, at // 64] |= np.uint64(1 << at % 64)
            k += 1
        finals.append(at)
        at += 1
    return Automaton(steps, stays, start, finals)


def simulate(automaton: Automaton, urls: list[bytes]) -> np.ndarray:
    """Whether each pattern fits each whole URL, as booleans (URLs, patterns)."""
    lengths = np.array([len(x) for x in urls], np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
    data = np.frombuffer(b"".join(urls), np.uint8)
    state = np.repeat(automaton.start[None, :], len(urls), 0)
    running = len(urls) - np.searchsorted(lengths[order][::-1], np.arange(1, int(lengths.max(initial=0)) + 1))
    one, top = np.uint64(1), np.uint64(63)
    for k, n in enumerate(running.tolist()):
        char = data[starts[:n] + k]
        now = state[:n]
        moved = now << one
        moved[:, 1:] |= now[:, :-1] >> top
        state[:n] = (moved & automaton.steps[char]) | (now & automaton.stays[char])
    out = np.zeros((len(urls), len(automaton.finals)), bool)
    for k, at in enumerate(automaton.finals):
        out[order, k] = (state[:, at // 64] >> np.uint64(at % 64)) & one != 0
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, block: list[str] | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``glob``; columns of these names are replaced.

    The canonical URL is a dot, the host and the path. A rule fits its host and
    all subdomains if the path starts with the rule's; the longest one decides
    (of equally long ones a block). Where none fits, ``rule`` is null and the
    first fitting block glob (``glob``) blocks; all else is allowed, a null or
    malformed URL too.
    """
    rules = RULES if rules is None else rules
    block = BLOCK_GLOBS if block is None else block
    names = [h + p for _, h, p in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(names[i]), rules[i][0] != "block", names[i]))
    escaped = [f"*.{h}{p}**" for _, h, p in rules]
    if any(c in h + p for _, h, p in rules for c in "*?"):
        raise ValueError("hosts and paths of rules hold no wildcards")
    automaton = compile_globs([escaped[i] for i in order] + block)

    ruled_by = np.array([*(names[i] for i in order), None], object)
    kinds = np.array([*(rules[i][0] for i in order), "allow"], object)
    globs = np.array([*block, None], object)

    def first(fits: np.ndarray, none: int) -> np.ndarray:
        return np.where(fits.any(axis=1), fits.argmax(axis=1), none) if none else np.zeros(len(fits), np.int64)

    @F.pandas_udf("rule string, verdict string, glob string")
    def verdicts(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for host, path in parts:
            made = []
            for at in range(0, len(host), 2048):
                urls = [f".{h}{p}".encode() for h, p in zip(host[at : at + 2048], path[at : at + 2048], strict=True)]
                fits = simulate(automaton, urls)
                ruled, globbed = fits[:, : len(rules)], fits[:, len(rules) :]
                rule = first(ruled, len(rules))
                glob = np.where(rule < len(rules), len(block), first(globbed, len(block)))
                judged = np.where(rule < len(rules), kinds[rule], np.where(glob < len(block), "block", "allow"))
                made.append(pd.DataFrame({"rule": ruled_by[rule], "verdict": judged, "glob": globs[glob]}))
            yield pd.concat(made) if made else pd.DataFrame({"rule": [], "verdict": [], "glob": []}, dtype=object)

    df, back = set_aside(df, "_judged")
    url = {v: k for k, v in back.items()}.get(url, url)
    found = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = found.drop("rule", "verdict", "glob").withColumn("_judged", verdicts("host", "path"))
    return found.select("*", "_judged.rule", "_judged.verdict", "_judged.glob").drop("_judged").withColumnsRenamed(back)
