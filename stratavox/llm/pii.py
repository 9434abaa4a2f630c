"""Personal data in texts: addresses and numbers as written, and those in disguise.

Patterns find what is written plainly. Then transducers rewrite the text: look-alike
characters to ASCII, digits said in words to digits, at and dot in words, brackets
or references to @ and full stops. Each keeps where every character came from, so
what the patterns find in the rewritten text is mapped back to the source.

All searches are linear in the text, however long its runs of digits or letters.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.llm.words import Batches, returning

# The kinds of the contract in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:int,start:int,end:int,added:boolean>>"
#: Rows whose texts are strings at once.
ROWS = 256

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# an address has no second start within a run of digits, and a chain of digits is taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones, each before the letter that it stands for; and full stops.
_LOOK_ALIKES = "аa еe оo рp сc хx уy іi јj ѕs һh ԁd ԛq ԝw ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX ЅS ІI ЈJ УY οo νv ρp αa ιi κk υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɡg ɑa ıi"
_LOOKS = {x[0]: x[1] for x in _LOOK_ALIKES.split()} | dict.fromkeys("。｡·", ".") | {"−": "-"}

# Digits in English, German, French and Spanish.
_SAID = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_TIMES = {"double": 2, "triple": 3}
_DOTS, _ATS = "dot|punkt|point|punto", "at|ät|arroba|arobase"
_WORD = rf"(?:(?:{'|'.join(_TIMES)})[ -])?(?:{'|'.join(sorted(_SAID, key=len, reverse=True))})"
_EDGE, _END = r"(?<![^\W_])", r"(?![^\W_])"
_SPELLED = re.compile(rf"{_EDGE}(?:plus[ -])?{_WORD}{_END}(?:[ \t\n,-]{{1,3}}(?:{_WORD}|{_DOTS}){_END})*", re.I)
_SPELLED_PART = re.compile(rf"{_EDGE}(?:(?P<times>{'|'.join(_TIMES)})[ -])?(?P<word>plus|{_DOTS}|{'|'.join(sorted(_SAID, key=len, reverse=True))}){_END}", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words of which two stand side by side wherever three digits are spelled.
_SPEAKS = {*_SAID, *_TIMES, "plus", *_DOTS.split("|")}
_MISREAD = re.compile(r"(?<![A-Za-z0-9])(?=[OolI]*[0-9])[0-9OolI]{2,}(?![A-Za-z0-9])")
_AS_DIGITS = str.maketrans("OolI", "0011")
_WRAPPED = re.compile(rf"(?:(?<! ) )?[(\[{{<][ ]?(?:(?P<at>{_ATS}|@)|(?P<dot>{_DOTS}|\.))[ ]?[)\]}}>][ ]?|(?P<at2>&#64;|&#x40;|&commat;|%40)|(?P<dot2>&#46;|&#x2e;|&period;)|(?<=[A-Za-z0-9])(?P<at3> @ )(?=[A-Za-z0-9])", re.I)
# an address in words needs both: "at" with "dot" or "punkt", and the others with theirs, as "at this point" is no address
_PAIRS = {"at|ät": "dot|punkt", "arroba": "punto", "arobase": "point"}


def _said_address(at: str, dots: str) -> str:
    word, host = "[A-Za-z0-9._%+-]++", "[A-Za-z0-9.-]+"
    return rf"{word}(?: (?:{dots}) {word}){{0,8}} (?:{at}) {host}(?: (?:{dots}) {host})+{_END}"


_BARE = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?:{'|'.join(_said_address(*x) for x in _PAIRS.items())})"
    rf"|(?<=[A-Za-z0-9])@[A-Za-z0-9.-]+(?: (?:dot|punkt) [A-Za-z0-9.-]+)+{_END}"
    rf"|(?<=[A-Za-z0-9])_(?:{_ATS})_[A-Za-z0-9]+(?:_(?:{_DOTS})_[A-Za-z0-9]+)+{_END}",
    re.I,
)
_BARE_AT = re.compile(rf"[ _](?:{_ATS})[ _]", re.I)
_BARE_DOT = re.compile(rf"[ _](?:{_DOTS})[ _]", re.I)
# without one of these there is nothing to look for
_MARKS = ("(", "[", "{", "<", "&", "%40", " @ ")
_BETWEEN = [f"{c}{x}{c}" for x in _DOTS.split("|") for c in " _"]
_TLD = re.compile(r"\.[A-Za-z]{2,}$")


def _digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the contract's patterns, by kind and then start."""
    found: list[tuple[int, int, int]] = []
    end = at = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            # the local part is what its characters fill up to here, back to the last match or @
            low = max(end, text.rfind("@", at, m.start()) + 1)
            size = len(text[low : m.start()]) - len(text[low : m.start()].rstrip(_LOCAL))
            at = m.start()
            if size:
                found.append((0, m.start() - size, m.end()))
                end = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
                found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 15 and 16 <= len(number := _digits(m[0])) <= 19 and luhn(number):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                found.append((3, *m.span()))
    return found


@lru_cache(maxsize=1 << 16)
def _ascii(c: str) -> str:
    """What a character that isn't ASCII is rewritten to; itself if it looks like nothing else."""
    if c in _LOOKS:
        return _LOOKS[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    made = unicodedata.normalize("NFKC", c)
    return made if made.isascii() else c


class Rewritten:
    """A text rewritten from a source, in segments: one character for one, or all from one stretch of the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at, self.start, self.end = array("q", [0]), array("q", [0]), array("q", [-1])  # an end of -1: one for one

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the source that a non-empty stretch of the text came from."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        first = self.start[i] + (start - self.at[i] if self.end[i] < 0 else 0)
        return first, self.start[j] + end - self.at[j] if self.end[j] < 0 else self.end[j]

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches of the text, which are in order and not empty."""
        if not edits:
            return
        old = self.at, self.start, self.end
        made, size, pos, k = [], 0, 0, 0
        self.at, at, start, end = array("q"), array("q"), array("q"), array("q")

        def keep(a: int, b: int) -> None:
            nonlocal size, k
            while k + 1 < len(old[0]) and old[0][k + 1] <= a:
                k += 1
            i = k
            while i < len(old[0]) and old[0][i] < b:
                low = max(a, old[0][i])
                at.append(size + low - a)
                start.append(old[1][i] + (low - old[0][i] if old[2][i] < 0 else 0))
                end.append(old[2][i])
                i += 1
            made.append(self.text[a:b])
            size += b - a

        for a, b, out in edits:
            if a > pos:
                keep(pos, a)
            self.at = old[0]
            s, e = self._of(old, a, b)
            if out:
                at.append(size)
                start.append(s)
                end.append(e)
                made.append(out)
                size += len(out)
            pos = b
        if pos < len(self.text):
            keep(pos, len(self.text))
        self.text = "".join(made)
        self.at, self.start, self.end = (at, start, end) if at else (array("q", [0]), array("q", [0]), array("q", [-1]))

    def _of(self, old: tuple[array, array, array], a: int, b: int) -> tuple[int, int]:
        kept = self.at, self.start, self.end
        self.at, self.start, self.end = old
        try:
            return self.source(a, b)
        finally:
            self.at, self.start, self.end = kept


def _look_alikes(now: Rewritten) -> None:
    """Characters of other scripts or widths that look like ASCII ones; those that can't be seen go."""
    changed = {c: made for c in set(now.text) if c > "\x7f" and (made := _ascii(c)) != c}
    uneven = [c for c, made in changed.items() if len(made) != 1]
    if changed:
        now.text = now.text.translate({ord(c): made for c, made in changed.items() if len(made) == 1})
    if uneven:
        each = re.compile("|".join(re.escape(c) + ("+" if not changed[c] else "") for c in uneven))
        now.edit([(*m.span(), changed[m[0][0]]) for m in each.finditer(now.text)])
    now.text = _MISREAD.sub(lambda m: m[0].translate(_AS_DIGITS), now.text)


def _spelled(now: Rewritten) -> None:
    """Three or more digits in words in a row: their digits side by side, with full stops and a plus where they are said."""
    words = [x in _SPEAKS for x in _LETTERS.findall(now.text.lower())]
    if not any(map(operator.and_, words, words[1:])):
        return
    edits = []
    for run in _SPELLED.finditer(now.text):
        parts = list(_SPELLED_PART.finditer(now.text, *run.span()))
        while parts and parts[-1]["word"].lower() in _DOTS.split("|"):
            parts.pop()
        said = [_SAID.get(p["word"].lower(), "+" if p["word"].lower() == "plus" else ".") * _TIMES.get((p["times"] or "").lower(), 1) for p in parts]
        if sum(len(x) for x in said if x.isdigit()) < 3:
            continue
        for i, (p, x) in enumerate(zip(parts, said, strict=True)):
            edits.append((p.start(), p.end(), x))
            if i + 1 < len(parts):
                edits.append((p.end(), parts[i + 1].start(), ""))
    now.edit(edits)


def _at_and_dot(now: Rewritten) -> None:
    """At and dot in brackets, as references, or as words where an address of both is spelled."""
    if any(x in now.text for x in _MARKS):
        now.edit([(*m.span(), "@" if m["at"] or m["at2"] or m["at3"] else ".") for m in _WRAPPED.finditer(now.text)])
    low = now.text.lower()
    if not any(x in low for x in _BETWEEN):
        return
    edits = []
    for m in _BARE.finditer(now.text):
        for pattern, made in ((_BARE_AT, "@"), (_BARE_DOT, ".")):
            edits += [(*d.span(), made) for d in pattern.finditer(now.text, *m.span())]
    now.edit(sorted(edits))


#: The transducers in the order in which they are applied.
TRANSDUCERS: tuple[Callable[[Rewritten], None], ...] = (_look_alikes, _spelled, _at_and_dot)


def find(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, added) of all spans in code points of ``text``, by kind and then start.

    Added are those that only the rewritten text shows: their source differs from
    what was matched, they lie in no plain span, and a mail address ends in letters.
    """
    base = plain(text)
    now = Rewritten(text)
    for rewrite in TRANSDUCERS:
        rewrite(now)
    spans = {(k, s, e, False) for k, s, e in base}
    if now.text != text:
        covers = Cover(base)
        for k, s, e in plain(now.text):
            a, b = now.source(s, e)
            if text[a:b] != now.text[s:e] and (k or _TLD.search(now.text[s:e])) and not covers.holds(a, b):
                spans.add((k, a, b, True))
    return sorted(spans)


class Cover:
    """Whether a stretch lies within one of some spans."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.reach, far = [], [], -1
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            far = max(far, e)
            self.starts.append(s)
            self.reach.append(far)

    def holds(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start) - 1
        return i >= 0 and self.reach[i] >= end


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``, all spans of personal data in column ``text`` (replaced if there), by kind and then start.

    A span has ``kind`` (its place in ``KINDS``), ``start`` and ``end`` (code points,
    end exclusive) and ``added``, whether only a transducer shows it. A null or empty
    text has none. All other columns stay.
    """
    names = [c for c in df.columns if c != "spans"]
    fields = [pa.field("kind", pa.int32()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("added", pa.bool_())]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                found, bounds = [], [0]
                for x in part.column(names.index(text)):
                    found += find(x.as_py() or "")
                    bounds.append(len(found))
                columns = [pa.array([s[i] for s in found], f.type) for i, f in enumerate(fields)]
                spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))
                yield pa.record_batch([*part.columns, spans], [*names, "spans"])

    kept = df.select(*[F.col(f"`{c}`") for c in names])
    element = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType())])
    return kept.mapInArrow(returning(run), T.StructType([*kept.schema.fields, T.StructField("spans", T.ArrayType(element))]))


def written(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace in column ``text`` each stretch that spans of column ``spans`` cover by the first one's kind in brackets; all else stays. Drops ``spans``."""
    names = [c for c in df.columns if c != "spans"]

    def clean(value: str | None, spans: list[dict] | None) -> str | None:
        if not value or not spans:
            return value
        done, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
            if s["start"] >= at:
                done += [value[at : s["start"]], f"[{KINDS[s['kind']].upper()}]"]
            at = max(at, s["end"])
        return "".join([*done, value[at:]])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                part = batch.slice(row, ROWS)
                spans = part.column(len(names))
                made = pa.array([clean(x.as_py(), s.as_py()) for x, s in zip(part.column(names.index(text)), spans, strict=True)], pa.string())
                yield pa.record_batch([made if c == text else part.column(i) for i, c in enumerate(names)], names)

    kept = df.select(*[F.col(f"`{c}`") for c in names], "spans")
    return kept.mapInArrow(returning(run), T.StructType([f for f in kept.schema.fields if f.name != "spans"]))
