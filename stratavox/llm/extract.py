"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of text; what stands in menus,
headers, adverts and the like leaves a gap of empty lines. Text lengths are
summed over sliding windows of lines; a surge is where a window's sum rises over
a threshold, a dive where a window is empty, and the text between them is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the sum over which a window surges where no tag marks the article.
WINDOW, SURGE = 3, 86

# Fixed values of HTML: elements whose text is never shown as prose, those that end a line, and those that hold no main text.
_UNSHOWN = r"script|style|noscript|template|svg|head|title|iframe|object|canvas|audio|video|textarea|select"
# Of these, what hides all of the page if it has no end tag.
_RAW = frozenset("script style title iframe textarea noscript".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# What may stand beside such words in one token (site-header, ad-slot); any other piece (has-sidebar, entry-header) makes the token say something else.
_NEUTRAL = frozenset("site global top bottom bar box block slot unit list links buttons form area articles posts stories".split())
# Adverts, comments and the like stay such in whatever holds them (ad-container, comments-section); headers and menus don't (section-header).
_SURE = frozenset(
    "ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus newsletter popup promo related replies respond sharing signup sponsor sponsored".split()
)
_HOLDS = frozenset("body container content contents group holder inner item items module outer panel placeholder row section space wrap wrapper zone".split())
_PIECE = re.compile(r"[a-z0-9]+")
# Of these, what frames the main text leaves a gap as wide as a window; an advert or a box between its paragraphs a single line.
_FRAME = frozenset("nav header footer form menu".split())
_FRAMED = re.compile(r"breadcrumb|comment|disqus|footer|header|masthead|menu|nav|replies|respond|sidebar|toolbar", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Articles in these are comments or teasers beside the main text, not the main text itself.
_CARDS = re.compile(r"comment|disqus|related|replies|respond", re.I)
_BESIDE = 1 << 20

# Ends that HTML implies: a start tag ends the nearest open element of the first set unless one of the second stands between.
_SCOPES = frozenset("article main button caption table td th".split())
_ENDS_P = _BLOCKS - frozenset("body br button center dd dt html legend li option tbody td tfoot th thead tr".split()) | frozenset(("center", "dd", "dt", "li"))
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ()),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot"), ("table",))),
}
_OF_TABLE = frozenset("caption tbody td tfoot th thead tr".split())

_HIDES = re.compile(rf"<(?:(!--)|({_UNSHOWN})(?=[\s>/]))", re.I)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[!?][^>]*>)")
# The same where quotes of attributes no longer close.
_PLAIN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|[!?][^>]*>)")
_CUT = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _marks(token: str) -> bool:
    """Whether a token of a class or id names what holds no main text: all its pieces are such words or neutral ones, beside sure ones also what holds them."""
    pieces = _PIECE.findall(token.lower())
    beside = _NEUTRAL | _HOLDS if any(x in _SURE for x in pieces) else _NEUTRAL
    return any(x in _WORDS for x in pieces) and all(x in _WORDS or x in beside for x in pieces)


def _aside(name: str, attributes: str, in_article: bool) -> int:
    """0 if an element may hold main text. By its name or role it holds none (``_BESIDE``); by a token of its class or id (1) unless an article is in it."""
    if name in _ASIDE:
        return 0 if in_article and name == "header" else _BESIDE
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    found = 0
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if kind.lower() == "role":
            if value.lower() in _ROLES:
                return _BESIDE
        else:
            for token in value.split():
                if _marks(token):
                    found = max(found, _BESIDE if _CARDS.search(token) else 1)
    return found


class _Open:
    """The stack of open elements, with the places of each name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}

    def last(self, *names: str) -> int:
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=-1)

    def push(self, name: str, element: int) -> None:
        for x in (name, "#block") if name in _BLOCKS or name == "table" else (name,):
            self.at.setdefault(x, []).append(len(self.stack))
        if name in _SCOPES:
            self.at.setdefault("#scope", []).append(len(self.stack))
        self.stack.append((name, element))

    def cut(self, place: int) -> list[int]:
        """End all elements from a place on; the numbers of those that count, the innermost first."""
        ended = []
        while len(self.stack) > place:
            name, element = self.stack.pop()
            self.at[name].pop()
            if name in _BLOCKS or name == "table":
                self.at["#block"].pop()
            if name in _SCOPES:
                self.at["#scope"].pop()
            if element >= 0:
                ended.append(element)
        return ended

    def implied(self, name: str) -> list[int]:
        """Elements that the start tag of ``name`` ends."""
        ended = []
        if name in _ENDS:
            names, bounds = _ENDS[name]
            place = self.last(*names)
            if place > self.last(*bounds, *(("article", "main") if name in _OF_TABLE else ("#scope",))):
                ended = self.cut(place)
        if name in _ENDS_P and self.at.get("p") and self.last("p") > self.last("#scope"):
            ended += self.cut(self.last("p"))
        return ended

    def end(self, name: str) -> list[int]:
        """Elements that the end tag of ``name`` ends: its own, and all that stand open in it."""
        place = self.last(name)
        if name in ("article", "main"):
            bound = -1
        elif name in _OF_TABLE:
            bound = self.last("table", "article", "main")
        elif name == "table":
            bound = self.last("article", "main")
        elif name in _SCOPES or name in _BLOCKS:
            bound = self.last("#scope") if name not in _SCOPES else self.last("table", "td", "th", "article", "main")
        else:
            bound = self.last("#block")
        return self.cut(place) if place > bound else []


def _found_tags(page: str) -> Iterator[re.Match[str]]:
    """The page's tags from left to right, in linear time: from the first tag on whose quotes don't close, quotes mean nothing."""
    pattern, at, last = _TAG, 0, page.rfind(">") + 1
    while (start := page.find("<", at, last)) >= 0:
        tag = pattern.match(page, start, last)
        if tag is None and pattern is _TAG and page[start + 1 : start + 3].strip("/")[:1].isalpha():
            pattern = _PLAIN
            tag = pattern.match(page, start, last)
        if tag is not None:
            yield tag
        at = tag.end() if tag else start + 1


def _tags(page: str) -> tuple[list[tuple[int, int, bool, list[int], int]], list[tuple[int, bool]], set[int]]:
    """The page's tags as (start of the text before, its end, whether a line ends, elements that end, element that starts or -1),
    the elements that count as (kind of aside or 0 for articles, whether it leaves a notch), and the asides that are none as they hold the article."""
    tags: list[tuple[int, int, bool, list[int], int]] = []
    elements: list[tuple[int, bool]] = []
    names: list[str] = []
    costs: dict[int, int] = {}
    holders: set[int] = set()
    asides: list[int] = []
    stack, at, count = _Open(), 0, {"article": 0, "main": 0}
    far = 1 << 60
    least = {"article": far, "main": far}

    def leave(ended: list[int]) -> list[int]:
        for k in ended:
            if elements[k][0]:
                asides.pop()
            else:
                count[names[k]] -= 1
        return ended

    def weigh(start: int, stop: int) -> None:
        cost = costs[asides[-1]] if asides else 0
        for kind in least:
            if count[kind] and cost < least[kind] and start < stop and not page[start:stop].isspace():
                least[kind] = cost

    for tag in _found_tags(page):
        start, stop, at = at, tag.start(), tag.end()
        weigh(start, stop)
        close, name, attributes = tag[1], (tag[2] or "").lower(), tag[3] or ""
        if not name or name in ("html", "body"):
            tags.append((start, stop, name != "", [], -1))
            continue
        ended = leave(stack.end(name) if close else stack.implied(name))
        opened = -1
        if not close and name not in _VOID and not attributes.endswith("/"):
            kind = _aside(name, attributes, count["article"] + count["main"] > 0)
            if kind or name in count:
                opened = len(elements)
                elements.append((kind, name not in _FRAME and not _FRAMED.search(attributes)))
                names.append(name)
            if kind:
                costs[opened] = kind + (costs[asides[-1]] if asides else 0)
                asides.append(opened)
            elif name in count:
                count[name] += 1
                for k in reversed(asides):
                    if k in holders:
                        break
                    holders.add(k)
            stack.push(name, opened)
        tags.append((start, stop, name in _BLOCKS, ended, opened))
    weigh(at, len(page))
    tags.append((at, len(page), True, [], -1))
    floor = min(least.values())
    most = max(x for x in least.values() if x == floor or x < floor + _BESIDE)
    return tags, elements, {k for k in holders if costs[k] <= most} if floor < far else set()


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}(?=[\s>/]|\Z)", re.I)


def shown(page: str) -> str:
    """The page without comments and without elements whose text is never shown, in one pass from left to right.

    A search that found nothing is not made again, so the time is linear in the page. An element without an end tag
    hides the rest only where HTML reads it as plain text; else just its start tag goes.
    """
    parts: list[str] = []
    at, scan, without = 0, 0, set()
    while (found := _HIDES.search(page, scan)) is not None:
        start, name = found.start(), (found[2] or "").lower()
        if found[1]:
            end = page.find("-->", start + 2)  # <!--> is a whole comment
            end = len(page) if end < 0 else end + 3
        else:
            close = page.find(">", found.end())
            if close < 0:
                break
            end = close + 1
            if page[close - 1] != "/":
                after = None if name in without else _end_of(name).search(page, end)
                if after is not None:
                    close = page.find(">", after.end())
                    end = len(page) if close < 0 else close + 1
                elif name in _RAW:
                    end = len(page)
                else:
                    without.add(name)
        parts += (page[at:start], "" if found[1] else " ")
        at = scan = end
    return "".join([*parts, page[at:]])


def lines_of(page: str) -> tuple[list[str], bool]:
    """The page's lines, with gaps for what is no main text, and whether tags mark an article (then all else is a gap)."""
    page = _CUT.sub("", shown(page))
    lines: list[tuple[str, bool]] = []
    gap, notch = [("", False)] * WINDOW, [("", False)]
    parts: list[str] = []
    articles, away = 0, -1
    marked = False

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, articles > 0))

    tags, elements, opened = _tags(page)
    for start, stop, breaks, ended, element in tags:
        if away < 0:
            parts.append(page[start:stop])
            if breaks:
                end_line()
        for k in ended:
            if k == away:
                away = -1
                lines += notch if elements[k][1] else gap
            elif away < 0 and not elements[k][0]:
                end_line()
                articles -= 1
                if not articles:
                    lines += gap
        if element < 0 or away >= 0:
            continue
        if elements[element][0]:
            if element not in opened:
                end_line()
                away = element
        else:
            articles += 1
            marked = True
    if marked and any(inside for _, inside in lines):
        return [text if inside else "" for text, inside in lines], True
    return [text for text, _ in lines], False


def between_surge_and_dive(lengths: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of lines from a surge (a window's sum reaches ``surge``) to the dive (an empty window) after it."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found, start, peak = [], None, 0
    for i, total in enumerate([*sums, 0]):
        if total == 0:
            if start is not None and peak >= surge:
                found.append((start, i))
            start, peak = None, 0
        else:
            start = i if start is None else start
            peak = max(peak, total)
    return found


def main_text(page: str | None) -> str:
    """The main text of a page: lines between surges and dives, each with single spaces, joined by a space."""
    if not page:
        return ""
    lines, marked = lines_of(page)
    lengths = [len(x) for x in lines]
    kept = between_surge_and_dive(lengths, 1 if marked else SURGE)
    if not kept:  # a short page: the longest stretch
        kept = sorted(between_surge_and_dive(lengths, 1), key=lambda r: (-sum(lengths[r[0] : r[1]]), r))[:1]
    return " ".join(x for a, b in kept for x in lines[a:b] if x)


def extract(df: DataFrame, column: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of each page as column ``text`` (replaced if there); empty for null, empty or text-free pages."""

    @F.pandas_udf("string")
    def texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in pages:
            yield pd.Series([main_text(x) for x in part], dtype=object)

    return df.withColumn(text, texts(column))
