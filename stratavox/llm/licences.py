"""Licence scans: lines, paragraphs, whole texts and sliding windows against licence templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.tables import set_aside

from stratavox.llm.licence_texts import TEXTS

#: The coefficient from which on a passage is a licence's.
LEAST = 0.8

# Words of public licences and of the notices that name them, by licence.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("proprietary", "All rights reserved."),
]

# Standard headers of source files.
_GNU = (
    "{} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} "
    "either version {} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This {} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU {}General Public License for more details."
)
for _name, _kind, _version in [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")]:
    _what = "library" if _kind == "Lesser " else "program"
    _head = _GNU.format(f"This {_what}", ":", _kind, ",", _version)
    TEMPLATES += [(_name, _head), (_name, _head + _GNU_REST.format(_what, _kind))]
    TEMPLATES.append((_name, f"Licensed under the GNU {_kind}General Public License, version {_version}."))
TEMPLATES += [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "Released under the Unlicense."),
]
TEMPLATES += [(f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.") for x in ("BY-ND", "BY-NC-SA", "BY-NC-ND")]
TEMPLATES += [
    (f"CC-{code}-4.0", f"This work is licensed under a Creative Commons Attribution-{words} 4.0 International License.")
    for code, words in [("BY-SA", "ShareAlike"), ("BY-ND", "NoDerivatives"), ("BY-NC-SA", "NonCommercial-ShareAlike"), ("BY-NC-ND", "NonCommercial-NoDerivatives")]
]
_GNU_NAMES = ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
_SPDX = ["MIT", "Apache-2.0", "MPL-1.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Unlicense", "CC0-1.0", "GFDL-1.3", *_GNU_NAMES]
_SPDX += [f"CC-{x}-4.0" for x in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in _SPDX]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}-{more}") for name in _GNU_NAMES for more in ("only", "or-later")]
TEMPLATES += list(TEXTS.items())

#: Where a licence is granted, a reservation of all other rights doesn't name it.
RESERVED = "proprietary"

#: Words of a block in which stretches are looked up.
BLOCK = 64

_WORD = re.compile(r"[a-z0-9]+")
_WORDS_IN = re.compile(r"[^\W_]")


def normalised(text: str) -> list[str]:
    """Runs of ASCII letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> frozenset[tuple[str, str]]:
    """The distinct pairs of neighbouring words; a single word pairs with nothing."""
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset((w, "") for w in words)


class Places:
    """Stretches of words, found again by the blocks of ``BLOCK`` words that they reach into: a look-up costs what lies near, not all there is."""

    def __init__(self, stretches: Iterable[tuple] = ()) -> None:
        self.blocks: dict[int, list[tuple]] = {}
        for x in stretches:
            self.add(x)

    def add(self, x: tuple) -> None:
        """Add a stretch: a tuple that begins with start and end."""
        for k in range(x[0] // BLOCK, (x[1] - 1) // BLOCK + 1):
            self.blocks.setdefault(k, []).append(x)

    def over(self, start: int, end: int) -> Iterator[tuple]:
        """The stretches that share a word with this one; some may come more than once."""
        for k in range(start // BLOCK, (end - 1) // BLOCK + 1):
            for x in self.blocks.get(k, ()):
                if x[0] < end and start < x[1]:
                    yield x


@dataclass(frozen=True)
class Templates:
    """Templates by size and an index from bigrams to the templates that hold them."""

    names: list[str]
    sizes: list[int]
    lengths: list[int]
    index: dict[tuple[str, str], list[int]]
    sets: list[frozenset[tuple[str, str]]]
    parts: dict[tuple[int, int], float]

    def part(self, k: int, other: int) -> float:
        """The part of a template's bigrams that another holds."""
        if (k, other) not in self.parts:
            self.parts[k, other] = len(self.sets[k] & self.sets[other]) / max(1, self.sizes[k])
        return self.parts[k, other]

    def best(self, words: list[str], least: float) -> tuple[float, int, int] | None:
        """The highest coefficient of at least ``least``, its template and the shared bigrams; ties go to the licence first by name.

        As |A n B| is at most the smaller size, 2 * min / (|A| + |B|) bounds the
        coefficient: only templates of such a size are counted.
        """
        least_size, most_size, size = min(self.sizes), max(self.sizes), max(1, len(words) - 1)
        if not words or size < least_size and 2 * size / (size + least_size) < least:
            return None
        pairs = bigrams(words)
        size = len(pairs)
        if size > most_size and 2 * most_size / (size + most_size) < least:
            return None
        both: dict[int, int] = {}
        for pair in pairs:
            for k in self.index.get(pair, ()):
                if 2 * min(size, self.sizes[k]) / (size + self.sizes[k]) >= least:
                    both[k] = both.get(k, 0) + 1
        found = [(2 * n / (len(pairs) + self.sizes[k]), k, n) for k, n in both.items()]
        return min((x for x in found if x[0] >= least), key=lambda y: (-y[0], self.names[y[1]], y[1]), default=None)

    def windows(self, words: list[str], least: float) -> list[tuple[int, int, float, int, int]]:
        """(start, end, coefficient, template, shared bigrams) of windows over the words, each as long as the template it reaches ``least`` with.

        Every window of every template counts. Of those that overlap and whose
        templates hold the part ``least`` of one another, the one that shares
        most bigrams stays, then that of the highest coefficient, then the
        first. With c shared bigrams, 2 * c / (c + |B|) bounds the
        coefficient: templates with too few in the text, and starts with too few
        in a window, are not counted.
        """
        if not words or not self.sizes:
            return []
        pairs = [(w, "") for w in words] if len(words) == 1 else list(pairwise(words))
        alone = [(w, "") for w in words]
        able = {}
        common = self.index.keys() & {*pairs, *alone}
        for pair in common:
            for k in self.index[pair]:
                able[k] = able.get(k, 0) + 1
        needed = {k: least * self.sizes[k] / (2 - least) - 1e-9 for k in able}
        able = {k for k, n in able.items() if n >= needed[k]}
        found: list[tuple[int, float, int, str, int, int]] = []
        hits: dict[int, list[int]] = {k: [] for k in able}
        if able:
            for kind in (pairs, alone):
                for i, pair in enumerate(kind):
                    if pair in common:
                        for k in self.index[pair]:
                            if k in able and (self.lengths[k] == 1) == (kind is alone):
                                hits[k].append(i)
        for k, places in hits.items():
            length = min(self.lengths[k], len(words))
            span, least_hits = max(1, length - 1), max(1, math.ceil(needed[k]))
            text = alone if self.lengths[k] == 1 else pairs
            mine, last, after = self.sizes[k], len(words) - length, 0
            counts: dict[tuple[str, str], int] = {}
            shared, at = 0, -1
            for first, final in zip(places, places[least_hits - 1 :], strict=False):
                for start in range(max(after, final - span + 1, 0), min(first, last) + 1):
                    if at < 0 or start >= at + span:
                        counts, shared, added = {}, 0, range(start, start + span)
                    else:
                        for i in range(at, start):
                            pair = text[i]
                            counts[pair] -= 1
                            if not counts[pair]:
                                del counts[pair]
                                shared -= pair in common and k in self.index[pair]
                        added = range(at + span, start + span)
                    for i in added:
                        pair = text[i]
                        if pair in counts:
                            counts[pair] += 1
                        else:
                            counts[pair] = 1
                            shared += pair in common and k in self.index[pair]
                    at, after = start, start + 1
                    dice = 2 * shared / (len(counts) + mine)
                    if dice >= least:
                        found.append((-shared, -dice, start, self.names[k], k, start + length))
        kept, places = [], Places()
        for less, dice, start, _, k, end in sorted(found):
            # windows of one template that stay don't overlap, so few are near
            if not any(self.part(k, other) >= least for _, _, _, other, _ in places.over(start, end)):
                kept.append((start, end, -dice, k, -less))
                places.add(kept[-1])
        return kept


def compile_templates(templates: list[tuple[str, str]]) -> Templates:
    words = [normalised(text) for _, text in templates]
    sets = [bigrams(x) for x in words]
    index: dict[tuple[str, str], list[int]] = {}
    for k, pairs in enumerate(sets):
        for pair in pairs:
            index.setdefault(pair, []).append(k)
    return Templates([name for name, _ in templates], [len(x) for x in sets], [len(x) for x in words], index, sets, {})


def scan_text(text: str | None, templates: Templates, least: float, windows: bool = True) -> tuple[str | None, float, int, list[str]]:
    """(licence, coefficient, passages that match, licences) of a text.

    Passages are its lines, its paragraphs of several lines, the whole if it has
    several paragraphs, and with ``windows`` those windows that find more than
    each of these that they overlap. A passage inside one that shares more bigrams with another
    licence gives way if that one's template holds its own.
    """
    found: list[tuple[int, int, float, int, int]] = []
    names = templates.names
    if text and templates.sizes:
        words: list[str] = []
        lines: list[tuple[int, int]] = []
        paragraphs: list[tuple[int, int, int]] = [(0, 0, 0)]
        for line in text.split("\n"):
            if _WORDS_IN.search(line):
                start = len(words)
                words += normalised(line)
                lines.append((start, len(words)))
                paragraphs[-1] = (paragraphs[-1][0], len(words), paragraphs[-1][2] + 1)
            elif paragraphs[-1][2]:
                paragraphs.append((len(words), len(words), 0))
        paragraphs = [x for x in paragraphs if x[2]]
        passages = lines + [(a, b) for a, b, n in paragraphs if n > 1]
        if len(paragraphs) > 1:
            passages.append((0, len(words)))
        for a, b in passages:
            best = templates.best(words[a:b], least)
            if best:
                found.append((a, b, *best))
        places = Places(found)
        for window in templates.windows(words, least) if windows else ():
            if all(window[4] > x[4] or templates.part(window[3], x[3]) < least for x in places.over(window[0], window[1])):
                found.append(window)
                places.add(window)

        def gives_way(x: tuple[int, int, float, int, int], y: tuple[int, int, float, int, int]) -> bool:
            return y[0] <= x[0] and x[1] <= y[1] and y[4] > x[4] and names[y[3]] != names[x[3]] and templates.part(x[3], y[3]) >= least

        found = [x for x in found if not any(gives_way(x, y) for y in places.over(x[0], x[0] + 1))]
    top = min(((names[k] == RESERVED, -dice, names[k]) for _, _, dice, k, _ in found), default=(False, 0.0, None))
    return top[2], abs(top[1]), len(found), sorted({names[x[3]] for x in found})


def scan(df: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, least: float = LEAST, windows: bool = False) -> DataFrame:
    """Add ``licence`` (null if none), ``dice`` (0 then), ``n_matches`` and ``licences`` (array of names, in order).

    Columns of these names are replaced. Compared are every line, every paragraph
    of several lines (a line without words ends one), the whole of a text of
    several paragraphs, and with ``windows`` the windows of each template's size
    that slide over all words; each passage that matches counts. ``licence`` is that of the highest coefficient,
    ``RESERVED`` only if there is no other. A null or empty text has no licence.
    """
    shared = df.sparkSession.sparkContext.broadcast(compile_templates(TEMPLATES if templates is None else templates))

    @F.pandas_udf("licence string, dice double, n_matches long, licences array<string>")
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = [scan_text(x, shared.value, least, windows) for x in part]
            yield pd.DataFrame(rows, columns=["licence", "dice", "n_matches", "licences"])

    df, back = set_aside(df.drop(*({"licence", "dice", "n_matches", "licences"} - {text})), "_scan")
    found = df.withColumn("_scan", scanned({v: k for k, v in back.items()}.get(text, text))).drop("licence", "dice", "n_matches", "licences")
    return found.select("*", "_scan.*").drop("_scan").withColumnsRenamed(back)
