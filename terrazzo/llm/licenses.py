"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment.

Templates and texts are lower-cased words. A template's fingerprints are the smallest hash in each run of
WINNOW word GRAM-grams, posted as gram -> (template, position). A text's grams are looked up there; each
diagonal with a hit is a candidate, and banded alignments of the template with the text there, as many as
lie side by side, give the matched coverage and the spans in code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

GRAM, WINNOW, BAND = 3, 2, 8
#: The share of a template's words that must match.
LEAST_COVERAGE = 0.8

# The wording of common license notices, by SPDX identifier; one identifier may have several forms.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

_TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


@dataclass
class Index:
    words: dict[str, int]
    templates: list[np.ndarray]
    codes: np.ndarray  # sorted fingerprints
    posts: list[tuple[int, int]]  # (template, position) of each


def _codes(ids: np.ndarray, base: int) -> np.ndarray:
    """A number for each gram without unknown words (id 0), -1 for others; no two grams share one."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(GRAM):
        out = out * base + ids[i : i + n]
        known &= ids[i : i + n] > 0
    return np.where(known, out, -1)


def _scrambled(code: np.ndarray) -> np.ndarray:
    return code * np.int64(0x5851F42D4C957F2D) & np.int64(0x7FFFFFFFFFFFFFFF)


@cache
def index(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Index:
    words: dict[str, int] = {}
    texts = [np.array([words.setdefault(w, len(words) + 1) for w in _TOKEN.findall(t.lower())]) for _, t in templates]
    posts = set()
    with np.errstate(over="ignore"):
        for k, ids in enumerate(texts):
            code = _codes(ids, len(words) + 1)
            mixed = _scrambled(code)
            for i in range(max(1, len(code) - WINNOW + 1)):
                at = i + int(np.argmin(mixed[i : i + WINNOW]))
                posts.add((int(code[at]), k, at))
    rows = sorted(posts)
    return Index(words, texts, np.array([r[0] for r in rows]), [r[1:] for r in rows])


def align(template: np.ndarray, ids: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment within BAND of text position - template position = diagonal."""
    n, m = len(template), len(ids)
    none = (-(10**6), 0, -1, -1)
    before: dict[int, tuple[int, int, int, int]] = {}
    best = none
    for i in range(n):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i + diagonal - BAND), min(m, i + diagonal + BAND + 1)):
            if template[i] == ids[j]:
                s, k, a, _ = before.get(j - 1, (0, 0, -1, -1))
                cell = (s + 2, k + 1, a if a >= 0 else j, j)
            else:
                s, k, a, b = before.get(j - 1, none)
                cell = (s - 1, k, a, b)
            for s, k, a, b in (before.get(j, none), row.get(j - 1, none)):
                if s - 1 > cell[0]:
                    cell = (s - 1, k, a, b)
            if cell[0] > 0:
                row[j] = cell
                if cell[:2] > best[:2]:
                    best = cell
        before = row
    return best[1], best[2], best[3]


def alignments(template: np.ndarray, ids: np.ndarray, diagonal: int, least: float) -> Iterator[tuple[int, int, int]]:
    """The alignments within BAND of the diagonal with `least` matched words or more, no two on the same words: the best, then those before and after it."""
    todo = [(max(0, diagonal - BAND), min(len(ids), diagonal + len(template) + BAND))]
    while todo:
        begin, end = todo.pop()
        # no alignment matches more of the template's words than occur here
        if np.isin(template, ids[begin:end]).sum() < least:
            continue
        n, a, b = align(template, ids[begin:end], diagonal - begin)
        if not n:
            continue
        if n >= least:
            yield n, begin + a, begin + b
        todo += [(begin, begin + a), (begin + b + 1, end)]


def scan(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) by start; of overlapping matches the one with most matched words, of those the shortest."""
    the = index(templates)
    low = text.lower() if text else ""
    words = _TOKEN.findall(low)
    ids = np.fromiter((the.words.get(w, 0) for w in words), np.int64, len(words))
    code = _codes(ids, len(the.words) + 1)
    at = np.flatnonzero(code >= 0)
    if not len(at):
        return []
    lo, hi = np.searchsorted(the.codes, code[at], "left"), np.searchsorted(the.codes, code[at], "right")
    hits = sorted({(k, int(p) - i) for p, a, b in zip(at, lo, hi, strict=True) for k, i in the.posts[a:b]})
    if not hits:
        return []
    # the words' places in the text itself: lower-casing can change a text's length
    place = [m.span() for m in _TOKEN.finditer(text)]
    if len(place) != len(words):
        place = [m.span() for m in _TOKEN.finditer(low)]
    # each diagonal with a hit is aligned for itself: what another's band covers may end in the midst of a notice
    found = sorted({(n, a, b, k) for k, diagonal in hits for n, a, b in alignments(the.templates[k], ids, diagonal, least * len(the.templates[k]))}, key=lambda x: (-x[0], x[2] - x[1], x[1], x[3]))
    kept: list[tuple[int, int, int, int]] = []  # (first word, last word, matched words, template), in order
    for n, a, b, k in found:
        i = bisect_left(kept, (a,))
        if (i == 0 or kept[i - 1][1] < a) and (i == len(kept) or kept[i][0] > b):
            kept.insert(i, (a, b, n, k))
    return [(templates[k][0], n / len(the.templates[k]), place[a][0], place[b][1]) for a, b, n, k in kept]


def scan_licenses(docs: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, n_licenses, license, coverage, spans: one row per input row, from whole texts.

    license and coverage are those of the best covered match (the first of equals); spans lists all as
    license:start:end:coverage in the order of the text. A text without a match, or null: 0, null, 0.0, "". A null
    doc_id stays null; repeated rows each give a row; an empty table gives none; other columns are ignored. A very long text is read whole, in memory in proportion to it. Map-only.
    """

    def digest(doc_id, text):
        found = scan(text, least=least)
        top = max(found, key=lambda x: (x[1], -x[2]), default=(None, 0.0))
        return doc_id, len(found), top[0], top[1], ",".join(f"{k}:{a}:{b}:{c:.3f}" for k, c, a, b in found)

    return map_rows(docs, digest, "doc_id long, n_licenses long, license string, coverage double, spans string", ["doc_id", "text"])
