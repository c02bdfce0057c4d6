"""License scans by patience alignment.

A template and a region of a text are aligned on the words unique to both: their longest increasing
subsequence anchors the alignment, and the gaps between anchors are aligned again in the same way, where words
that repeated before may now be unique. Equal words next to an anchor extend it first. Coverage is the share of
the template's words that are aligned. Regions are runs of text in which the template's rarer words occur, so
that several notices in one text are aligned each for themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm._shared import small_batches

# License notices to look for, by SPDX-like names.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}
#: Share of a template's words that a region has to cover.
COVERAGE = 0.8
#: Words too common to start a region.
COMMON = frozenset("a all and any are as at be by for from in is it not of on or that the this to under use was with you your without may".split())
_TOKEN = re.compile(r"[^\W_]+(?:[.][0-9]+)*")


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; version numbers stay whole."""
    return _TOKEN.findall((text or "").lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (a, b), sorted by a, whose b increase: piles of patience, then back along them."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, increasing in both. Gaps are worked off a stack, not by call depth."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        once = {w for w, n in Counter(template[c:d]).items() if n == 1}
        seen = Counter(w for w in text[a:b] if w in once)
        place = {template[k]: k for k in range(c, d) if seen.get(template[k]) == 1}
        anchors = _increasing([(k, place[text[k]]) for k in range(a, b) if text[k] in place])
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)] if anchors else []
        gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if p + 1 < r and q + 1 < s]
    return sorted(found)


class Scanner:
    """Templates, and for each rare word the templates that it starts regions of."""

    def __init__(self, templates: Mapping[str, str], coverage: float) -> None:
        self.names, self.coverage = list(templates), coverage
        self.words = [tokens(t) for t in templates.values()]
        self.rare: dict[str, list[int]] = {}
        for k, words in enumerate(self.words):
            own = set(words) - COMMON or set(words)
            for w in own:
                self.rare.setdefault(w, []).append(k)
        self.rare_counts = [len([w for w in words if k in self.rare.get(w, ())]) for k, words in enumerate(self.words)]

    def regions(self, places: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Runs of places with gaps of at most half a template's words, and 4 at least."""
        reach = max(4, size // 2)
        first = last = places[0]
        for p in places[1:]:
            if p - last > reach:
                yield first, last
                first = p
            last = p
        yield first, last

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, end, aligned words) of every region that covers enough of a template."""
        words = tokens(text)
        places: dict[int, list[int]] = {}
        rare = self.rare
        for p, w in enumerate(words):
            if w in rare:
                for k in rare[w]:
                    places.setdefault(k, []).append(p)
        out = []
        for k, at in places.items():
            template = self.words[k]
            for first, last in self.regions(at, len(template)):
                self._cover(words, max(0, first - len(template)), min(len(words), last + len(template) + 1), k, out)
        return sorted(_apart(out), key=lambda r: (r[2], r[0]))

    def _cover(self, words: list[str], low: int, high: int, k: int, out: list) -> None:
        """Alignments of a template in words[low:high]; where it occurs more than once, the parts between are searched too."""
        template, stack = self.words[k], [(low, high)]
        while stack:
            low, high = stack.pop()
            if high - low < self.coverage * len(template):
                continue
            pairs = _densest(align(words[low:high], template), len(template))
            share = len(pairs) / len(template)
            if share >= self.coverage:
                first, end = low + pairs[0][0], low + pairs[-1][0] + 1
                out.append((self.names[k], share, first, end, len(pairs)))
                stack += [(low, first), (end, high)]
            elif high - low > 2 * len(template):
                # words that a second notice repeats anchor nothing: look at halves that share a template's length
                middle = (low + high) // 2
                stack += [(low, middle + len(template) // 2), (middle - len(template) // 2, high)]
            else:
                self._slide(words, low, high, k, out)

    def _slide(self, words: list[str], low: int, high: int, k: int, out: list) -> None:
        """Alignments in every window of a template's length, and of a quarter more, that holds enough of its words."""
        template = self.words[k]
        need = Counter(template)
        for size in {len(template), len(template) + len(template) // 4 + 1}:
            held: Counter[str] = Counter()
            common = 0
            for p in range(low, high):
                w = words[p]
                held[w] += 1
                common += held[w] <= need[w]
                if p - low >= size:
                    w = words[p - size]
                    common -= held[w] <= need[w]
                    held[w] -= 1
                if common < self.coverage * len(template):
                    continue
                start = max(low, p + 1 - size)
                pairs = align(words[start : p + 1], template)
                if len(pairs) >= self.coverage * len(template):
                    out.append((self.names[k], len(pairs) / len(template), start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs)))


def _apart(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Of notices that share more than half of the shorter one's words, the one with more aligned words."""
    kept: list[tuple[str, float, int, int, int]] = []
    starts: list[int] = []
    longest = max((r[3] - r[2] for r in found), default=0)
    for r in sorted(found, key=lambda r: (-r[4], -r[1], r[2], r[0])):
        near = _between(kept, starts, r[2] - longest, r[3])
        if all(2 * (min(r[3], k[3]) - max(r[2], k[2])) <= min(r[3] - r[2], k[3] - k[2]) for k in near):
            at = bisect_left(starts, r[2])
            starts.insert(at, r[2])
            kept.insert(at, r)
    return kept


def _between(kept: list, starts: list[int], low: int, high: int) -> list:
    """Kept notices that start in low..high; starts is sorted like kept."""
    return kept[bisect_left(starts, low) : bisect_left(starts, high)]


def _densest(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Most aligned pairs within twice the template's length of text, so that stray words far off don't count."""
    best, start = (0, 0), 0
    for end in range(1, len(pairs) + 1):
        while pairs[end - 1][0] - pairs[start][0] >= 2 * size:
            start += 1
        if end - start > best[1] - best[0]:
            best = (start, end)
    return pairs[best[0] : best[1]]


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row for every notice found: id, license, coverage, start, end (words of the text, end exclusive), aligned.

    Whole texts are scanned; null and empty texts have no notice. Words that several templates cover well count
    for the one that aligns most of them, ties by coverage, then name. Repeated rows are reported each; an empty
    table gives no rows. Templates are parameters of a job, bounded by what its author wrote.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    scanner = Scanner(templates, coverage)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(k, *f) for k, t in enumerate(b.column("text")) for f in scanner.scan(t.as_py())]
            if hits:
                at, *columns = zip(*hits, strict=True)
                kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), *arrays], names=["id", "license", "coverage", "start", "end", "aligned"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, license string, coverage double, start int, end int, aligned int"
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
