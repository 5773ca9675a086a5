"""License notices in documents by patience alignment.

A document's words are aligned with a license template: words that occur once in both are anchors, the longest
increasing subsequence of their places is kept, and the gaps between kept anchors are aligned in the same way. What is
aligned, as a share of the template's words, is its coverage. A document is looked at wherever it holds a short run of
the template's words, so that a notice inside a long document is found whichever of its words are changed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices

# Notices and texts of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "mit-notice": "Released under the MIT License.",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        'appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
SCHEMA = "doc_id long, license string, coverage double, start long, end long, matched long"


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first place, whose second places increase (patience sorting)."""
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
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, increasing in both. Equal ends are taken first, then anchors, then the gaps between."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        kept = increasing([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if kept:
            out.extend(kept)
            ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
            todo.extend((p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:], strict=False))
    return sorted(out)


class Scanner:
    """Finds every stretch of a text that a template covers well enough.

    Seeds are all runs of a template's words of such a length that a text which covers enough of it holds one, whichever
    words are missing or replaced: n - c of n words part the others into n - c + 1 runs at most, and the longest of these
    has c / (n - c + 1) words. Each seed says where in the text the template would begin. Only words put between nearly
    all of a notice's words can hide it.
    """

    def __init__(self, templates: dict[str, str], min_coverage: float):
        self.min_coverage = min_coverage
        self.templates = {k: words(t) for k, t in templates.items()}
        self.seeds: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for name, template in self.templates.items():
            n = len(template)
            missing = n - self._needed(n)
            size = max(1, self._needed(n) // (missing + 1))
            for o in range(n - size + 1):
                self.seeds.setdefault(tuple(template[o : o + size]), []).append((name, o))
        self.bags = {k: Counter(t) for k, t in self.templates.items()}
        self.sizes = sorted({len(s) for s in self.seeds})
        self.first = {s[0] for s in self.seeds}

    def _needed(self, n: int) -> int:
        return -(-int(n * self.min_coverage * 10_000 + 0.5) // 10_000)

    def begins(self, ws: list[str]) -> dict[str, Counter]:
        """Where each template would begin, and how many seeds in the text say so."""
        found: dict[str, Counter] = {}
        first, seeds, sizes = self.first, self.seeds, self.sizes
        for k, w in enumerate(ws):
            if w in first:
                for size in sizes:
                    for name, o in seeds.get(tuple(ws[k : k + size]), ()):
                        found.setdefault(name, Counter())[k - o] += 1
        return found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, last word + 1, words aligned) of every region that a template covers well enough, best one for each place."""
        ws = words(text or "")
        found = [f for name, votes in self.begins(ws).items() for f in self._within(name, ws, votes)]
        found.sort(key=lambda f: (-f[4], -f[1], f[3] - f[2], f[2], f[0]))
        kept: list = []
        starts: list[int] = []  # of those kept, which don't overlap
        for f in found:
            at = bisect_left(starts, f[2])
            if (at == len(kept) or f[3] <= kept[at][2]) and (at == 0 or kept[at - 1][3] <= f[2]):
                kept.insert(at, f)
                starts.insert(at, f[2])
        return kept

    def _within(self, name: str, ws: list[str], votes: Counter) -> list[tuple]:
        """Alignments where the template may begin, what most seeds say first; later ones get what is left between them."""
        template = self.templates[name]
        n = len(template)
        slack = max(2, n // 4)
        bag, needed = self.bags[name], self._needed(n)
        inside = [0, *accumulate(w in bag for w in ws)]
        places, alive, k = sorted(votes), [], 0
        while k < len(places):
            j = k + 1
            while j < len(places) and places[j] - places[k] <= slack:
                j += 1
            lo, hi = max(0, places[k] - slack), min(len(ws), places[j - 1] + 2 * n)
            # fewer of the template's words than are needed can't cover it, however they lie
            if hi > lo and inside[hi] - inside[lo] >= needed and sum((Counter(ws[lo:hi]) & bag).values()) >= needed:
                alive += places[k:j]
            k = j
        taken: list[tuple[int, int, tuple | None]] = []  # stretches that are done, apart from each other
        for begin in sorted(alive, key=lambda b: (-votes[b], b)):
            at = bisect_left(taken, (begin + n // 2,))
            if at and taken[at - 1][1] > begin + n // 2:
                continue
            lo, hi = (taken[at - 1][1] if at else 0), (taken[at][0] if at < len(taken) else len(ws))
            best = None
            for d, e in ((0, 0), (0, slack), (-slack, 0), (-slack, slack), (0, n), (-slack, n)):
                t = self._aligned(name, template, ws, max(lo, begin + d), min(hi, begin + n + e))
                if t and (best is None or (t[4], t[2] - t[3]) > (best[4], best[2] - best[3])):
                    best = t
                if best and best[1] == 1:
                    break
            if best:
                insort(taken, (best[2], best[3], best))
        return [t[2] for t in taken]

    def _aligned(self, name: str, template: list[str], ws: list[str], begin: int, end: int) -> tuple | None:
        n = len(template)
        pairs = align(ws[begin:end], template) if end - begin >= self.min_coverage * n else []
        if not pairs:
            return None
        # the densest stretch: drop aligned words far from the rest
        middle = pairs[len(pairs) // 2][0] - pairs[len(pairs) // 2][1]
        near = [p for p in pairs if abs(p[0] - p[1] - middle) <= n]
        first, last = begin + near[0][0], begin + near[-1][0] + 1
        return (name, len(near) / n, first, last, len(near)) if len(near) >= self._needed(n) and last - first <= 2 * n else None


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.75) -> DataFrame:
    """A row (columns as in SCHEMA) for each license notice in each row of ``docs``; places are word numbers.

    Whole texts are read. Null and empty texts have no rows. Repeated documents give repeated rows; other columns are
    ignored; an empty table gives none.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, min_coverage)
        for whole in batches:
            for b in slices(whole, 1, 2000):
                rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for f in scanner.scan(t)]
                if rows:
                    types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "license", "coverage", "start", "end", "matched"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)
