"""License scans by patience alignment.

A text and a license template are word sequences. Words that stand once in both are anchors; the
longest increasing run of anchors is kept, and the gaps between them are aligned the same way.
Coverage is the share of the template's words that are matched. A text is looked at in windows of
twice a template's length, one template length apart, so that a notice lies whole in one of them
wherever it stands; a window is aligned where enough different words of the template occur in it,
without which no alignment could reach the least coverage.

Defined results: null and empty text has no license; of overlapping findings the one with the best
coverage stays, then the longest template, then the first name; repeated notices count each;
repeated rows are scanned alike; work is linear in a text for a given set of templates.
"""

import bisect
import re

import numpy as np
from pyspark.sql import DataFrame

from memlake.llm import rows

WORD = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")
LEAST = 0.8

# Short notices of public licenses, and the notice texts that the licenses themselves ask for.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "public-domain": "This work has been released into the public domain.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-line": "This library is licensed under the GNU Lesser General Public License.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version. This program is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def _once(seq, low, high) -> dict:
    """Values that stand once between two positions, with their position."""
    seen = {}
    for i in range(low, high):
        seen[seq[i]] = -1 if seq[i] in seen else i
    return {v: i for v, i in seen.items() if i >= 0}


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence, by patience sorting."""
    tops, at, before = [], [], []
    for i, v in enumerate(values):
        pile = bisect.bisect_left(tops, v)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched positions (text, template) of a patience alignment, ascending in both."""
    out, waiting = [], [(0, len(text), 0, len(template))]
    while waiting:
        a, b, c, d = waiting.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = _once(text, a, b), _once(template, c, d)
        anchors = sorted((i, theirs[v]) for v, i in mine.items() if v in theirs)
        kept = [anchors[i] for i in _increasing([q for _, q in anchors])]
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        if kept:
            waiting += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:])]
    return sorted(out)


class Templates:
    """Templates as word ids; words of no template are -1."""

    def __init__(self, texts: dict[str, str], least: float):
        self.names, self.least = sorted(texts), least
        words = [[w.lower() for w in WORD.findall(texts[n])] for n in self.names]
        self.ids = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.words = [[self.ids[w] for w in ws] for ws in words]
        self.has = np.zeros((len(words), len(self.ids)), np.int64)
        for k, ws in enumerate(self.words):
            self.has[k, ws] = 1
        # occurrences of a template's words that a coverage needs, at the least, as different words
        self.need = np.array([max(1, len(set(ws)) - int(len(ws) * (1 - least) + 1e-9)) for ws in self.words])

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(name, start, end, coverage) of the notices in a text, in code points, by start."""
        ids = np.array([self.ids.get(w.lower(), -1) for w in WORD.findall(text)], np.int64)
        present = np.zeros(len(self.ids), np.int64)
        present[ids[ids >= 0]] = 1
        likely = np.flatnonzero(self.has @ present >= self.need)
        found = []
        for k in likely:
            found += self._notices(ids, int(k))
        if not found:
            return []
        taken, kept = [], []
        for cover, length, k, start, end in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            if not any(s < end and start < e for s, e in taken):
                taken.append((start, end))
                kept.append((k, start, end, cover))
        place = [m.span() for m in WORD.finditer(text)]
        return sorted(((self.names[k], place[s][0], place[e - 1][1], c) for k, s, e, c in kept), key=lambda f: f[1:])

    def _notices(self, ids: np.ndarray, k: int):
        words = self.words[k]
        n, mine = len(words), np.append(self.has[k] > 0, False)
        at = np.flatnonzero(mine[ids])
        # windows (start, length) that hold template words; finer ones where a wide one is not enough
        for i in sorted({int(a) // n for a in at} | {int(a) // n - 1 for a in at if a >= n}):
            found = self._aligned(ids, k, i * n, 2 * n)
            if found is None:
                continue
            if not found:
                step = max(1, n // 4)
                for s in range(i * n, i * n + n + 1, step):
                    found = found or self._aligned(ids, k, s, n + step)
            if found:
                yield found

    def _aligned(self, ids, k, start, length):
        """None where too few words are there, () where the coverage is too small."""
        part = ids[start:start + length]
        if len(set(part[part >= 0].tolist()) & set(self.words[k])) < self.need[k]:
            return None
        pairs = align(part.tolist(), self.words[k])
        cover = len(pairs) / len(self.words[k])
        if cover < self.least - 1e-9:
            return ()
        return cover, len(self.words[k]), k, start + pairs[0][0], start + pairs[-1][0] + 1


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_licenses, license and coverage (of the best finding), spans (name:start:end) per row."""

    def make():
        templates = Templates(texts, least)

        def work(cols):
            found = [templates.find(t) for t in rows.texts(cols["text"])]
            best = [min(f, key=lambda x: (-x[3], x[1])) if f else None for f in found]
            return {"doc_id": cols["doc_id"], "n_licenses": [len(f) for f in found],
                    "license": [b[0] if b else None for b in best], "coverage": [b[3] if b else 0.0 for b in best],
                    "spans": [",".join(f"{n}:{s}:{e}" for n, s, e, _ in f) for f in found]}

        return work

    return rows.map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"),
                            "doc_id long, n_licenses long, license string, coverage double, spans string", make)
