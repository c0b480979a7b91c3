"""License scans by patience alignment of a text with license templates.

Words that occur once in both the text and the template are anchors; the longest increasing run of their places is kept,
and the gaps between them are aligned the same way, after equal words at their ends; a gap without anchors is aligned by a
longest common subsequence. The share of the template's words that are aligned is its coverage; place and coverage of a license
are those of that alignment, over the best of the stretches tried. Stretches overlap: one begins at each word that can be the
first one aligned, and is tried, in the lengths of ENDS times the template's, if it holds enough of the template's words at all,
an upper bound of its coverage. A license spread over more words than the last of ENDS allows is not found. Each
license that is known by a name must show it, with its version, in the aligned stretch.

Cases: a version's final `.0` is no part of it. Null and empty texts have no license, an empty table gives no rows; very long texts are
scanned whole. Equal coverage goes to the template with more words, then by name; equal
stretches of a template to the first. Repeated rows are rows of their own; columns other than `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import only, small_batches, table

COVERAGE = 0.8
#: Lengths of the stretches that are aligned, times the template's words.
ENDS = (1.0, 1.25, 1.5, 2.0)
_WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")
_ZERO = re.compile(r"(?<=[0-9])(?:\.0)+(?![^\W_]|\.[^\W_])")

#: Notices and license texts, as published.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "BSD-notice": "Released under the BSD 3-Clause License",
    "GPL-3.0-notice": "Licensed under the GNU General Public License, version 3",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Runs of words that tell a license from others of nearly the same text.
NAMED = {
    "MIT-notice": ("mit",),
    "MIT-licensed": ("mit",),
    "Apache-2.0-notice": ("apache license", "2"),
    "BSD-notice": ("bsd", "3"),
    "GPL-3.0-notice": ("gnu general public license", "3"),
    "CC-BY-4.0-notice": ("attribution 4",),
    "CC-BY-SA-4.0-notice": ("attribution sharealike 4",),
    "CC-BY-NC-4.0-notice": ("by nc 4",),
    "CC-BY-NC-4.0-work": ("attribution noncommercial 4",),
    "MPL-2.0": ("mozilla public license", "2"),
    "Apache-2.0": ("apache license", "2"),
    "GPL-3.0": ("gnu general public license", "version 3"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3"),
    "AGPL-3.0": ("gnu affero general public license", "version 3"),
    "BSD-3-Clause": ("neither the name",),
}
#: Identifiers whose lines are templates, too: `SPDX-License-Identifier: <id>`.
IDENTIFIERS = "MIT ISC Unlicense 0BSD Zlib BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()


def words_of(text: str) -> list[str]:
    return _WORD.findall((_ZERO.sub("", text) if ".0" in text else text).lower())


for _id in IDENTIFIERS:
    TEMPLATES[f"{_id}-identifier"] = f"SPDX-License-Identifier: {_id}"
    NAMED[f"{_id}-identifier"] = (f"identifier {' '.join(words_of(_id))}",)


def increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) of a longest common subsequence, bit-parallel; it ends as early in a as one can."""
    bits: dict[str, int] = {}
    for j, w in enumerate(b):
        bits[w] = bits.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]  # bit j is 0 where the length grows at place j
    for w in a:
        v = rows[-1]
        u = v & bits.get(w, 0)
        rows.append(((v + u) | (v - u)) & full)
    least = rows[-1].bit_count()
    i, j = next(k for k, v in enumerate(rows) if v.bit_count() == least), len(b)
    out = []
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif rows[i - 1] >> (j - 1) & 1:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            i -= 1
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) that a patience alignment matches."""
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
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        anchors = [(i, where[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in where]
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        out += kept
        edge = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edge, edge[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], named: dict[str, tuple[str, ...]]):
        self.words = {k: words_of(t) for k, t in templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.named = {k: named.get(k, ()) for k in templates}
        self.every = set().union(*self.counts.values())

    def stretches(self, name: str, hits: list[tuple[int, str]], least: float) -> Iterator[tuple[int, int, float]]:
        """(first word, end word, bound of the coverage) of each longest stretch that may cover the least share of the template."""
        t, counts = self.words[name], self.counts[name]
        first = set(t[: int(len(t) * (1 - least) + 1e-9) + 1])
        own = [(i, w) for i, w in hits if w in counts]
        have: Counter = Counter()
        n = end = 0
        for i, w in own:
            while end < len(own) and own[end][0] < i + ENDS[-1] * len(t):
                x = own[end][1]
                have[x] += 1
                n += have[x] <= counts[x]
                end += 1
            if w in first and n >= least * len(t):
                yield i, own[end - 1][0] + 1, n / len(t)
            n -= have[w] <= counts[w]
            have[w] -= 1

    def scan(self, text: str, least: float) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, end word) of each template found, the best stretch of each."""
        words = words_of(text)
        hits = [(i, w) for i, w in enumerate(words) if w in self.every]
        have = Counter(w for _, w in hits)
        out = []
        for name, t in self.words.items():
            if sum(min(n, have[w]) for w, n in self.counts[name].items()) < least * len(t) or not all(w in have for p in self.named[name] for w in p.split()):
                continue
            best = None
            for lo, hi, bound in self.stretches(name, hits, least):
                if best and bound <= best[1]:
                    continue
                for end in dict.fromkeys(min(hi, lo + int(e * len(t))) for e in ENDS):
                    got = align(words[lo:end], t)
                    share = len(got) / len(t)
                    if share >= least and not (best and share <= best[1]):
                        a, b = lo + got[0][0], lo + got[-1][0] + 1
                        shown = f" {' '.join(words[a:b])} "
                        if all(f" {p} " in shown for p in self.named[name]):
                            best = (name, share, a, b)
                    if best and bound <= best[1]:
                        break
                if best and best[1] == 1:
                    break
            if best:
                out.append(best)
        return sorted(out, key=lambda x: (-x[1], -len(self.words[x[0]]), x[0]))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """doc_id, the best license (null if none), its coverage and place in words, and all licenses found."""
    given, named = (TEMPLATES, NAMED) if templates is None else (templates, {})
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(given, named)
        for b in batches:
            found = [scanner.scan(t, least) for t in b["text"]]
            top = [f[0] if f else (None, 0.0, None, None) for f in found]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "license": [t[0] for t in top], "coverage": [round(t[1], 6) for t in top],
                "first_word": pd.array([t[2] for t in top], dtype="Int64"), "end_word": pd.array([t[3] for t in top], dtype="Int64"), "licenses": [sorted(x[0] for x in f) for f in found],
            })

    text = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.mapInPandas(run, "doc_id long, license string, coverage double, first_word long, end_word long, licenses array<string>")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
