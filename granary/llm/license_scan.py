"""License scans by patience alignment.

A text's words are aligned with a template's: words that are unique to both sides are anchors, the longest
increasing subsequence of anchors is kept, and the gaps between neighbouring anchors are aligned in the same way,
with matching runs at either end of a gap taken first; a gap without anchors gets a longest common subsequence.  The
share of template words that are matched is the coverage.  Only places where enough of a template's words stand
close together, in any order, are aligned; each of them is, until one fits.

Versions, and words that tell licences of one family apart, must agree: a notice of another version or variant is no match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm._common import map_arrow, slices

#: Standard texts of MIT, BSD, ISC and Zlib, and the notices by which files name longer licences.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License.",
    "MIT-grant-line": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-conditions-line": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-grant-line": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.0-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "Unlicense-line": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "All-rights-reserved": "All rights reserved.",
}
#: By words that show a family, words that tell its licences apart.
FAMILIES = (
    (frozenset(("gnu",)), frozenset(("lesser", "affero", "later"))),
    (frozenset(("cc", "creative")), frozenset(("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs"))),
)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_VERSION = re.compile(r"\d+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second members rise (first members do already), by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, by bit vectors: bit j of a row is 0 where a match ends at b[j]."""
    at: dict[str, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for w in a:
        u = rows[-1] & at.get(w, 0)
        rows.append((rows[-1] + u | rows[-1] - u) & full)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif length(i - 1, j) == length(i, j):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, rising on both sides."""
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
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: i for i, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = _increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in at])
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if x1 - x0 > 1 and y1 - y0 > 1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


def _versions(words_: list[str]) -> set[str]:
    return {v for w in words_ for v in _VERSION.findall(w)}


def _parts(words_: list[str]) -> set[str]:
    return {x for w in words_ for x in re.split("[.-]", w)}


class Scanner:
    def __init__(self, templates: Mapping[str, str], least: float = 0.8, slack: float = 1.5):
        self.least, self.slack = least, slack
        self.templates = {name: w for name, text in templates.items() if (w := words(text))}
        self.counts = {name: Counter(w) for name, w in self.templates.items()}
        self.versions = {name: _versions(w) for name, w in self.templates.items()}
        self.contrary: dict[str, frozenset[str]] = {}  # telling words of its family that a template doesn't have
        self.telling: dict[str, frozenset[str]] = {}  # and those that it has
        for name, w in self.templates.items():
            parts = _parts(w)
            own = frozenset().union(*(tell for shown, tell in FAMILIES if shown & parts))
            self.contrary[name], self.telling[name] = own - parts, own & parts

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Matches (template, coverage, first and last word number), in order of place and template.

        A match covers ``least`` of the template's words within ``slack`` times its length; matches of one
        template share no words.  Of two templates' matches at about the same place the better fit stays (matched
        words against the lengths of both sides).  A match whose words all lie in a longer match of another
        template is part of that and isn't reported.
        """
        if not text:
            return []
        own = words(text)
        where: dict[str, list[int]] = {}
        for i, w in enumerate(own):
            where.setdefault(w, []).append(i)
        found: list[tuple[str, float, int, int]] = []
        for name, template in self.templates.items():
            count = self.counts[name]
            need = max(1, -int(-self.least * len(template) // 1))
            if sum(min(n, len(where.get(w, ()))) for w, n in count.items()) < need:
                continue
            span = int(len(template) * self.slack) + 1
            found += [(name, n / len(template), first, last) for n, first, last in self._matches(name, own, where, template, count, need, span)]

        def beaten(x, y) -> bool:
            if x[0] == y[0]:
                return False
            common, long = min(x[3], y[3]) - max(x[2], y[2]) + 1, max(x[3] - x[2], y[3] - y[2]) + 1
            if common >= self.least * long:  # about the same place
                return self._fit(y) > self._fit(x)
            return y[2] <= x[2] and x[3] <= y[3] and y[3] - y[2] > x[3] - x[2]

        return sorted((x for x in found if not any(beaten(x, y) for y in found)), key=lambda x: (x[2], x[0]))

    def _fit(self, match: tuple[str, float, int, int]) -> float:
        size = len(self.templates[match[0]])
        return 2 * match[1] * size / (size + match[3] - match[2] + 1)

    def _agrees(self, name: str, template: list[str], own: list[str], pairs: list[tuple[int, int]]) -> bool:
        matched = [template[i] for i, _ in pairs] if self.versions[name] or self.telling[name] else []
        if not self.versions[name] <= _versions(matched) or not self.telling[name] <= _parts(matched):
            return False
        return not self.contrary[name] or self.contrary[name].isdisjoint(_parts(own[pairs[0][1] : pairs[-1][1] + 1]))

    def _matches(self, name: str, own: list[str], where: dict[str, list[int]], template: list[str], count: Counter, need: int, span: int) -> list[tuple[int, int, int]]:
        """Disjoint matches (words matched, first, last): close copies before copies with words between."""
        hits = sorted(i for w in count for i in where.get(w, ()))

        def aligned(lo: int, hi: int) -> tuple[int, int, int]:
            pairs = align(template, own[lo:hi])
            if len(pairs) < need:  # words that stand here twice can lead the anchors astray
                pairs = common(template, own[lo:hi])
            if len(pairs) < need or not self._agrees(name, template, own[lo:hi], pairs):
                return 0, lo, lo
            return len(pairs), lo + pairs[0][1], lo + pairs[-1][1]

        out: list[tuple[int, int, int]] = []
        for size in (len(template), span):
            edges = [(-1, -1), *((x[1], x[2]) for x in out), (len(own), len(own))]
            todo = [(x[1] + 1, y[0]) for x, y in zip(edges, edges[1:], strict=False)]
            while todo:
                lo, hi = todo.pop()
                group = self._windows(own, hits, count, need, size, lo, hi) if hi - lo >= need else {}
                for start in sorted(group, key=lambda s: (-group[s], s)):
                    match = aligned(start, min(hi, start + size))
                    if match[0] >= need:
                        out.append(match)
                        todo += [(match[2] + 1, hi), (min(group), match[1])]
                        break
                else:
                    if group:
                        todo.append((max(group) + 1, hi))
            out.sort(key=lambda x: x[1])
            # With words between, a copy may go on beyond its close part.
            for i, (_, first, last) in enumerate(out):
                lo, hi = out[i - 1][2] + 1 if i else 0, out[i + 1][1] if i + 1 < len(out) else len(own)
                if out[i][0] < len(template):
                    out[i] = max(out[i], aligned(first, min(hi, first + span)), aligned(max(lo, last + 1 - span), last + 1), key=lambda x: x[0])
        return out

    @staticmethod
    def _windows(own: list[str], hits: list[int], count: Counter, need: int, span: int, lo: int, hi: int) -> dict[int, int]:
        """The first group of overlapping runs of ``span`` words in lo..hi that hold enough: start, words held."""
        window: Counter = Counter()
        left, held, best = bisect_left(hits, lo), 0, -1
        group: dict[int, int] = {}
        for at in range(left, bisect_left(hits, hi)):
            i = hits[at]
            while hits[left] <= i - span:
                w = own[hits[left]]
                window[w] -= 1
                held -= window[w] < count[w]
                left += 1
            w = own[i]
            held += window[w] < count[w]
            window[w] += 1
            if group and hits[left] > best + span - 1:
                break
            if held >= need:
                group[hits[left]] = max(held, group.get(hits[left], 0))
                if best < 0 or group[hits[left]] > group[best]:
                    best = hits[left]
        return group


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", *, least: float = 0.8) -> DataFrame:
    """One row per match: id_col, license, coverage (0 to 1), first_word, last_word (numbers from 0).

    Whole texts are scanned, each by itself: no shuffle.  Null, empty and license-free texts give no row;
    repeated rows give repeated matches; ids may be null; other columns are not read, so their names can't clash.  Of
    templates that fit a place equally well, all are reported.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, license string, coverage double, first_word long, last_word long"

    def run(batches):
        scanner = Scanner(templates, least)
        for batch in slices(batches, text_col):
            rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in scanner.scan(t)]
            if rows:
                at, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(x) for x in rest)], names=[id_col, "license", "coverage", "first_word", "last_word"])

    return map_arrow(docs.select(id_col, text_col), run, schema)
