"""License scans by patience alignment.

Where a word that marks a template occurs in a text, the words around it are
aligned with the template: words unique to both are anchors, the longest run of
anchors in the same order is kept, and the gaps between them are aligned in the
same way.  Coverage is the share of the template's words that are aligned.

Windows around marking words may miss words, so a template of ``SPREAD`` words
or more that the text has enough words of, wherever they stand, is also aligned
with the whole text by its longest common subsequence: such a license is found
if and only if enough of its words are there in order, whatever is inserted
between them.  Shorter notices stay within a window, since their few words occur
in order by chance in a long text; their marking words are as many as it takes
that one is always left.

Of templates that align with the same words, the one that fits best is carried:
variants that contain one another are told apart.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template's words from which a text carries the license.
LEAST = 0.8
#: Words of a template that are looked for at least, rarest among templates first.
SEEDS = 3
#: Words of a template from which it is also looked for in the text as a whole.
SPREAD = 15
STRIP = b".,;:!?\"'()[]{}<>*#-/|"

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. """
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. """
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the
        Free Software Foundation, either version {2} of the License, or (at your option) any later version."""

#: MIT, ISC and BSD licenses as a whole, the notices that Apache and GNU licenses are applied with, and one-line notices.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
        IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_GRANT + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY,
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "GPL-2.0-or-later": _GNU.format("program", "General Public License", "2"),
    "GPL-3.0-or-later": _GNU.format("program", "General Public License", "3"),
    "AGPL-3.0-or-later": _GNU.format("program", "Affero General Public License", "3"),
    "LGPL-2.1-or-later": _GNU.format("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": _GNU.format("library", "Lesser General Public License", "3"),
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, without punctuation around them (a word of nothing else stays)."""
    return [w.strip(STRIP) or w for w in text.encode().lower().split()]


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, whose second values rise: patience piles with links back."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[pile], ends[pile] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), rising in both."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = _longest_rising([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in at])
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            stack.append((i + 1, k, j + 1, m))
    return sorted(out)


def longest(a: list[tuple[int, bytes]], b: list[bytes]) -> list[tuple[int, int]]:
    """A longest common subsequence as (place in the text, in b); a: places and words of the text.  One bit a word of b."""
    masks: dict[bytes, int] = {}
    for j, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]  # zeros of the lowest j bits: the length with the first j words of b
    for _, w in a:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    most = len(b) - v.bit_count()
    i, j = next(k for k, r in enumerate(rows) if len(b) - r.bit_count() == most), len(b)
    out = []
    while i and j:
        if a[i - 1][1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((a[i][0], j))
            continue
        low = (1 << j) - 1
        if (rows[i - 1] & low).bit_count() == (rows[i] & low).bit_count():
            i -= 1
        else:
            j -= 1
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.templates = {k: words_of(t) for k, t in templates.items()}
        self.counts = {k: Counter(ws) for k, ws in self.templates.items()}
        self.least = least
        spread = Counter(w for ws in self.templates.values() for w in set(ws))
        self.seeds: dict[bytes, list[tuple[str, int]]] = {}
        for name, ws in self.templates.items():
            missing = max(m for m in range(len(ws) + 1) if not m or (len(ws) - m) / len(ws) >= least)  # words that may lack
            once = [w for w, n in Counter(ws).items() if n == 1 and len(w) > 1] or list(dict.fromkeys(ws))
            if len(ws) < SPREAD and len(once) <= missing:
                once = list(dict.fromkeys(ws))
            n = SEEDS if len(ws) >= SPREAD else max(SEEDS, missing + 1)
            for w in sorted(once, key=lambda w: (spread[w], -len(w), w))[:n]:
                self.seeds.setdefault(w, []).extend((name, at) for at, x in enumerate(ws) if x == w)

    def _spread(self, words: list[bytes]) -> list[str]:
        """Long templates that the text has enough words of, in whatever order."""
        n, out = None, []
        present = set(words)
        for name, ws in self.templates.items():
            if len(ws) < SPREAD or sum(self.counts[name][w] for w in present & self.counts[name].keys()) / len(ws) < self.least:
                continue
            n = n or Counter(words)
            if sum(min(c, n[w]) for w, c in self.counts[name].items()) / len(ws) >= self.least:
                out.append(name)
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int, list[tuple[int, int]]]]:
        """(template, coverage, first word, last word, aligned places) of the best place of each template that is met."""
        words = words_of(text)
        windows: set[tuple[str, int]] = set()
        for p, w in enumerate(words):
            for name, at in self.seeds.get(w, ()):
                windows.add((name, p - at))
        best: dict[str, tuple] = {}

        def keep(name: str, got: list[tuple[int, int]], o: int) -> None:
            if got and (key := (len(got) / len(self.templates[name]), -(got[0][0] + o), -(got[-1][0] + o))) > best.get(name, ((0.0, 0, 0),))[0]:
                best[name] = (key, got, o)

        for name, start in windows:
            t = self.templates[name]
            slack = len(t) // 4 + 2
            lo = max(0, start - slack)
            own = words[lo : max(0, start + len(t) + slack)]
            # the template's own place, without the slack, where the text around repeats its words
            for x, o in ((own, lo), (words[max(0, start) : max(0, start + len(t))], max(0, start))):
                keep(name, align(x, t), o)
        for name in self._spread(words):
            if name not in best or best[name][0][0] < 1:
                keep(name, longest([x for x in enumerate(words) if x[1] in self.counts[name]], self.templates[name]), 0)
        return [(k, c, -a, -b, [(i + o, j) for i, j in got]) for k, ((c, a, b), got, o) in best.items()]

    def carried(self, found: list[tuple[str, float, int, int, list[tuple[int, int]]]]) -> list[tuple[str, float, int, int, list[tuple[int, int]]]]:
        """Those that reach the least coverage, without any that has most of its words in common with one that fits better."""

        def fit(x: tuple) -> int:
            """Two for each aligned word, less the words lacking in each gap, or one for a gap of other words only."""
            at = [(x[4][0][0] - 1, -1), *x[4], (x[4][-1][0] + 1, len(self.templates[x[0]]))]
            return 2 * len(x[4]) - sum(max(j - n - 1, i > m + 1) for (m, n), (i, j) in zip(at[:-1], at[1:], strict=True))

        out: list[tuple] = []
        for fits, x in sorted(((fit(x), x) for x in found if x[1] >= self.least), key=lambda y: (-y[0], y[1][0])):
            own = {i for i, _ in x[4]}
            if all(fits == other or 2 * len(own & words) <= len(own) for other, words, _ in out):
                out.append((fits, own, x))
        return [x for _, _, x in out]


def _scan(templates: dict[str, str], least: float):
    def run(batches):
        scanner = Scanner(templates, least)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = []
                for text in part.column(1).to_pylist():
                    met = scanner.scan(text or "")
                    by = lambda x: (-x[1], -len(scanner.templates[x[0]]), x[0])
                    carried = sorted(scanner.carried(met), key=by)
                    name, share, first, last = (carried or sorted(met, key=by) or [(None, 0.0, None, None)])[0][:4]
                    found.append((name if carried else None, share, first, last, [x[0] for x in carried]))
                cols = list(zip(*found, strict=True))
                types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "license", "coverage", "first_word", "last_word", "licenses"])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, licenses) for each row of ``docs``.

    coverage, first_word and last_word (from 0) are of the best aligned
    template: highest coverage, then the longest, then by name.  license is its
    name if coverage reaches ``least``, licenses all names that do, without
    those that another one with the same words fits better.  A text
    that no template touches, an empty or a null one has coverage 0 and nulls.
    Repeated rows are scanned each; other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scan(templates or TEMPLATES, least), f"doc_id {kind}, license string, coverage double, first_word long, last_word long, licenses array<string>")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
