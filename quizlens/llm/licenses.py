"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates are normalised to words. Hashes of GRAM consecutive words are winnowed (the smallest of each WINNOW
consecutive ones is kept, the last on ties), and an inverted index leads from a fingerprint to the templates and
places that have it; it is built from the fixed templates, so its size is. A document is winnowed in the same
way (grams with a word that no template has can match nothing and count as larger than all others, which keeps
the guarantee: GRAM + WINNOW - 1 consecutive words shared with a template share a fingerprint). Hits of one template are
chained in the order of both texts; a chain is a candidate, and the words around it are aligned with the template in a
band as wide as the chain strays from one diagonal, and BAND words more. So words put in, left out or replaced
move the band, not the match out of it. A candidate counts when matched words cover enough of the template.

The templates are notices, and whole texts of the short licenses; licenses of many pages (GPL, LGPL, AGPL, MPL, Apache, CC) are
known by their notices alone.

Defined results: a null or empty text has no match; where templates compete for the same words, the one that
explains most has them (matched words less missing ones, then the earlier, then by name); spans are code points of the original text, ends exclusive; repeated rows give a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import narrow, workspace

GRAM = 3
WINNOW = 2
#: Share of a template's words that must match, in order.
COVERAGE = 0.8
#: Words that an alignment may stray from its chain (half the template at most).
BAND = 16

# Public notices and license texts, by SPDX id.
_NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
}
_TEXTS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}
TEMPLATES: list[tuple[str, str]] = [(k, v) for d in (_NOTICES, _TEXTS) for k, v in d.items()]

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x20]+")
_NONE = np.uint64((1 << 64) - 1)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Index:
    """Inverted index of winnowed fingerprints: fingerprint to (template, place)."""

    def __init__(self, templates: list[tuple[str, str]], gram: int = GRAM, winnow: int = WINNOW):
        self.names, self.gram, self.winnow = [n for n, _ in templates], gram, winnow
        self.number: dict[bytes, int] = {}
        self.texts = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(t)], np.int64) for _, t in templates]
        self.mix = np.array([xxhash.xxh64_intdigest(str(i).encode(), 5) for i in range(len(self.number) + 1)], np.uint64)
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, ids in enumerate(self.texts):
            hashes, places = self.fingerprints(ids)
            for h, p in zip(hashes.tolist(), places.tolist(), strict=True):
                self.postings[h].append((k, p))
        self.known = np.array(sorted(self.postings), np.uint64)

    def fingerprints(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winnowed hashes and their places; a text shorter than a window keeps its smallest gram."""
        g, w = self.gram, self.winnow
        if len(ids) < g:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        x = self.mix[ids]
        hashes = np.zeros(len(ids) - g + 1, np.uint64)
        whole = np.ones(len(hashes), bool)
        for i in range(g):
            hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + x[i : i + len(hashes)]
            whole &= ids[i : i + len(hashes)] > 0
        hashes ^= hashes >> np.uint64(29)
        hashes[~whole] = _NONE
        n = len(hashes) - w + 1
        if n <= 0:
            keep = np.array([int(hashes.argmin())])
        else:
            view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], w)[::-1]
            keep = np.unique(np.arange(n) + w - 1 - view.argmin(axis=1))  # reversed, so the last of equals
        keep = keep[hashes[keep] != _NONE]
        return hashes[keep], keep

    def stray(self, k: int) -> int:
        return max(2, len(self.texts[k]) // 2)

    def chains(self, k: int, hits: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """Longest chains of hits (place in the document, place in the template) that ascend in both; a step may leave
        the diagonal by half the template at most, as a notice said again is no detour."""
        n, stray = len(self.texts[k]), self.stray(k)
        size, last, place, diagonal = (np.full(n, x) for x in (0, -1, -(10**9), -(10**9)))  # by template's place
        before, extended = [-1] * len(hits), [False] * len(hits)
        for i, (at, p) in enumerate(hits):
            d = at - p
            fit = (np.abs(diagonal[:p] - d) <= stray) & (place[:p] < at) & (at - place[:p] <= n + stray)
            j = int(np.where(fit, size[:p], 0).argmax()) if p else 0
            length = 1
            if p and fit[j]:
                before[i], length = int(last[j]), int(size[j]) + 1
                extended[before[i]] = True
            if length >= size[p] or at - place[p] > n + stray:
                size[p], last[p], place[p], diagonal[p] = length, i, at, d
        longest: dict[int, list[tuple[int, int]]] = {}
        for i in range(len(hits)):
            if not extended[i]:
                chain, j = [], i
                while j >= 0:
                    chain.append(hits[j])
                    first, j = j, before[j]
                if len(chain) > len(longest.get(first, ())):
                    longest[first] = chain[::-1]
        return list(longest.values())

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(template, first word, end, least and largest diagonal) of a band around chains of a template's hits."""
        hashes, places = self.fingerprints(ids)
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        hit = np.flatnonzero(self.known[at] == hashes) if len(self.known) else []
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in hit:
            for k, p in self.postings[int(hashes[i])]:
                by[k].append((int(places[i]), p))
        for k, hits in by.items():
            n, band = len(self.texts[k]), min(BAND, self.stray(k))
            for chain in self.chains(k, sorted(hits)):
                if len(chain) * (self.winnow + self.gram) >= n * COVERAGE / 3 or n <= 4 * self.gram:
                    (first, p), (last, q) = chain[0], chain[-1]
                    diagonals = [x - y for x, y in chain]
                    yield k, max(0, first - p - band), min(len(ids), last + n - q + band), min(diagonals) - band, max(diagonals) + band

    def align(self, k: int, ids: np.ndarray, lo: int, hi: int, least: int, most: int) -> tuple[int, int, int] | None:
        """Longest common subsequence of the template and words lo to hi - 1, on diagonals from ``least`` to ``most``:
        (matched words, first matched, last matched)."""
        template, part = self.texts[k], ids[lo:hi]
        n, m = len(template), len(part)
        best = np.zeros(m + 1, np.int64)
        came = np.zeros((n + 1, m + 1), np.int8)
        for i in range(1, n + 1):
            a, b = max(1, i + least - lo), min(m, i + most - lo)
            if a > b:
                continue
            same = part[a - 1 : b] == template[i - 1]
            diagonal = best[a - 1 : b] + same
            up = best[a : b + 1]
            row = np.maximum(diagonal, up)
            left = np.maximum.accumulate(np.concatenate(([best[a - 1]], row)))[1:]
            came[i, a : b + 1] = np.where(left > row, 2, np.where((diagonal > up) & same, 1, 0))
            best[a : b + 1] = left
        i, j = n, int(best.argmax())
        matched, places = int(best[j]), []
        while i and j:
            if came[i, j] == 1:
                places.append(j - 1)
                i, j = i - 1, j - 1
            elif came[i, j] == 2:
                j -= 1
            else:
                i -= 1
        if not places:
            return None
        return matched, lo + places[-1], lo + places[0]

    def matches(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(name, matched words, template's words, start, end) in order of start, then of name."""
        raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
        get = self.number.get
        ids = np.array([get(w, 0) for w in raw.split()], np.int64)
        found: dict[tuple[int, int, int], int] = {}
        for k, *where in self.candidates(ids):
            if (hit := self.align(k, ids, *where)) and hit[0] >= COVERAGE * len(self.texts[k]):
                found[k, hit[1], hit[2]] = max(hit[0], found.get((k, hit[1], hit[2]), 0))
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(raw)]
        raw_text, taken, out = text.encode("utf-8", "surrogatepass"), [], []
        better = lambda x: (len(self.texts[x[0][0]]) - 2 * x[1], x[0][1], self.names[x[0][0]])
        for (k, a, b), n in sorted(found.items(), key=better):
            if all(b < x or a > y for x, y in taken):
                taken.append((a, b))
                start, end = (len(raw_text[:at].decode("utf-8", "surrogatepass")) for at in (spans[a][0], spans[b][1]))
                out.append((self.names[k], n, len(self.texts[k]), start, end))
        return sorted(out, key=lambda x: (x[3], x[0], x[4]))


_OUT = "doc_id long, matches array<struct<license:string,matched:long,words:long,start:long,end:long>>"
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _scanner(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = workspace(("licenses", templates), lambda: Index(list(templates)))
        for batch in batches:
            rows = [[dict(zip(("license", "matched", "words", "start", "end"), m, strict=True)) for m in index.matches(t.as_py())] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, _MATCH)], names=["doc_id", "matches"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, matches: license, matched and template words, span."""
    return narrow(docs, id_col, text_col).mapInArrow(_scanner(tuple(templates or TEMPLATES)), _OUT)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch["matches"].to_pylist()
        best = [min(x, key=lambda m: (-m["matched"] / m["words"], -m["words"], m["start"], m["license"])) if x else None for x in rows]
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"],
            pa.array([len(x) for x in rows], pa.int64()),
            pa.array([b and b["license"] for b in best], pa.string()),
            pa.array([b["matched"] / b["words"] if b else 0.0 for b in best], pa.float64()),
            pa.array([",".join(f"{m['license']}:{m['start']}:{m['end']}:{m['matched']}/{m['words']}" for m in x) for x in rows], pa.string()),
        ], names=["doc_id", "n_matches", "best_license", "best_coverage", "matches"])


def summary(found: DataFrame) -> DataFrame:
    """One row a document: number of matches, the best one and its coverage, and all as name:start:end:matched/words."""
    return found.mapInArrow(_digest, "doc_id long, n_matches long, best_license string, best_coverage double, matches string")
