"""License scans by winnowed fingerprints and banded alignment.

Templates and documents are read as words of ASCII letters, digits and bytes above 127,
in lower case.  Fingerprints are hashes of ``K`` words, winnowed over ``W`` positions:
any common run of ``K + W - 1`` words has a common fingerprint.  The inverted index of
the templates is a few hundred entries and goes to every task.  A document's hits vote
for (template, diagonal); each candidate is aligned word by word inside a band around
its diagonal, and what matches is reported with its coverage and character span.  A band
is searched until no match is left in it, so notices that stand side by side are each found.
"""

from __future__ import annotations

import heapq
import math
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .common import only
from .textcore import blocks

K = 3
W = 3
BAND = 8
LEAST_COVERAGE = 0.8

# Public license statements, the notices their authors ask to be used, and short licenses in full.
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT '
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU_END = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
)
TEMPLATES: dict[str, str] = {
    "All-rights-reserved": "All rights reserved.",
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
    "version. This program " + _GNU_END + "General Public License for more details. You should have received a copy of the GNU General "
    "Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, "
    "Boston, MA 02110-1301 USA.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version. This program " + _GNU_END + "General Public License for more details. You should have received a copy of the GNU General "
    "Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
    "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
    "later version. This library " + _GNU_END + "Lesser General Public License for more details. You should have received a copy of the "
    "GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin "
    "Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program " + _GNU_END + "Affero General Public License for more details. You should have received a copy of the "
    "GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
    "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
    "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    'provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE '
    "AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
    "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. " + _BSD_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
    "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
    "removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
    'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit '
    "the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
    "so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license "
    "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
    "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    'generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO "
    "EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate "
    "any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at "
    "large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
    "perpetuity of all present and future rights to this software under copyright law.",
}

#: Long licenses in full, a file each.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "texts")
for _file in sorted(os.listdir(TEXTS)):
    with open(os.path.join(TEXTS, _file), encoding="utf-8") as _f:
        TEMPLATES[_file.removesuffix(".txt") + "-text"] = _f.read()

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
GAPS = ~_WORD_BYTES


def winnow(hashes: np.ndarray, w: int = W) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window of ``w``."""
    n = len(hashes)
    if n <= w:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, w)[:, ::-1]
    return np.unique(np.arange(n - w + 1) + w - 1 - views.argmin(axis=1))


def index(templates: dict[str, str]):
    """(sorted fingerprints, template of each, word position of each, word hashes of each template)."""
    prints, owner, place, words = [], [], [], []
    for i, text in enumerate(templates.values()):
        b = next(iter(blocks(pa.array([text]), lower=True, gaps=GAPS)))
        words.append(b.hashes)
        h, _ = b.windows(min(K, len(b.hashes)))
        for p in winnow(h):
            prints.append(h[p])
            owner.append(i)
            place.append(p)
    order = np.argsort(np.array(prints, np.uint64), kind="stable")
    return np.array(prints, np.uint64)[order], np.array(owner)[order], np.array(place)[order], words


def align(template: np.ndarray, words: np.ndarray, diagonals: np.ndarray, band: int = BAND, free: np.ndarray | None = None, least: int = 1):
    """For each diagonal (matched template words, first word, last word) of the best local alignment within its band, as three arrays.

    Match +2, substitution and gap -1; row by row of the template, words i + diagonal +- band,
    all diagonals at once.  Only words flagged in ``free`` are aligned, so no alignment lies
    over another word, and only alignments that match ``least`` template words count;
    (0, -1, -1) where there is none.  Of equal scores more matches win, then a later start.
    A cell is one number: score, matches and start in 14, 13 and 34 bits.
    """
    diagonals = np.atleast_1d(np.asarray(diagonals, np.int64))
    width = 2 * band + 1
    reach = np.arange(width) - band
    point, match, starts = np.int64(1) << 47, np.int64(1) << 34, (np.int64(1) << 34) - 1
    cells = np.zeros((len(diagonals), width), np.int64)
    best = np.zeros((3, len(diagonals)), np.int64)
    best[1:] = -1
    top = np.zeros(len(diagonals), np.int64)
    every = np.arange(len(diagonals))
    free = np.ones(len(words), bool) if free is None else free
    for i in range(len(template)):
        at = diagonals[:, None] + (i + reach)
        inside = (at >= 0) & (at < len(words))
        near = np.clip(at, 0, max(len(words) - 1, 0))
        inside &= free[near]
        same = inside & (words[near] == template[i])
        lost = np.where(cells >= 2 * point, cells - point, 0)
        new = np.where(same, np.where(cells >= point, cells, at) + 2 * point + match, lost)
        new[:, :-1] = np.maximum(new[:, :-1], lost[:, 1:])  # a template word is missing
        new = np.where(inside, new, 0)
        if new.any():
            step = 1
            whole = inside[:, 1:] & inside[:, :-1]  # cells step apart with all between them inside
            while step < width and whole.any():  # words are inserted
                moved = np.where(whole & (new[:, :-step] >= (step + 1) * point), new[:, :-step] - step * point, 0)
                new[:, step:] = np.maximum(new[:, step:], moved)
                if 2 * step >= width:
                    break
                whole = whole[:, step:] & whole[:, :-step]
                step *= 2
            counts = np.where(same & ((new >> 34) % 8192 >= least), new >> 47, 0)
            j = counts.argmax(axis=1)
            better = np.flatnonzero(counts[every, j] > top)
            if len(better):
                cell = new[better, j[better]]
                top[better] = cell >> 47
                best[:, better] = (cell >> 34) % 8192, cell & starts, at[better, j[better]]
        cells = new
    return best


def votes_needed(template: np.ndarray, least: float) -> int:
    """Fingerprints of a template that a text must share near one diagonal to be aligned.

    A share ``1 - least`` of other words spoils ``K`` times that share of the word runs at
    most; half of the fingerprints of the runs that are left are asked for.
    """
    prints = len(template) * 2 // (W + 1)
    return max(1, int(prints * (1 - K * (1 - least)) / 2))


#: Cells of bands that are aligned side by side.
CELLS = 1 << 15


def bands(votes: dict[int, int], length: int, needed: int) -> dict[int, list[int]]:
    """{half width: [middle diagonals]} to align a template of ``length`` words in, from its votes by bucket of BAND diagonals (ascending).

    Windows of diagonals, each over twice the reach of an alignment and half over the one before, hold
    the votes of any match.  A window with ``needed`` votes is a band of its own, unless nearly all of its votes
    lie in neighbouring buckets: then the buckets with enough votes are narrow bands.  Buckets that have, with
    their neighbours, less than a sixteenth of the votes needed (a phrase that a long template repeats) do
    not widen a band.
    """
    buckets = np.fromiter(votes, np.int64, len(votes))
    counts = np.fromiter(votes.values(), np.int64, len(votes))
    around = lambda at, s: s[np.searchsorted(buckets, at + 2)] - s[np.searchsorted(buckets, at - 1)]
    kept = around(buckets, np.concatenate([[0], np.cumsum(counts)])) >= max(1, needed // 16)
    buckets, counts = buckets[kept], counts[kept]
    if not len(buckets):
        return {}
    sums = np.concatenate([[0], np.cumsum(counts)])
    step = -(-2 * length // BAND)
    few = max(1, length // 100)
    out: dict[int, list[int]] = defaultdict(list)
    near: set[int] = set()
    first, last = int(buckets[0]) // step - 1, int(buckets[-1]) // step
    lows = np.unique(np.concatenate([buckets // step - 1, buckets // step])) * step if last - first > 1 else np.array([buckets[0]])
    for low in lows.tolist():
        i, j = np.searchsorted(buckets, [low, low + 2 * step])
        total = int(sums[j] - sums[i])
        if total < needed:
            continue
        at = buckets[i:j]
        threes = around(at, sums)
        if threes.max() >= needed and total - int(np.minimum(threes.max(), total)) < few:
            near.update(at[threes >= needed].tolist())
        else:
            reach = (int(at[-1]) - int(at[0]) + 1) * BAND
            middle = int(at[0]) * BAND + reach // 2
            half = -(-(reach // 2 + BAND) // (4 * BAND)) * 4 * BAND  # a few widths, so that bands are aligned together
            if middle not in out[half]:
                out[half].append(middle)
    if near:
        out[BAND + BAND // 2] += [b * BAND + BAND // 2 for b in sorted(near)]
    return out


COLUMNS = "doc_id long, template string, matched_words long, coverage double, span_start long, span_end long"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row a match: doc_id, template, matched_words, coverage, span_start, span_end.

    Spans are code points of the whole text, end exclusive.  Of matches that overlap, the
    one with more matched words stays (then the higher coverage, then the template listed
    first); the words left are searched again, so a template may match many times.  A license
    with words inserted is one match, as long as fewer are inserted than twice the words matched before them.  Null
    and empty texts match nothing; repeated rows are scanned each; a null id stays null.
    """
    templates = TEMPLATES if templates is None else templates
    prints, owner, place, words = index(templates)
    names = list(templates)
    needed = [votes_needed(w, least) for w in words]

    def scan_one(block, i: int):
        a, b = int(block.bounds[i]), int(block.bounds[i + 1])
        own = block.hashes[a:b]
        if len(own) < K:
            return
        at = np.arange(len(own) - K + 1)
        hashes = textcore.Ranges(textcore.mix(own)).hash(at, at + K)
        chosen = winnow(hashes)
        chosen = chosen[np.isin(hashes[chosen], prints)]
        votes: dict = defaultdict(int)
        for p in chosen:
            lo, hi = np.searchsorted(prints, hashes[p], side="left"), np.searchsorted(prints, hashes[p], side="right")
            for e in range(lo, hi):
                votes[int(owner[e]), int(p - place[e]) // BAND] += 1
        free = np.ones(len(own), bool)
        found: list[tuple] = []

        def look(t, band, centers):
            at_once = max(1, CELLS // (2 * band + 1))
            for low in range(0, len(centers), at_once):
                part = [d for d in centers[low : low + at_once] if free[max(0, d - band) : max(0, d + band + len(words[t]))].sum() >= least * len(words[t])]
                if not part:
                    continue
                best = align(words[t], own, np.array(part), band, free, math.ceil(least * len(words[t])))
                for d, matched, first, last in zip(part, *best.tolist(), strict=True):
                    if matched:
                        heapq.heappush(found, (-matched, -matched / len(words[t]), t, first, last, band, d))

        by_template: dict = defaultdict(dict)
        for (t, bucket), n in sorted(votes.items()):
            by_template[t][bucket] = n
        for t, own_votes in by_template.items():
            for band, centers in bands(own_votes, len(words[t]), needed[t]).items():
                look(t, band, centers)
        # A band may hold several matches: after each that is taken, the bands over it are aligned again without its words.
        while found:
            m, c, t, first, last, band, d = heapq.heappop(found)
            if free[first : last + 1].all():
                free[first : last + 1] = False
                yield names[t], -m, -c, int(block.starts[a + first]), int(block.ends[a + last])
            look(t, band, [d])

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for block in blocks(batch.column(1), lower=True, gaps=GAPS):
                if len(block.hashes) < K:
                    continue
                hashes, at = block.windows(K)
                hit = np.unique(np.searchsorted(block.bounds, at[np.isin(hashes, prints)], side="right") - 1)
                for i in hit:
                    begin = int(block.offsets[i])
                    raw = block.buf[begin : int(block.offsets[i + 1])].tobytes()
                    for name, matched, coverage, s, e in scan_one(block, int(i)):
                        start = len(raw[: s - begin].decode())
                        rows.append((ids[block.first + i], name, matched, coverage, start, start + len(raw[s - begin : e - begin].decode())))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")]
            )

    return only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, COLUMNS)
