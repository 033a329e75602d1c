"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased, so that comment marks and
punctuation do not matter; shingles are five words. Templates are classed by their number of shingles, each class up to
a power of two, and a text is looked at through windows of one and a half times that size (rounded down), at steps
of a quarter. For each class the number of bands of two minima is the least at which a window that
holds ``PERCENT`` of a template's shingles shares a band with it but for a chance of ``MISS``; the windows overlap, so an
occurrence has several. A document and a template that share a band are compared exactly over all of its windows.
Minima are only taken of stretches that hold a shingle of some template: where there is none, no band of a window is a
template's but by a collision of hashes, which the comparison would turn down.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _text

WORDS, PERCENT, ROWS = 5, 80, 2
MISS = 1e-4
#: Templates are indexed in blocks of so many; a pass over the texts takes so many blocks, so what a task holds is bounded.
TEMPLATES_AT_ONCE, BLOCKS_AT_ONCE = 1024, 8
#: Bytes of a library of templates that is read from a table.
LIBRARY_BYTES = 256 << 20
STRIP = 2048
_FILTER_BITS = 20
_U32, _U64 = np.uint32, np.uint64

# Public licence notices, the opening or characteristic paragraphs of common licences, and short licences whole.
TEMPLATES = {
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0bsd-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib-whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-whole": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "unlicense-whole": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

#: Bytes that part words here: ASCII but letters and digits.
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds of each row's) of the five-word shingles, in order; a row of fewer words is one shingle."""
    hashes, rows, _, _ = _text.words(data, offsets, _GAP)
    found, at = _text.shingles(hashes, rows, len(offsets) - 1, WORDS)
    return found, _text.row_bounds(at, len(offsets) - 1)


@dataclass(frozen=True)
class SizeClass:
    """Templates of up to ``most`` shingles: windows of ``width`` shingles every ``step``, compared by ``bands``."""

    most: int
    step: int
    width: int
    bands: int


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def size_classes(sizes: list[int], percent: int = PERCENT, miss: float = MISS) -> dict[int, SizeClass]:
    """The class of each template size, with the bands that its least similar match calls for."""
    groups: dict[int, list[int]] = {}
    for n in sizes:
        groups.setdefault(1 << (n - 1).bit_length(), []).append(n)
    out = {}
    for most, own in groups.items():
        step = max(1, most // 4)
        width = most + most // 2
        least = min(needed(n, percent) / (width + n - needed(n, percent)) for n in own)
        bands = 1 if least == 1 else math.ceil(math.log(miss) / math.log(1 - least**ROWS))
        out |= dict.fromkeys(own, SizeClass(most, step, width, bands))
    return out


class Index:
    """The templates' band keys and shingle sets, small enough for every task."""

    def __init__(self, templates: list[tuple[str, str]], percent: int = PERCENT, miss: float = MISS):
        self.percent, self.names, self.sets = percent, [], []
        for name, text in templates:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            found, _ = _shingles(raw, np.array([0, len(raw)]))
            if len(found):
                self.names.append(name)
                self.sets.append(np.unique(found))
        classes = size_classes([len(s) for s in self.sets], percent, miss)
        self.classes = sorted({c.most: c for c in classes.values()}.values(), key=lambda c: c.most)
        self.own = [classes[len(s)] for s in self.sets]
        hashes = ROWS * max((c.bands for c in self.classes), default=0)
        random = np.random.Generator(np.random.PCG64(909))
        self.a = random.integers(0, 2**31, hashes, dtype=np.uint32) * _U32(2) + _U32(1)
        self.b = random.integers(0, 2**32, hashes, dtype=np.uint32)
        self.mix = random.integers(0, 2**31, hashes, dtype=np.uint32) * _U32(2) + _U32(1)
        self.keys, self.owners, self.filters = {}, {}, {}
        for c in self.classes:
            at = [t for t, o in enumerate(self.own) if o.most == c.most]
            keys = np.concatenate([self.band_keys(self.hashed(self.sets[t]).min(axis=0, keepdims=True), c)[0] for t in at])
            owners = np.repeat(at, c.bands)
            order = np.argsort(keys, kind="stable")
            self.keys[c.most], self.owners[c.most] = keys[order], owners[order]
            self.filters[c.most] = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self.filters[c.most][keys >> _U32(32 - _FILTER_BITS)] = True
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, _U64)
        self.known = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.known[self.all >> _U64(64 - _FILTER_BITS)] = True

    def held(self, shingles: np.ndarray) -> np.ndarray:
        """Where the shingles are those of a template."""
        at = np.flatnonzero(self.known[shingles >> _U64(64 - _FILTER_BITS)])
        return at[self.all[np.minimum(np.searchsorted(self.all, shingles[at]), len(self.all) - 1)] == shingles[at]]

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        """A row of hashes for each shingle."""
        return (shingles >> _U64(32)).astype(np.uint32)[:, None] * self.a + self.b

    def band_keys(self, minima: np.ndarray, c: SizeClass) -> np.ndarray:
        part = minima[:, : ROWS * c.bands] * self.mix[: ROWS * c.bands]
        keys = part[:, 0::ROWS].copy()
        for r in range(1, ROWS):
            keys ^= part[:, r::ROWS] >> _U32(7 * r)
        return (keys ^ (keys >> _U32(15))) * _U32(0x2C1B3C6D)

    def candidates(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first shingle of a window, template) wherever a window of ``shingles`` shares a band with a template."""
        at, found = [], []
        last = self.classes[-1].width if self.classes else 0
        strip = max(STRIP, self.classes[-1].step) if self.classes else STRIP
        held = self.held(shingles)
        for a in range(0, len(shingles), strip):
            if np.searchsorted(held, a) == np.searchsorted(held, a + strip + last):
                continue
            minima, step = self.hashed(shingles[a : a + strip + last]), 1
            for c in self.classes:
                while step < c.step:
                    minima = _joined(minima, 1)[::2]
                    step *= 2
                windows = _windows(minima, c.width // step, strip // step)
                keys = self.band_keys(windows, c)
                hit = np.flatnonzero(self.filters[c.most][keys.ravel() >> _U32(32 - _FILTER_BITS)])
                key, window = keys.ravel()[hit], hit // c.bands
                low, high = (np.searchsorted(self.keys[c.most], key, side=s) for s in ("left", "right"))
                n = high - low
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                at.append(a + np.repeat(window, n) * step)
                found.append(self.owners[c.most][place])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def verified(self, shingles: np.ndarray, template: int) -> tuple[int, int, int, int] | None:
        """(most shingles of the template in a window, first such window, matching windows, the last), if enough."""
        own, c = self.sets[template], self.own[template]
        spot = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        where = np.flatnonzero(own[spot] == shingles)
        first = np.maximum(0, -((c.width - 1 - where) // c.step))
        n = where // c.step - first + 1
        window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        each = np.unique(window * len(own) + np.repeat(spot[where], n))
        windows, shared = np.unique(each // len(own), return_counts=True)
        ok = shared >= needed(len(own), self.percent)
        if not ok.any():
            return None
        best = int(shared.argmax())
        return int(shared[best]), int(windows[best]) * c.step, int(ok.sum()), int(windows[ok][-1]) * c.step


def _joined(minima: np.ndarray, gap: int) -> np.ndarray:
    """Minima of each row and the one ``gap`` on; the last rows stand alone."""
    out = minima.copy()
    np.minimum(minima[: len(minima) - gap], minima[gap:], out=out[: len(minima) - gap])
    return out


def _windows(minima: np.ndarray, n: int, most: int) -> np.ndarray:
    """Minima of ``n`` rows from each of the first ``most`` on."""
    out, size = minima, 1
    while 2 * size <= n:
        out = _joined(out, size)
        size *= 2
    return (_joined(out, n - size) if size < n and len(out) > n - size else out)[:most]


_MATCH = "doc_id long, license string, shared long, n_shingles long, containment double, windows long, first_word long, last_word long"


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` and template that one of its windows holds: doc_id, license, shared, n_shingles,
    containment, windows, first_word, last_word.

    ``shared`` of the template's ``n_shingles`` distinct shingles, ``percent`` of them or more, lie in the window that
    holds most, the first such if several; ``first_word`` is where that window begins and ``last_word`` where the last
    matching one does, in words; ``windows`` counts those that match. Any number of templates is searched for, in
    blocks of ``TEMPLATES_AT_ONCE``, of which a pass over the texts takes ``BLOCKS_AT_ONCE``.

    Defined cases: a null or empty text, or one without words, holds nothing; a text or template of fewer than five
    words is one shingle of them all; templates without words match nothing; rows of one doc_id, or without one, are
    scanned each; an empty table gives no rows; other columns do not matter; whole texts are scanned, in strips.
    """
    templates = list(TEMPLATES.items()) if templates is None else templates
    blocks = [templates[a : a + TEMPLATES_AT_ONCE] for a in range(0, max(1, len(templates)), TEMPLATES_AT_ONCE)]
    passes = [_scan(docs, blocks[a : a + BLOCKS_AT_ONCE], percent) for a in range(0, len(blocks), BLOCKS_AT_ONCE)]
    return functools.reduce(DataFrame.unionByName, passes)


def _scan(docs: DataFrame, blocks: list[list[tuple[str, str]]], percent: int) -> DataFrame:
    indexes = [Index(block, percent) for block in blocks]
    grain = max((c.step for index in indexes for c in index.classes), default=1)

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for first, end, data, offsets in _text.chunks(batch.column("text")):
                found, bounds = _shingles(data, offsets)
                # rows that hold a shingle of a template start at multiples of the longest step; what fills the gaps is the row's last shingle again
                some = np.unique(np.concatenate([np.searchsorted(bounds, index.held(found), side="right") - 1 for index in indexes]))
                if not len(some):
                    continue
                size = np.diff(bounds)[some]
                places = np.append(0, np.cumsum(-(-size // grain) * grain))
                row = np.repeat(np.arange(len(some)), np.diff(places))
                spread = found[np.minimum(bounds[some][row] + np.arange(places[-1]) - places[row], bounds[some + 1][row] - 1)]
                for index in indexes:
                    at, template = index.candidates(spread)
                    row = some[np.searchsorted(places, at, side="right") - 1]
                    # a window may begin in a row's last step and reach into the next rows: those begin windows of their own
                    for r, t in np.unique(np.stack((row, template), axis=1), axis=0).tolist():
                        match = index.verified(found[bounds[r] : bounds[r + 1]], t)
                        if match:
                            n = len(index.sets[t])
                            rows.append((ids[first + r], index.names[t], match[0], n, match[0] / n, match[2], match[1], match[3]))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _MATCH.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _MATCH)


def templates_from(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """A library of templates from a Parquet table (license, text), null texts left out; an error above ``LIBRARY_BYTES``."""
    rows = spark.read.parquet(path).filter("text IS NOT NULL").select("license", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > LIBRARY_BYTES:
        raise ValueError(f"the library has {size} bytes of text, more than {LIBRARY_BYTES}")
    return [tuple(r) for r in rows.orderBy("license", "text").collect()]


def oracle_sql() -> str:
    """The matches of :data:`TEMPLATES` by joining shingles, without minima."""
    index = Index(list(TEMPLATES.items()))
    rows = ", ".join("('{}', '{}', {}, {})".format(n, TEMPLATES[n].replace("'", "''"), c.step, c.width) for n, c in zip(index.names, index.own, strict=True))
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shingled = "SELECT {0}, unnest(range(greatest(1, len(w) - 4))) AS p, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) AS s FROM {1} WHERE len(w) > 0"
    return f"""
WITH l(license, text, step, width) AS (VALUES {rows}),
t AS (SELECT DISTINCT license, step, width, s FROM ({shingled.format("license, step, width", f"(SELECT *, regexp_extract_all({lower.format('text')}, {word}) AS w FROM l)")})),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS ({shingled.format("doc_id", f"(SELECT doc_id, regexp_extract_all({lower.format('text')}, {word}) AS w FROM documents)")}),
h AS (SELECT doc_id, license, step, p, t.s, unnest(range(greatest(0, ((p - width + 1 + step - 1) // step)::BIGINT), (p // step + 1)::BIGINT)) AS k FROM d JOIN t ON d.s = t.s),
c AS (SELECT doc_id, license, k * step AS k, count(DISTINCT s) AS shared FROM h GROUP BY doc_id, license, step, k),
m AS (SELECT c.*, n FROM c JOIN n USING (license) WHERE 100 * shared >= {PERCENT} * n)
SELECT doc_id, license, max(shared)::BIGINT AS shared, any_value(n)::BIGINT AS n_shingles, max(shared)::DOUBLE / any_value(n) AS containment, count(*)::BIGINT AS windows,
  min_by(k, (-shared, k))::BIGINT AS first_word, max(k)::BIGINT AS last_word
FROM m GROUP BY doc_id, license
"""
