"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are grouped by length in words: class c holds those of up to 2 ** c words. For a class a text is cut into
blocks of 2 ** c words, and each two neighbouring blocks are a window, so that every occurrence of a template lies
in one. Bands are single MinHash values (rows = 1): a window whose containment of a template is at the threshold shares
at least ``CONTAINED * |T|`` of ``|T| + |W|`` shingles with it, so ``bands`` is set to where missing all of them has a
probability below ``MISS``. A window and a template that agree in any band are compared exactly: the share of
the template's word 3-grams that stand in the window.

Results (doc_id, license, containment), one row per document row and template found, with the best window's containment.

Defined cases: null and empty texts, and texts of fewer than 3 words, have no license; a null id stays null; repeated rows
are reported each; a text may match several templates, each with its best window; texts are scanned whole, at any length, window by window; templates need ``N``
words, shorter ones are refused; without templates there are no rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import kernel as K
from lexmill.llm.common import runs
from lexmill.llm.quality import member

N, CONTAINED, MISS = 3, 0.8, 1e-3

TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mit-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause-terms": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause-terms": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither
        the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
        A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
        IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
        IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
        for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
        may not be removed or altered from any source distribution.""",
    "unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial
        or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
        public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
        in perpetuity of all present and future rights to this software under copyright law.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
        version.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc0-notice": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide",
}


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's word 3-grams, as the scan makes them."""
    data = K.lower(np.frombuffer(text.encode(), np.uint8))
    tokens = K.Tokens(data, np.array([0, len(data)]), K.ALNUM)
    grams, _ = K.ngrams(K.Ranges(data).hash(tokens.start, tokens.end), tokens.first, N)
    return np.unique(grams)


def n_words(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return len(K.Tokens(data, np.array([0, len(data)]), K.ALNUM).start)


class Length:
    """The templates of one length class, their signatures and the bands that reach them."""

    def __init__(self, power: int, templates: list[tuple[str, np.ndarray]]):
        self.block = 1 << power
        self.templates = templates
        overlap = min(CONTAINED * len(s) / (2 * self.block + (1 - CONTAINED) * len(s)) for _, s in templates)
        self.bands = math.ceil(math.log(MISS) / math.log(1 - overlap))
        self.multipliers = K.odd_constants(self.bands, 41 + power)
        values = np.stack([np.array([(s * a).min() for a in self.multipliers]) for _, s in templates])  # templates x bands
        self.values = [np.unique(v) for v in values.T]
        self.owners = [{int(v): np.flatnonzero(col == v) for v in np.unique(col)} for col in values.T]

    def scan(self, grams: np.ndarray, begin: np.ndarray) -> dict[tuple[int, int], float]:
        """Best containment by (row, template) of those that reach the threshold."""
        size = np.diff(begin)
        if not len(grams):
            return {}
        row = np.repeat(np.arange(len(size)), size)
        number = (np.arange(len(grams)) - begin[:-1][row]) // self.block
        starts = runs(row * (int(number.max()) + 1) + number)
        first, last = starts[:-1], starts[1:]
        owner = row[first]
        follows = np.zeros(len(first), bool)
        follows[:-1] = owner[1:] == owner[:-1]
        hits: set[tuple[int, int]] = set()
        buffer = np.empty(len(grams), np.uint64)
        for a, values, owners in zip(self.multipliers, self.values, self.owners):
            np.multiply(grams, a, out=buffer)
            low = np.minimum.reduceat(buffer, first)
            low[:-1] = np.where(follows[:-1], np.minimum(low[:-1], low[1:]), low[:-1])
            for w in np.flatnonzero(member(low, values)).tolist():
                hits.update((w, int(t)) for t in owners[int(low[w])])
        best: dict[tuple[int, int], float] = {}
        for w, t in sorted(hits):
            window = grams[first[w] : last[w + 1] if follows[w] else last[w]]
            template = self.templates[t][1]
            share = float(member(template, np.unique(window)).sum() / len(template))
            if share >= CONTAINED:
                at = (int(owner[w]), t)
                best[at] = max(best.get(at, 0.0), share)
        return best


def classes(templates: dict[str, str] = TEMPLATES) -> list[Length]:
    by: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in sorted(templates.items()):
        if n_words(text) < N:
            raise ValueError(f"template {name} has fewer than {N} words")
        by.setdefault(max(3, (n_words(text) - 1).bit_length()), []).append((name, shingles(text)))
    return [Length(power, found) for power, found in sorted(by.items())]


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """See the module's docstring."""
    lengths = classes(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, str, float]] = []
            for i, _, data, offsets in K.texts(batch.column("text")):
                small = K.lower(data)
                tokens = K.Tokens(small, offsets, K.ALNUM)
                grams, begin = K.ngrams(K.Ranges(small).hash(tokens.start, tokens.end), tokens.first, N)
                for length in lengths:
                    rows += [(i + r, length.templates[t][0], round(share, 6)) for (r, t), share in length.scan(grams, begin).items()]
            cols = list(zip(*rows)) if rows else [[]] * 3
            ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["doc_id", "license", "containment"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, license string, containment double")
