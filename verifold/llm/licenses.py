"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Hashes of ``gram`` consecutive words are winnowed: of each run of ``window`` hashes the least one
is kept, so any ``gram + window - 1`` words of a template hold a fingerprint. The templates'
fingerprints are the inverted index, in which all hashes of a text are looked up. Where a text meets it, the places agree on a diagonal; there
the template is aligned with the text inside a band, and the matched share of its words and the
span in the text are reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verifold.llm.words import hashes_of, window_hashes

#: Notices and headers of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Whole texts of the short licenses, without their copyright lines.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "MIT-text": f"{TEMPLATES['MIT-permission']} {_WARRANTY}",
    "BSD-2-Clause-text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause-text": f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense-text": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')} For more information, please refer to <https://unlicense.org>",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Bytes of templates that one pass holds in each task; more templates take more passes.
PASS_BYTES = 16 << 20
SCHEMA = "doc_id long, template string, coverage double, n_matched int, n_template int, span_start long, span_end long"


def words_and_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-case words of letters and digits, and where they stand (code points)."""
    found = [(m[0].lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost least hash of each run of ``window`` hashes."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(runs)) + window - 1 - np.argmin(runs[:, ::-1], axis=1))


def align(template: list[str], words: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """Most template words matched in order with words near the diagonal; (matched, first, end) in words.

    Template word i may match words[j] for j - i within ``band`` of ``shift``. Of alignments with
    equally many matches the shortest stretch of words is taken.
    """
    width = 2 * band + 1
    best = [(0, 0, -1, -1)] * (width + 1)  # matches, -stretch, first, last
    score = lambda x: (x[0], x[2] - x[3])
    for i, w in enumerate(template):
        row: list = []
        left = (0, 0, -1, -1)
        for k in range(width):
            j = i + shift - band + k
            up = best[k + 1] if k + 1 < width else (0, 0, -1, -1)  # template word left out
            here = max(left, up, best[k], key=score)  # or text word left out, or both
            if 0 <= j < len(words) and words[j] == w:
                p = best[k]
                here = max(here, (p[0] + 1, 0, p[2] if p[0] else j, j), key=score)
            row.append(here)
            left = here
        best = [*row, (0, 0, -1, -1)]
    n, _, first, last = max(best[:width], key=score)
    return n, first, last + 1


class _Index:
    """Inverted index of some templates: fingerprint -> (template, place)."""

    def __init__(self, templates: list[tuple[str, str]], gram: int, window: int):
        self.words = {name: words_and_spans(text)[0] for name, text in templates}
        self.places = defaultdict(list)
        for name, words in self.words.items():
            h = window_hashes(hashes_of(pa.array(words, pa.string())), gram)
            for p in winnow(h, window).tolist():
                self.places[int(h[p])].append((name, p))
        self.keys = np.array(sorted(self.places), dtype=np.uint64)


def most_matches(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> int:
    """No fewer than ``align`` matches: template words that occur anywhere in their band."""
    at = np.arange(len(template))[:, None] + np.arange(shift - band, shift + band + 1)
    inside = (at >= 0) & (at < len(words))
    return int(((words[np.where(inside, at, 0)] == template[:, None]) & inside).any(axis=1).sum()) if len(words) else 0


def _matches(text: str, hashes: np.ndarray, index: _Index, found: np.ndarray, least: float, band: int) -> list[tuple]:
    """Reports of one text: the best alignment of each template and stretch of text, over every shift that they share."""
    words, spans = words_and_spans(text)
    shifts = defaultdict(set)
    for p in found.tolist():
        for name, at in index.places[int(hashes[p])]:
            shifts[name].add(p - at)
    out = []
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    for name, all_shifts in shifts.items():
        template = index.words[name]
        coded = np.array([known.get(w, -1) for w in template])
        hits = []
        for s in sorted(all_shifts):
            if most_matches(coded, ids, s, band) < least * len(template):
                continue  # no alignment on this diagonal can reach the share
            n, a, b = align(template, words, s, band)
            if n >= least * len(template):
                hits.append((-n, b - a, a, b))
        taken: list[tuple[int, int]] = []
        for n, _, a, b in sorted(hits):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((name, -n / len(template), -n, len(template), spans[a][0], spans[b - 1][1]))
    return out


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, gram: int = 3, window: int = 2, coverage: float = 0.8, band: int = 8) -> DataFrame:
    """Templates found in each whole text: doc_id, template, coverage, n_matched, n_template, span_start, span_end.

    docs: doc_id, text; templates: template (name), text (default TEMPLATES); other columns are
    ignored. Words are runs of letters and digits in lower case. A report needs ``coverage`` of the
    template's words matched in order within ``band`` words of the diagonal of a shared
    fingerprint; spans are code points, end exclusive, and do not overlap for one template. Null,
    empty and non-matching texts give no row; templates of fewer than ``gram`` words match nothing; repeated rows
    report as often. Templates are read in passes of PASS_BYTES, so any number of them works.
    """
    spark = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string")
    templates = templates.where("template is not null").select(F.col("template").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    total = templates.agg(F.sum(F.octet_length("text") + F.octet_length("template") + 16)).first()[0] or 0
    passes = -(-total // PASS_BYTES) or 1
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    reports = None
    for k in range(passes):
        mine = [tuple(r) for r in templates.where(F.pmod(F.xxhash64("template", "text"), F.lit(passes)) == k).orderBy("template", "text").collect()]  # about PASS_BYTES
        part = rows.mapInArrow(_scanner(mine, gram, window, coverage, band), SCHEMA)
        reports = part if reports is None else reports.unionByName(part)
    return reports


def _scanner(templates: list[tuple[str, str]], gram: int, window: int, coverage: float, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates, gram, window)
        columns = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for i, reports in _scan(part.column("text"), index, gram, coverage, band):
                    doc = part.column("doc_id")[i].as_py()
                    out += [(doc, *r) for r in reports]
                cols = list(zip(*out, strict=True)) or [()] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=columns)

    return run


def _scan(texts: pa.Array, index: _Index, gram: int, coverage: float, band: int):
    """(row, reports) of the texts that meet the index."""

    # Words of all texts at once: other characters become spaces, as in words_and_spans.
    plain = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[^\p{L}\p{N}]+", " "))
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(full)])[starts]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    hashed = hashes_of(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    grams = window_hashes(hashed, gram)
    if not len(grams) or not len(index.keys):
        return
    met = np.flatnonzero(index.keys[np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)] == grams)
    rows = np.searchsorted(starts, met, side="right") - 1
    met = met[met + gram <= starts[rows + 1]]
    rows = np.searchsorted(starts, met, side="right") - 1
    for i in np.unique(rows).tolist():
        a, b = int(starts[i]), int(starts[i + 1])
        yield i, _matches(texts[i].as_py(), grams[a : b - gram + 1], index, met[rows == i] - a, coverage, band)
