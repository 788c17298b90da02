"""License scan: winnowed fingerprints pick candidates, banded alignment reports them.

Templates are cut into k-grams of words; of every window of k-gram hashes the
least is a fingerprint (winnowing), and an inverted index leads from it to its
places in templates. All k-grams of a text are looked up, so that a shared run of
window + k - 1 words or more always meets a fingerprint. A short template has
smaller k-grams and all of them in the index, so that whatever covers min_coverage
of its words in a row has a hit. Each hit is a diagonal; diagonals are dealt
into cells as wide as the band, and each cell that has a hit is a candidate,
aligned with the template in the cell and a band on either side: a fixed width,
however many hits there are. What is found is taken out, and the cells
around are aligned again, until nothing that is left reaches min_coverage: every
occurrence is reported. The templates are an argument of bounded size; documents
stay in their partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Public license notices and lines (name, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-Rights-Reserved", "All rights reserved."),
)

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PRIME = np.uint64(0x100000001B3)


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def kgram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word numbers."""
    h = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for o in range(k):
        h = (h ^ (ids[o : o + len(h)].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * _PRIME
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: in each window the least hash, the last of equals."""
    if not len(h):
        return np.zeros(0, np.int64)
    window = min(window, len(h))
    views = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    ends = len(h) - 1 - np.arange(len(views))
    return np.unique(ends - views.argmin(axis=1))


def gram_size(words: int, k: int, min_coverage: float) -> tuple[int, bool]:
    """The k-gram size for a template of so many words, and whether all its k-grams are in the index.

    Where misses leave a run of fewer than k words for certain, the run that is
    certain is the size, and all k-grams count: misses cut what is
    matched into at most one more part than there are misses.
    """
    misses = words - math.ceil(min_coverage * words - 1e-9)
    certain = math.ceil((words - misses) / (misses + 1))
    return (max(1, min(k, certain)), True) if words < 4 * k else (k, False)


class Index:
    """Templates, their words' numbers and their fingerprints' places."""

    def __init__(self, templates, k: int, window: int, min_coverage: float = 0.8):
        self.names = [name for name, _ in templates]
        words = [_words(t.encode()) for _, t in templates]
        self.numbers = {w: i for i, w in enumerate(sorted({w for t in words for w in t}))}
        self.texts = [np.array([self.numbers[w] for w in t], np.int64) for t in words]
        rows = []
        for t, ids in enumerate(self.texts):
            own, every = gram_size(len(ids), k, min_coverage)
            h = kgram_hashes(ids, own)
            rows += [(own, int(h[p]), t, int(p)) for p in (range(len(h)) if every else winnow(h, window))]
        self.sizes = sorted({r[0] for r in rows})
        self.places: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for own, h, t, p in rows:
            self.places.setdefault((own, h), []).append((t, p))
        self.hashes = {own: np.array(sorted({h for o, h in self.places if o == own}), np.uint64) for own in self.sizes}

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Template to (place in the text, place in the template) of shared fingerprints."""
        known = ids >= 0
        out: dict[int, list[tuple[int, int]]] = {}
        for own in self.sizes:
            if len(ids) < own:
                continue
            full = np.flatnonzero(np.convolve(known, np.ones(own, int), "valid") == own)
            if not len(full):
                continue
            h = kgram_hashes(ids, own)
            # Every k-gram is looked up: a long template has at least one fingerprint in any window + k - 1 of its words.
            for p in full[np.isin(h[full], self.hashes[own])].tolist():
                for t, q in self.places[own, int(h[p])]:
                    out.setdefault(t, []).append((p, q))
        return out


def banded(text: np.ndarray, template: np.ndarray, lo: int, width: int) -> list[tuple[int, int]]:
    """Aligned places (i, j) of the longest common subsequence within the diagonals i - j of [lo, lo + width); of equals the one that ends first."""
    n, m = len(text), len(template)
    best = np.zeros((m + 1, width + 2), np.int32)  # best[j, d + 1]: template[:j] against text[: j + lo + d]
    padded = np.full(n + m + 2 * width + abs(lo) + 2, -2, np.int64)
    off = width + abs(lo) + 1
    padded[off : off + n] = text
    best[:, 0] = 0
    for j in range(1, m + 1):
        at = off + j - 1 + lo
        row = np.maximum(best[j - 1, 2:], best[j - 1, 1:-1] + (padded[at : at + width] == template[j - 1]))
        inside = (np.arange(width) + j + lo >= 0) & (np.arange(width) + j + lo <= n)
        best[j, 1:-1] = np.maximum.accumulate(np.where(inside, row, 0))
    out, j = [], m
    ends = [d for d in range(width) if 0 <= m + lo + d <= n]
    if not ends:
        return out
    d = max(ends, key=lambda d: (best[m, d + 1], -d))
    while j and 0 <= d < width and best[j, d + 1]:
        i = j + lo + d
        if 1 <= i <= n and text[i - 1] == template[j - 1] and best[j, d + 1] == best[j - 1, d + 1] + 1:
            out.append((i - 1, j - 1))
            j -= 1
        elif d and best[j, d + 1] == best[j, d]:
            d -= 1
        else:
            j, d = j - 1, d + 1
    return out[::-1]


def matches_in(index: Index, ids: np.ndarray, min_coverage: float, band: int) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, first word, end word, words aligned) of a text; of matches that overlap the one that covers most stays.

    Rounds: all cells with hits are aligned, of overlapping finds the best is
    taken and its words are blotted out; the cells of finds that gave way are aligned again.
    """
    ids, kept = ids.copy(), []
    todo = {(t, (p - q) // band) for t, hits in index.hits(ids).items() for p, q in hits}
    while todo:
        found = []
        for t, cell in sorted(todo):
            template = index.texts[t]
            lo = (cell - 1) * band
            start, end = max(0, lo), min(len(ids), lo + 3 * band + len(template))
            pairs = banded(ids[start:end], template, lo - start, 3 * band)
            coverage = len(pairs) / len(template)
            if pairs and coverage >= min_coverage:
                found.append((t, coverage, start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs), cell))
        found.sort(key=lambda f: (-f[4], -f[1], f[2], f[0]))
        taken = np.zeros(len(ids), bool)
        for f in found:
            if not taken[f[2] : f[3]].any():
                taken[f[2] : f[3]] = True
                kept.append(f[:5])
        ids[taken] = -1
        todo = {(f[0], f[5]) for f in found}
    return sorted(kept, key=lambda f: f[2])


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 4, min_coverage: float = 0.8, band: int = 8) -> DataFrame:
    """Per row of docs: (id, n_words, licenses, matches).

    matches: template number, name, coverage (share of the template's words that
    align), first and end word of the span, in the order of the spans. Words
    are runs of letters and digits, A-Z lower-cased. Of finds that overlap, the
    one with most words stays, of equals the one that covers more, then the first
    in the text, then the first of the templates. A null or blank text has no
    matches; repeated rows are scanned each; an empty table gives no rows.
    """
    index = Index(templates, k, window, min_coverage)
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.struct([("template", pa.int32()), ("name", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, names, rows = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                w = _words(text.as_py())
                ids = np.fromiter((index.numbers.get(x, -1) for x in w), np.int64, len(w))
                got = matches_in(index, ids, min_coverage, band)
                counts.append(len(w))
                names.append(sorted({index.names[t] for t, *_ in got}))
                rows.append([{"template": t, "name": index.names[t], "coverage": round(c, 6), "first_word": a, "end_word": b} for t, c, a, b, _ in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(rows, pa.list_(match))], ["id", "n_words", "licenses", "matches"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_words bigint, licenses array<string>, matches array<struct<template:int,name:string,coverage:double,first_word:bigint,end_word:bigint>>"
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
