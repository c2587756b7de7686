"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are split into words (lower case, ASCII letters and digits). Hashes of GRAM consecutive words are winnowed:
of every WINNOW consecutive ones the least is kept. The inverted index maps a fingerprint to its places in the
templates; it is bounded by the templates, never by the corpus. A text's grams are all looked up, so whatever
a template's winnowing kept is found if the text holds it. Hits near one diagonal (template place - text
place) make a candidate region, and alignment within a band around that diagonal (BAND words, a quarter of a short template) gives the matched template words
(coverage) and the code-point span of text from the first to the last match. Regions below MIN_COVERAGE are dropped; of regions
that overlap in the text the one with more matched words counts, then the higher coverage.

Defined results: a null text is the empty text; repeated rows give equal results; an empty table gives no
rows; other input columns are ignored; a text without any match has an empty report.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .tokens import _VALUE, chunks, rolling, spans_hash, texts

GRAM, WINNOW, BAND = 3, 4, 8
MIN_COVERAGE = 0.6
CHUNK = 1 << 20

# Public license notices and texts.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit-notice": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "all-rights-reserved": "All rights reserved.",
}

_INNER = np.zeros(256, bool)
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Scan:
    """Words (byte starts, ends, hashes, rows) of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inner = _INNER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = np.r_[False, inner[:-1]] if len(inner) else inner, np.r_[inner[1:], False] if len(inner) else inner
        self.starts = np.flatnonzero(inner & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inner & (~after | edge[1:])) + 1
        self.hashes = spans_hash(_VALUE[_LOWER[data]], self.starts, self.ends)
        self.first = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


class Index:
    """Templates as word hashes, and the inverted index of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), []
        entries = []
        for t, text in enumerate(templates.values()):
            scan = _Scan(*texts(pa.array([text])))
            self.words.append(scan.hashes)
            grams = rolling(scan.hashes, GRAM)
            if not len(grams):
                raise ValueError(f"template {self.names[t]!r} has fewer than {GRAM} words")
            keep = {int(i + np.argmin(grams[i : i + WINNOW])) for i in range(max(1, len(grams) - WINNOW + 1))}
            entries += [(int(grams[i]), t, i) for i in sorted(keep)]
        entries.sort()
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.places = np.array([e[1:] for e in entries], np.int64)


def align(words: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end): longest common subsequence of template and words with |template place - word place - diagonal| <= band,
    and the range of words from its first to its last match (the latest start, then the earliest end, among the longest)."""
    width = 2 * band + 1
    # Cell k of row i stands for word i - diagonal - band + k; a cell is (matches, -span) so that max prefers more matches, then a shorter span.
    best: list[tuple[int, int, int]] = [(0, -1, -1)] * (width + 1)  # matches, first, end
    n = len(words)

    def better(a, b):
        return a if (a[0], a[1] - a[2]) >= (b[0], b[1] - b[2]) else b

    final = (0, -1, -1)
    for i, h in enumerate(template):
        row = [(0, -1, -1)] * (width + 1)
        left = (0, -1, -1)
        for k in range(width):
            j = i - diagonal - band + k
            up = best[k + 1] if k + 1 < width else (0, -1, -1)
            cell = better(left, up)
            if 0 <= j < n and words[j] == h:
                m, f, _ = best[k]
                cell = better((m + 1, j if m == 0 else f, j + 1), cell)
            row[k] = left = cell
        best = row
        final = better(left, final)
    return final


def chained(words: np.ndarray, template: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of chains of two or more runs of equal words of a template, in the order of both, no two more
    than a template's length apart. hits: (word place, template place) of equal grams; each grows into its whole run."""
    runs, reach = [], {}
    for j, i in sorted(hits):
        if reach.get(j - i, -1) > j:
            continue
        a = b = 0
        while min(i, j) - a > 0 and words[j - a - 1] == template[i - a - 1]:
            a += 1
        while i + b < len(template) and j + b < len(words) and words[j + b] == template[i + b]:
            b += 1
        reach[j - i] = j + b
        runs.append((j - a, i - a, a + b))
    runs.sort()
    best: list[tuple[int, int, int]] = []  # matches, first, runs of the best chain that ends with each run
    low = 0
    for k, (j, i, n) in enumerate(runs):
        top = (n, j, 1)
        while runs[low][0] + 2 * len(template) < j:
            low += 1
        for p in range(low, k):
            pj, pi, pn = runs[p]
            # What two runs share in the template or the text counts once.
            over = max(0, pj + pn - j, pi + pn - i)
            if pj < j and pi < i and over < n and j - pj - pn <= len(template):
                top = max(top, (best[p][0] + n - over, best[p][1], best[p][2] + 1), key=lambda c: (c[0], c[1]))
        best.append(top)
    return [(m, first, runs[k][0] + runs[k][2]) for k, (m, first, n) in enumerate(best) if n > 1]


def scan_rows(data: np.ndarray, offsets: np.ndarray, index: Index, min_coverage: float) -> dict[int, list[tuple[str, float, int, int, int]]]:
    """(license, coverage, matched words, first byte, end byte) of the matches in each row that has any."""
    scan = _Scan(data, offsets)
    grams = rolling(scan.hashes, GRAM)
    if not len(grams):
        return {}
    at = np.searchsorted(index.prints, grams)
    hit = np.flatnonzero((at < len(index.prints)) & (index.prints[np.minimum(at, len(index.prints) - 1)] == grams) & (scan.rows[GRAM - 1 :] == scan.rows[: len(grams)]))
    regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for g in hit.tolist():
        row = int(scan.rows[g])
        k = int(at[g])
        while k < len(index.prints) and index.prints[k] == grams[g]:
            t, place = index.places[k].tolist()
            regions.setdefault((row, t), []).append((g - int(scan.first[row]) - place, g))
            k += 1
    found: dict[int, list] = {}
    for (row, t), hits in regions.items():
        template, base = index.words[t], int(scan.first[row])
        words = scan.hashes[base : int(scan.first[row + 1])]
        hits.sort()
        last, band = None, min(BAND, len(template) // 4)
        for shift, _ in hits:
            # Hits are sorted by where the template would begin; those within half a band share a region.
            if last is not None and shift - last <= band // 2:
                continue
            last = shift
            lo, hi = max(0, shift - band), min(len(words), shift + len(template) + band)
            matched, a, b = align(words[lo:hi], template, lo - shift, band)
            if matched >= min_coverage * len(template) and matched:
                found.setdefault(row, []).append((index.names[t], matched / len(template), matched, int(scan.starts[base + lo + a]), int(scan.ends[base + lo + b - 1])))
        places = [(g - int(scan.first[row]), g - int(scan.first[row]) - shift) for shift, g in hits]
        for matched, a, b in chained(words, template, places):
            if matched >= min_coverage * len(template):
                found.setdefault(row, []).append((index.names[t], matched / len(template), matched, int(scan.starts[base + a]), int(scan.ends[base + b - 1])))
    for row, matches in found.items():
        found[row] = disjoint(matches)
    return found


def disjoint(matches: list) -> list:
    """Of matches that overlap in the text the one with more matched words, then the higher coverage, then the earlier one, then by name; in text order."""
    starts: list[int] = []
    kept: list = []
    for m in sorted(matches, key=lambda m: (-m[2], -m[1], m[3], m[0])):
        # Those kept are apart, so only the neighbours of a place can overlap.
        k = bisect.bisect_left(starts, m[3])
        if (k == 0 or kept[k - 1][4] <= m[3]) and (k == len(kept) or kept[k][3] >= m[4]):
            starts.insert(k, m[3])
            kept.insert(k, m)
    return kept


def find_licenses(df: DataFrame, key: str, text: str, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(key, n_matches, licenses, report): licenses found, comma-joined in text order, and name:coverage:start:end of each match."""
    index = Index(templates or TEMPLATES)
    kind = dict(df.select(key).dtypes)[key]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
                found = scan_rows(data, offsets, index, min_coverage)
                n, names, reports = [], [], []
                for r in range(hi - lo):
                    matches = found.get(r, ())
                    n.append(len(matches))
                    names.append(",".join(m[0] for m in matches))
                    if not matches:
                        reports.append("")
                        continue
                    points = np.concatenate([[0], np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
                    reports.append(",".join(f"{m[0]}:{m[1]:.4f}:{points[m[3] - offsets[r]]}:{points[m[4] - offsets[r]]}" for m in matches))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(reports, pa.string())], [key, "n_matches", "licenses", "report"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_matches long, licenses string, report string")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir), "doc_id", "text")
