"""License templates in documents: winnowed fingerprints, then banded alignment.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased. A template's fingerprints are the hashes of its runs of ``size``
words, winnowed: of every ``winnow`` neighbouring runs the one with the smallest
hash. An inverted index of the fingerprints (bounded by the templates, a
configuration, and sent to every task) is looked up for all runs of a document.
Hits whose template start falls within the band of each other are a candidate if
they have at least ``share`` of the template's fingerprints. A candidate is
aligned word by word inside the band (longest common subsequence), which gives
the matched share of the template's words and the matched runs of the document.
Occurrences of ``coverage`` or more are reported, the best of overlapping ones.

Documents are scanned where they are read; nothing is shuffled, and a text that
repeats a template any number of times reports each.

Defined results: null, empty or word-less text has no matches; a template
without words never matches; repeated rows are reported each; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, chunks, shingles, text_bytes, word_hashes

# Notices as their licences word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def _hashed(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]), ALNUM)[0]


def fingerprints(words: np.ndarray, size: int, winnow: int) -> dict[int, int]:
    """Place and hash of the winnowed runs of a template."""
    size = min(size, len(words))
    if not size:
        return {}
    runs, _ = shingles(words, np.array([0, len(words)]), size)
    out = {}
    for lo in range(max(1, len(runs) - winnow + 1)):
        at = lo + int(np.argmin(runs[lo : lo + winnow]))
        out[at] = int(runs[at])
    return out


def align(template: np.ndarray, words: np.ndarray, start: int, band: int) -> list[tuple[int, int]]:
    """Matched (template word, document word) pairs of the longest common
    subsequence whose document word is within ``band`` of ``start`` + template word."""
    m, width = len(template), 2 * band + 1
    # best[i][k]: of the template before i and the words before start + i + k - band.
    best = [[0] * (width + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        row, above = best[i], best[i - 1]
        for k in range(width + 1):
            j = start + i + k - band - 1
            top = above[k + 1] if k < width else above[k]
            if k and row[k - 1] > top:
                top = row[k - 1]
            if 0 <= j < len(words) and k < width and template[i - 1] == words[j] and above[k] + 1 > top:
                top = above[k] + 1
            row[k] = top
    pairs, i, k = [], m, max(range(width + 1), key=lambda x: best[m][x])
    while i > 0 and best[i][k]:
        j = start + i + k - band - 1
        if k and best[i][k - 1] == best[i][k]:
            k -= 1
        elif 0 <= j < len(words) and k < width and template[i - 1] == words[j] and best[i][k] == best[i - 1][k] + 1:
            pairs.append((i - 1, j))
            i -= 1
        else:
            i, k = i - 1, min(k + 1, width)
    return pairs[::-1]


class _Index:
    def __init__(self, templates: dict[str, str], size: int, winnow: int, share: float, coverage: float):
        self.share, self.coverage = share, coverage
        self.names = sorted(templates)
        self.words = [_hashed(templates[n]) for n in self.names]
        self.band = [min(16, max(2, len(w) // 4)) for w in self.words]
        prints = [fingerprints(w, size, winnow) for w in self.words]
        self.count = [len(set(p.values())) for p in prints]
        by_size = defaultdict(list)
        for t, own in enumerate(prints):
            by_size[min(size, len(self.words[t]))] += [(h, t, at) for at, h in own.items()]
        self.posts = {}
        for k, rows in by_size.items():
            if k:
                rows.sort()
                grams = np.array([r[0] for r in rows], np.uint64)
                keys, first = np.unique(grams, return_index=True)
                self.posts[k] = keys, np.r_[first, len(rows)], np.array([r[1:] for r in rows], np.int64)

    def candidates(self, words: np.ndarray, first: np.ndarray):
        """(row, template): [(start, fingerprint)] over a chunk of documents."""
        out = defaultdict(list)
        for k, (keys, lead, posts) in self.posts.items():
            grams, run_first = shingles(words, first, k)
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            for place in np.flatnonzero(keys[at] == grams):
                row = int(np.searchsorted(run_first, place, "right")) - 1
                for t, offset in posts[lead[at[place]] : lead[at[place] + 1]]:
                    out[row, int(t)].append((int(place - run_first[row] - offset), int(keys[at[place]])))
        return out

    def matches(self, words: np.ndarray, hits: list[tuple[int, int]], t: int):
        """(coverage, matched runs of words) of a template in one document."""
        found, group = [], []
        for start, print_ in [*sorted(hits), (1 << 60, 0)]:
            if group and start - group[0][0] > self.band[t]:
                if len({p for _, p in group}) >= self.share * self.count[t]:
                    middle = sorted(s for s, _ in group)[len(group) // 2]
                    pairs = align(self.words[t], words, middle, self.band[t])
                    if len(pairs) >= self.coverage * len(self.words[t]):
                        found.append((len(pairs) / len(self.words[t]), [j for _, j in pairs]))
                group = []
            group.append((start, print_))
        kept = []
        for share, places in sorted(found, key=lambda f: (-f[0], f[1])):
            if all(places[-1] < other[0] or places[0] > other[-1] for _, other in kept):
                kept.append((share, places))
        return sorted(kept, key=lambda f: f[1])


def _runs(places: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for j in places:
        if out and out[-1][1] == j:
            out[-1] = out[-1][0], j + 1
        else:
            out.append((j, j + 1))
    return out


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, size: int = 3, winnow: int = 4, share: float = 0.3, coverage: float = 0.8,
) -> DataFrame:
    """A row for each document and template found: doc_id, template, the best
    coverage, how often, and the matched runs of words with their occurrence."""
    index = _Index(TEMPLATES if templates is None else templates, size, winnow, share, coverage)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    span = pa.struct([("occurrence", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def rows(batches):
        index = sent.value
        for batch in batches:
            ids = batch.column(0)
            out = []
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets):
                words, first = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ALNUM)
                for (row, t), hits in sorted(index.candidates(words, first).items()):
                    found = index.matches(words[first[row] : first[row + 1]], hits, t)
                    if found:
                        spans = [{"occurrence": n, "start": s, "end": e} for n, (_, places) in enumerate(found) for s, e in _runs(places)]
                        out.append((ids[lo + row].as_py(), index.names[t], max(f[0] for f in found), len(found), spans))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "template", "coverage", "n_matches", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, template string, coverage double, n_matches long, spans array<struct<occurrence:int,start:int,end:int>>")
