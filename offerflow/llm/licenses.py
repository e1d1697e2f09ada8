"""License scans: normalised text against license templates by the Dice coefficient over word
bigrams.

A unit - the whole text, a block between blank lines, a line, or a window of as many words as the
template - matches a template if 2 |A & B| / (|A| + |B|) over the sets of their word bigrams
reaches the threshold. Then |A| lies between t / (2 - t) and (2 - t) / t times |B|, and at least
t / (2 - t) |B| bigrams are shared, which leaves few templates and few windows to compare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerflow.llm.common import KEY, row_key, text_of
from offerflow.llm.decontaminate import BREAKS
from offerflow.llm.wordhash import WordHasher, mix, pieces, string_buffers

THRESHOLD = 0.8
PIECE_BYTES = 8 << 20
#: Full license texts, one file for each name in ``TEMPLATES``.
TEXTS = Path(__file__).with_name("license_texts")
#: A paragraph of a full text is a template of its own from this many bigrams on.
CLAUSE = 12

# Notices and headers as their licenses give them.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "Released under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License."),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License."),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",),
}


def _bigrams(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


def _bigram_set(text: str) -> np.ndarray:
    *_, hashes = WordHasher(BREAKS).words(*string_buffers(pa.array([text])))
    return np.unique(_bigrams(hashes)) if len(hashes) > 1 else np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def all_templates() -> dict[str, tuple[str, ...]]:
    """Notices, full texts, and the clauses of the full texts that tell a license: those of
    which no other license's full text has half the bigrams."""
    full = {name: (TEXTS / f"{name}.txt").read_text(encoding="utf-8") for name in TEMPLATES}
    sets, out = {name: _bigram_set(text) for name, text in full.items()}, {}
    for name, text in full.items():
        clauses = []
        for clause in re.split(r"\n\s*\n", text):
            own = _bigram_set(clause)
            if len(own) >= CLAUSE and not any(
                    2 * len(np.intersect1d(own, other, assume_unique=True)) >= len(own)
                    for n, other in sets.items() if n != name):
                clauses.append(clause)
        out[name] = (*TEMPLATES[name], text, *clauses)
    return out


class Templates:
    """The bigram sets of all templates, by size."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]], threshold: float):
        hasher, self.sets = WordHasher(BREAKS), []
        for name in sorted(templates):
            for text in templates[name]:
                *_, hashes = hasher.words(*string_buffers(pa.array([text])))
                if len(hashes) > 1:
                    self.sets.append((name, np.unique(_bigrams(hashes)), len(hashes)))
        self.sets.sort(key=lambda s: len(s[1]))
        self.sizes = np.array([len(s) for _, s, _ in self.sets])
        self.known = np.unique(np.concatenate([s for _, s, _ in self.sets] or [np.zeros(0, np.uint64)]))
        self.threshold = threshold
        #: Which template has which known bigram, and which holds half of another's bigrams.
        self.member = np.zeros((len(self.sets), len(self.known)), dtype=bool)
        for i, (_, s, _) in enumerate(self.sets):
            self.member[i, np.searchsorted(self.known, s)] = True
        wide = self.member.astype(np.float32)
        held = 2 * (wide @ wide.T) >= self.sizes[:, None]
        self.holders = [np.flatnonzero(row).tolist() for row in held]
        #: A match shares at least this many bigrams with its template.
        self.leasts = np.ceil(threshold / (2 - threshold) * self.sizes - 1e-9).astype(np.int64)
        self.least = max(int(self.leasts.min()), 1) if self.sets else 1

    def best(self, unit: np.ndarray) -> tuple[float, str, int, int] | None:
        """The closest template in reach of a unit's bigram set, by score, then name; its place and the shared bigrams."""
        t, found = self.threshold, None
        at = np.minimum(np.searchsorted(self.known, unit), len(self.known) - 1)
        at = at[self.known[at] == unit]
        low = np.searchsorted(self.sizes, t / (2 - t) * len(unit) - 1e-9)
        high = np.searchsorted(self.sizes, min((2 - t) / t * len(unit), 2 * len(at) / t - len(unit)) + 1e-9, side="right")
        for i in range(low, high):
            name, bigrams, _ = self.sets[i]
            shared = int(np.count_nonzero(self.member[i, at]))
            score = 2.0 * shared / (len(unit) + len(bigrams))
            if score >= t and (found is None or (-score, name) < (-found[0], found[1])):
                found = (score, name, i, shared)
        return found

    def windows(self, pairs: np.ndarray, at: np.ndarray, hits: np.ndarray, owner: np.ndarray,
                cuts: np.ndarray) -> Iterator[tuple[int, int, int, float, int]]:
        """(template, first word, behind the last word, score, shared) of the best windows of
        each template that do not overlap. ``pairs`` are the bigrams from each word on, ``hits`` the places of
        those that are ``known[at]``, ``owner`` the text of each word, ``cuts`` where texts begin.

        Windows without the least number of hits are passed over; in the others a bigram counts
        at its first place in the window, so all starts are counted by two running sums."""
        of_hits = at[hits]
        for i, (_, bigrams, m) in enumerate(self.sets):
            least, size = int(self.leasts[i]), len(bigrams)
            if len(hits) < least:
                break
            own = hits[self.member[i, of_hits]]
            if len(own) < least:
                continue
            first, last = own[:len(own) - least + 1], own[least - 1:]
            near = np.flatnonzero((last - first <= m - 2) & (owner[first] == owner[last]))
            if not len(near):
                continue
            lows, highs, texts = last[near] - (m - 2), first[near], owner[first[near]]
            new = np.flatnonzero((texts[1:] != texts[:-1]) | (lows[1:] > highs[:-1] + m)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(near)]):
                text = int(texts[a])
                low = max(int(lows[a]), int(cuts[text]))
                high = min(int(highs[b - 1]), int(cuts[text + 1]) - m)
                if high >= low:
                    yield from self._scan(i, pairs[low:high + m - 1], own, low, high - low + 1, size, m)

    def _scan(self, i: int, part: np.ndarray, own: np.ndarray, low: int, n: int, size: int, m: int):
        place = np.arange(len(part))
        order = np.argsort(part, kind="stable")
        same = part[order[1:]] == part[order[:-1]]
        before = np.full(len(part), -1)
        before[order[1:][same]] = order[:-1][same]
        left, right = np.maximum(np.maximum(before + 1, place - (m - 2)), 0), np.minimum(place, n - 1)

        def per_start(some: np.ndarray) -> np.ndarray:
            some = some[left[some] <= right[some]]
            return np.cumsum(np.bincount(left[some], minlength=n + 1)[:n]
                             - np.bincount(right[some] + 1, minlength=n + 1)[:n])

        inside = own[np.searchsorted(own, low):np.searchsorted(own, low + len(part))] - low
        shared, distinct = per_start(inside), per_start(place)
        score = 2.0 * shared / (distinct + size)
        starts = np.flatnonzero(score >= self.threshold)
        taken = np.zeros(n + m, dtype=bool)
        for at in starts[np.lexsort((starts, (distinct - 3 * shared)[starts]))].tolist():
            if not taken[at]:
                taken[max(at - m + 1, 0):at + m] = True
                yield i, low + at, low + at + m, float(score[at]), int(shared[at])


def _without_held(matches: list[tuple], known: Templates) -> list[dict]:
    """The matches (start, end, score, shared, template, unit), most net bigrams first: shared ones less those
    only one side has. Units all stay; a window goes where it overlaps an earlier match whose
    template holds half of its own template's bigrams, so a license is not found again in
    a larger one."""
    ranked = sorted(((-n * (3 - 2 / score), unit == "window", known.sets[i][0], a, b, i, score, unit)
                     for a, b, score, n, i, unit in matches))
    covered: dict[int, np.ndarray] = {}
    base, length = min(m[0] for m in matches), max(m[1] for m in matches) - min(m[0] for m in matches)
    out = []
    for *_, name, a, b, i, score, unit in ranked:
        a, b = a - base, b - base
        if unit == "window" and any(covered[h][a:b].any() for h in known.holders[i] if h in covered):
            continue
        covered.setdefault(i, np.zeros(length, dtype=bool))[a:b] = True
        out.append({"license": name, "score": score, "unit": unit, "start": a + base, "end": b + base})
    return out


def license_matches(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] | None = None,
                    threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the row key, doc_id, and matches: (license, score, unit, start, end), in bytes
    of the UTF-8 text, most license words first (shared bigrams less those of one side), then name and place.

    Units are ``text``, ``block``, ``line`` and ``window``; a unit with the words of a larger one is
    not reported again, nor a window that :func:`_without_held` names. ``templates`` are :func:`all_templates`
    unless given. ASCII capitals count as small letters; other signs than letters and digits part words.
    Null and empty texts match nothing; ties go to the first name; repeated rows are scanned each;
    an empty table gives no rows. Texts are scanned where they lie, nothing is shuffled."""
    rows = docs.select(*row_key(docs, doc_id), F.col(f"`{doc_id}`").alias("doc_id"),
                       text_of(f"`{text}`").alias("text"))
    match = "struct<license:string,score:double,unit:string,start:long,end:long>"
    given = dict(all_templates() if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = Templates(given, threshold), WordHasher(BREAKS)
        kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("unit", pa.string()),
                                   ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, 3, PIECE_BYTES):
                found: list[dict] = [{} for _ in range(part.num_rows)]
                out: list[list] = [[] for _ in range(part.num_rows)]
                data, offsets = string_buffers(part.column(3))
                starts, ends, owner, hashes = hasher.words(data, offsets)
                if len(hashes) > 1 and known.sets:
                    pairs = _bigrams(hashes)
                    at = np.minimum(np.searchsorted(known.known, pairs), len(known.known) - 1)
                    hit = known.known[at] == pairs
                    shared = np.concatenate([[0], np.cumsum(hit)])
                    # breaks between words: a new text, a blank line, a line
                    base = int(offsets[0])
                    ends_line = data[base:int(offsets[-1])] == 10
                    lines = np.concatenate([[0], np.cumsum(ends_line)])
                    blank = np.flatnonzero(ends_line)
                    gap = [data[base + a + 1:base + b].tobytes().strip() == b"" for a, b in zip(blank[:-1], blank[1:])] \
                        if len(blank) > 1 else []
                    blanks = np.zeros(len(ends_line) + 1, dtype=np.int64)
                    blanks[blank[1:][np.array(gap, dtype=bool)] + 1] = 1
                    blanks = np.cumsum(blanks)
                    line, block = lines[starts - base], blanks[starts - base]
                    new_text = owner[1:] != owner[:-1]
                    for unit, new in (("text", new_text), ("block", new_text | (block[1:] != block[:-1])),
                                      ("line", new_text | (line[1:] != line[:-1]))):
                        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(hashes)]])
                        inside = shared[cuts[1:] - 1] - shared[cuts[:-1]]
                        for k in np.flatnonzero(inside >= known.least).tolist():
                            a, b = int(cuts[k]), int(cuts[k + 1])
                            d = int(owner[a])
                            if (a, b) in found[d]:
                                continue
                            best = known.best(np.unique(pairs[a:b - 1]))
                            if best:
                                found[d][a, b] = (a, b, best[0], best[3], best[2], unit)
                    texts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                    hits = np.flatnonzero(hit & ~new_text)
                    for i, a, b, score, n in known.windows(pairs, at, hits, owner, texts):
                        found[int(owner[a])].setdefault((a, b), (a, b, score, n, i, "window"))
                    for d, f in enumerate(found):
                        if f:
                            out[d] = [m | {"start": int(starts[m["start"]] - offsets[d]), "end": int(ends[m["end"] - 1] - offsets[d])}
                                      for m in _without_held(list(f.values()), known)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(out, kind)],
                                                 names=[*KEY, "doc_id", "matches"])

    return rows.mapInArrow(scan, f"{KEY[0]} string, {KEY[1]} long, "
                                 f"doc_id {docs.schema[doc_id].dataType.simpleString()}, matches array<{match}>")
