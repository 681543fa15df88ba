"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Text is lowered and cut into runs of letters and digits. Every block of consecutive lines is compared with
each template whose size lies within the bounds the threshold allows (t/(2-t) to (2-t)/t times its own);
a text with too few bigrams of a template cannot reach the threshold and is passed over at once. All of it
happens where the text is read: no shuffle.

One row per document; licence, dice and lines are null where nothing reaches the threshold. Of equal scores
the shorter block, then the earlier one, then the licence named first wins. Null and empty texts hold none.

``matches`` lists every match inside lines or across them: for each template windows of words, wherever they begin
and end, the likest first and none overlapping another of the same template. Where no block of whole lines reaches
the threshold the likest window gives the licence.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from commitloom.llm.hashing import LETTER, mixed, range_hashes, runs, word_spans
from commitloom.llm.tables import per_batch, texts

THRESHOLD = 0.8
# Notices and texts as their licences print them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for "
        "more details."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for "
        "more details."),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."),
}
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
_APART = np.ones(256, bool)
_APART[48:58] = _APART[65:91] = _APART[97:123] = _APART[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AZ = {i: i + 32 for i in range(65, 91)}


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_AZ))


def bigrams(given: list[str]) -> set[tuple[str, str]]:
    return set(zip(given, given[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@lru_cache(maxsize=1)
def _templates() -> dict[str, set]:
    return {name: bigrams(words(text)) for name, text in TEMPLATES.items()}


@lru_cache(maxsize=1)
def _known() -> np.ndarray:
    """Hashes of all template bigrams, sorted."""
    found = []
    for text in TEMPLATES.values():
        data = np.frombuffer(text.encode(), np.uint8)
        found.append(_bigram_hashes(data, np.array([0, len(data)]))[0])
    return np.unique(np.concatenate(found))


def _bigram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lowered = _LOWER[data]
    starts, ends, text = word_spans(lowered, offsets, _APART)
    hashes = range_hashes(LETTER[lowered], starts, ends)
    same = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    return mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[same], text[1:][same]


def _next(ids: np.ndarray) -> np.ndarray:
    """Where each number stands next; the length where it does not."""
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out = np.full(len(ids), len(ids))
    out[order[again]] = order[again + 1]
    return out


def _numbers(flat: list[str]) -> tuple[dict[tuple[str, str], int], np.ndarray]:
    """Numbers of the distinct bigrams, and the number at each place."""
    numbers: dict[tuple[str, str], int] = {}
    return numbers, np.array([numbers.setdefault(pair, len(numbers)) for pair in zip(flat, flat[1:])], np.int64)


def best_match(text: str, threshold: float = THRESHOLD) -> tuple[str | None, float | None, int | None, int | None]:
    """Licence, Dice coefficient and first and last line (from 0) of the best block of ``text``.

    A block is not extended once all bigrams of its first line stand in its other lines: without that line it would be as
    like and shorter. So lines that repeat do not make blocks grow.
    """
    templates = _templates()
    known = set().union(*templates.values())
    lines = [words(line) for line in text.split("\n")]
    flat = [w for line in lines for w in line]
    ends = np.cumsum([len(line) for line in lines]).tolist()
    hits = [p for p, pair in enumerate(zip(flat, flat[1:])) if pair in known]
    touched = sorted({bisect_right(ends, p) for p in hits} | {bisect_right(ends, p + 1) for p in hits})
    largest = max(len(t) for t in templates.values()) * (2 - threshold) / threshold
    upcoming = _next(_numbers(flat)[1])
    best: tuple | None = None
    for i in touched:
        block: set = set()
        begin = ends[i - 1] if i else 0
        covered = int(upcoming[begin:ends[i]].max(initial=-1))
        for j in range(i, len(lines)):
            low = begin if j == i else max(begin, ends[j - 1] - 1)
            block |= set(zip(flat[low:ends[j]], flat[low + 1:ends[j]]))
            if len(block) > largest or (j > i and ends[j] - 2 >= covered >= 0):
                break
            if not lines[j]:
                continue
            for name, template in templates.items():
                if threshold / (2 - threshold) * len(template) <= len(block) <= (2 - threshold) / threshold * len(template):
                    value = dice(block, template)
                    if value >= threshold:
                        best = min(best or (0,), (-value, j - i, i, name, j))
    return (best[3], -best[0], best[2], best[4]) if best else (None, None, None, None)


def windows(text: str, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int, int, int]]:
    """(licence, Dice coefficient, first and last word, first and last line, all from 0) of every match, likest first.

    A window loses nothing by beginning and ending at bigrams of the template, nor by ending before its first bigram
    comes again: beginning after it would leave the same bigrams in fewer words.
    """
    lines = [words(line) for line in text.split("\n")]
    flat = [w for line in lines for w in line]
    ends = np.cumsum([len(line) for line in lines]).tolist()
    numbers, ids = _numbers(flat)
    upcoming = _next(ids)
    before = np.full(len(ids) + 1, -1)
    before[upcoming] = np.arange(len(ids))
    before = before[:-1]
    out = []
    for name, template in _templates().items():
        shared = np.array([pair in template for pair in numbers], bool)
        if shared.sum() < threshold / (2 - threshold) * len(template):
            continue
        common, largest = shared[ids], (2 - threshold) / threshold * len(template)
        found = []
        for i in np.flatnonzero(common).tolist():
            end = int(upcoming[i])
            reach = min(2 * int(largest) + 2, end - i)
            new = before[i:i + reach] < i
            while i + reach < end and new.sum() <= largest:
                reach = min(2 * reach, end - i)
                new = before[i:i + reach] < i
            value = 2 * np.cumsum(new & common[i:i + reach]) / (np.cumsum(new) + len(template))
            k = int(value.argmax())
            if value[k] >= threshold:
                found.append((-float(value[k]), k, i))
        taken = np.zeros(len(flat), bool)
        for value, k, i in sorted(found):
            if not taken[i:i + k + 2].any():
                taken[i:i + k + 2] = True
                out.append((name, -value, i, i + k + 1, bisect_right(ends, i), bisect_right(ends, i + k + 1)))
    return sorted(out, key=lambda m: (-m[1], m[3] - m[2], m[2], m[0]))


def scanned(text: str, threshold: float = THRESHOLD) -> tuple:
    """``best_match`` and all ``windows`` of ``text``; the first of them where no block of lines matches."""
    best, every = best_match(text, threshold), windows(text, threshold)
    if best[0] is None and every:
        best = (*every[0][:2], *every[0][4:])
    return (*best, [dict(zip(_FIELDS, m)) for m in every])


_FIELDS = ("licence", "dice", "first_word", "last_word", "first_line", "last_line")
_MATCHES = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), *((name, pa.int32()) for name in _FIELDS[2:])]))


def licences(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, first_line, last_line, matches of every row."""
    least = min(threshold * len(t) / (2 - threshold) for t in _templates().values())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, rows = batch.column("text"), []
        for first, data, offsets in runs(column):
            hashes, owner = _bigram_hashes(data, offsets)
            known = _known()
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hits = np.bincount(owner[known[at] == hashes], minlength=len(offsets) - 1)
            rows += [scanned(column[first + i].as_py(), threshold) if n >= least else (None, None, None, None, []) for i, n in enumerate(hits)]
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32(), _MATCHES)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]],
            names=["doc_id", "licence", "dice", "first_line", "last_line", "matches"])

    return texts(docs).mapInArrow(
        per_batch(step),
        "doc_id long, licence string, dice double, first_line int, last_line int, "
        "matches array<struct<licence:string,dice:double,first_word:int,last_word:int,first_line:int,last_line:int>>")
