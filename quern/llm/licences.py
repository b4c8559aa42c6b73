"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

A text is looked at in passages: for each template all runs of words, wherever lines end, that start and
end with a word pair of the template (other ends only lower the coefficient). A passage of m distinct word
pairs can reach coefficient t only with a template of m * t / (2 - t) to m * (2 - t) / t pairs, so longer
passages and templates with too few pairs in the text are never compared.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, table

THRESHOLD = 0.8
#: names and texts of the bundled templates (fixed values: published notices)
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

_words = re.compile(r"[^\W_]+").findall


def bigrams(text: str) -> set[tuple[str, str]]:
    """Distinct neighbouring words of the lower-cased text; punctuation and line breaks don't count."""
    words = _words(text.lower())
    return set(zip(words, words[1:]))


@dataclass
class Scanner:
    templates: dict[str, str]
    threshold: float = THRESHOLD
    pairs: set = field(init=False)
    names: list = field(init=False)
    sets: list = field(init=False)
    sizes: list = field(init=False)
    within: dict = field(init=False)

    def __post_init__(self) -> None:
        made = sorted(((len(b), name, b) for name, text in self.templates.items() if (b := bigrams(text))), key=lambda x: x[:2])
        self.sizes, self.names, self.sets = [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]
        self.pairs = set().union(*self.sets) if self.sets else set()
        self.within = {pair: [k for k, b in enumerate(self.sets) if pair in b] for pair in self.pairs}

    def passage(self, found: set) -> tuple[float, str] | None:
        """The best template of a passage's word pairs; ties to the name."""
        m, t = len(found), self.threshold
        lo, hi = bisect_left(self.sizes, m * t / (2 - t) - 1e-9), bisect_right(self.sizes, m * (2 - t) / t + 1e-9)
        best = None
        for i in range(lo, hi):
            dice = 2 * len(found & self.sets[i]) / (m + self.sizes[i])
            if dice >= t - 1e-12 and (best is None or (-dice, self.names[i]) < (-best[0], best[1])):
                best = (dice, self.names[i])
        return best

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Passages (first word, last word, template, coefficient), best first where they overlap; ties to the longer template."""
        t, words = self.threshold, _words(text.lower())
        counts: dict[int, int] = {}
        for pair in self.pairs.intersection(zip(words, words[1:])):
            for k in self.within[pair]:
                counts[k] = counts.get(k, 0) + 1
        # a template of n pairs needs n * t / (2 - t) of them in a passage
        possible = {k for k, n in counts.items() if n >= self.sizes[k] * t / (2 - t) - 1e-9}
        if not possible:
            return []
        starts = {pair: ks for pair, within in self.within.items() if (ks := [k for k in within if k in possible])}
        found = []
        # where each pair stands next; read backwards, the pairs in the order of a passage that starts here
        ahead: dict[tuple[str, str], int] = {}
        for i in range(len(words) - 2, -1, -1):
            here = (words[i], words[i + 1])
            ahead.pop(here, None)
            ahead[here] = i
            for k in starts.get(here, ()):
                template, size, common = self.sets[k], self.sizes[k], 0
                for m, pair in enumerate(islice(reversed(ahead), int(size * (2 - t) / t + 1e-9)), 1):
                    if pair in template:
                        common += 1
                        dice = 2 * common / (m + size)
                        if dice >= t - 1e-12:
                            found.append((-dice, -size, i, ahead[pair] + 1, self.names[k]))
        out: list[tuple[int, int, str, float]] = []
        taken = bytearray(len(words))
        for dice, _, start, stop, name in sorted(found):
            if taken.find(1, start, stop + 1) < 0:
                taken[start : stop + 1] = b"\1" * (stop + 1 - start)
                out.append((start, stop, name, -dice))
        return sorted(out)


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, n_passages, licences for every row of docs (doc_id, text).

    licence: the template of the best passage (ties to the name) or null; dice: its coefficient, 0 without
    one; licences: all templates found, sorted. Null and empty texts have none. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column(1):
                found = scanner.scan(t.as_py() or "")
                best = min(((-f[3], f[2]) for f in found), default=(0.0, None))
                for column, value in zip(out, (best[1], -best[0], len(found), sorted({f[2] for f in found})), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.string()))],
                names=["doc_id", "licence", "dice", "n_passages", "licences"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_batches(rows, run, "doc_id long, licence string, dice double, n_passages long, licences array<string>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
