"""Operator 6: licence scans by Dice coefficient over word bigrams.

A text is scanned line by line: any run of whole lines may be a licence text or notice. Runs and templates
are normalised alike (A-Z lower-cased, words of digits, letters and characters beyond ASCII, "licence" as
"license", clauses that name a copyright holder left out) and compared by the Dice coefficient of their word
bigrams, repeats included: 2 * common / (bigrams of both). At ``THRESHOLD`` t, a template of m bigrams can only match
runs of m * t / (2 - t) to m * (2 - t) / t bigrams that share at least m * t / (2 - t) of them: these
bounds prune templates and runs before anything is compared.

All runs that reach the threshold count, of every template and however often a text holds it; of runs that
overlap, the one with the larger coefficient stays (then the licence that sorts first, then the run that begins
first, then the shortest).

Templates are a bounded list, sent to all tasks; texts are never shuffled. Defined results: a null text, an
empty one or one without a match gives no row; rows that repeat a doc_id give their findings each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.llm.common import arrow_columns, quoted

THRESHOLD = 0.8

# Licence texts, headers and short notices, without the lines that name a holder.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later
version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

_AGPL, _LGPL = (_GPL.replace("GNU General", f"GNU {kind} General") for kind in ("Affero", "Lesser"))
_CC0 = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (_AGPL.format(3), "This work is licensed under the GNU Affero General Public License, version 3."),
    "Apache-2.0": (_APACHE, "Licensed under the Apache License, Version 2.0."),
    "BSD-2-Clause": (f"{_BSD_TOP}\n{_BSD_END}", "Released under the BSD 2-Clause License."),
    "BSD-3-Clause": (f"{_BSD_TOP}\n{_BSD_THIRD}\n{_BSD_END}", "Released under the BSD 3-Clause License."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": (_CC0,),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "GPL-2.0": (_GPL.format(2), "This work is licensed under the GNU General Public License, version 2."),
    "GPL-3.0": (_GPL.format(3), "This work is licensed under the GNU General Public License, version 3."),
    "ISC": (_ISC, "Released under the ISC License."),
    "LGPL-2.1": (_LGPL.format("2.1").replace("program", "library"), "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    "LGPL-3.0": (_LGPL.format(3), _LGPL.format(3).replace("program", "library"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    "MIT": (_MIT, "Released under the MIT License."),
    "MPL-2.0": (_MPL, "Licensed under the Mozilla Public License, version 2.0."),
    "Unlicense": (_UNLICENSE, "Released into the public domain under the Unlicense."),
    "Zlib": (_ZLIB, "Released under the zlib License."),
}

# Every byte outside a word becomes a blank; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


# A clause that names a copyright holder goes up to the end of its sentence or line, and has so many words at most.
_HOLDER = re.compile(rb"[^A-Za-z0-9\x80-\xff]*(?:\(c\)\s*)?copyright\b(?:[^.!?]|[.!?](?!\s))*+[.!?]*(?:\s+all rights reserved\b\.?)?", re.IGNORECASE)
_DATED = re.compile(rb"\(c\)|\xc2\xa9|\b(?:19|20)[0-9]{2}\b", re.IGNORECASE)
_HOLDER_WORDS, _UNDATED_WORDS = 16, 6
# what follows "copyright" where no holder is named
_OTHERS = (b"holder", b"holders", b"owner", b"owners", b"notice", b"notices", b"law", b"laws", b"and", b"or", b"license", b"licence")


def line_words(line: bytes) -> list[bytes]:
    words = line.translate(_WORD_BYTES).split()
    if words[:1] == [b"copyright"] or words[:2] == [b"c", b"copyright"]:
        clause = _HOLDER.match(line)
        if clause is None:
            return words
        named = clause.group().translate(_WORD_BYTES).split()
        dated = _DATED.search(clause.group()) is not None
        short = len(named) <= _UNDATED_WORDS and not (len(words) > 1 and words[1] in _OTHERS)
        if len(named) <= _HOLDER_WORDS and (dated or short):
            return words[len(named) :]
    return words


def _as_license(words: list[bytes]) -> list[bytes]:
    return [b"license" + w[7:] if w in (b"licence", b"licences", b"licenced") else w for w in words]


def text_lines(text: bytes) -> list[list[bytes]]:
    lines = [line_words(line) for line in text.split(b"\n")]
    return [_as_license(w) for w in lines] if b"icence" in text.lower() else lines


class Scanner:
    """Templates by their bigrams; bigrams are numbers made of word ids."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float = THRESHOLD):
        self.threshold, self.vocabulary = threshold, {}
        self.names, self.counts = [], []
        texts = [(name, text) for name, several in sorted(templates.items()) for text in several]
        words = [[w for line in text_lines(text.encode()) for w in line] for _, text in texts]
        for some in words:
            for w in some:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.base = len(self.vocabulary) + 1
        for (name, _), some in zip(texts, words, strict=True):
            ids = [self.vocabulary[w] for w in some]
            self.names.append(name)
            self.counts.append(Counter(a * self.base + b for a, b in zip(ids, ids[1:], strict=False)))
        self.sizes = [sum(c.values()) for c in self.counts]
        self.keys = [np.array(sorted(c), np.int64) for c in self.counts]
        self.all = np.unique(np.concatenate(self.keys))
        # which templates have a bigram: one row a bigram
        self.member = np.stack([np.isin(self.all, k) for k in self.keys])
        self.least = [math.ceil(m * threshold / (2 - threshold) - 1e-9) for m in self.sizes]
        self.most = [math.floor(m * (2 - threshold) / threshold + 1e-9) for m in self.sizes]

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, last line); lines from 0."""
        if not text:
            return []
        lines = text_lines(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for line in lines for w in line), np.int64)
        if len(ids) < 2:
            return []
        pair = np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] * self.base + ids[1:], 0)
        at = np.searchsorted(self.all, pair)
        at[at == len(self.all)] = 0
        hit = np.flatnonzero(self.all[at] == pair)
        if len(hit) < min(self.least):
            return []
        starts = np.concatenate(([0], np.cumsum([len(line) for line in lines])))
        found: list[tuple[float, str, int, int]] = []
        for k, name in enumerate(self.names):
            mine = hit[self.member[k][at[hit]]]
            if len(mine) >= self.least[k]:
                found += [(-dice, name, i, j) for dice, i, j in self._runs(k, pair, mine, starts)]
        chosen: list[tuple[str, float, int, int]] = []
        taken = np.zeros(len(lines), np.bool_)
        for value, name, first, last in sorted(found):
            if not taken[first : last + 1].any():
                taken[first : last + 1] = True
                chosen.append((name, -value, first, last))
        return sorted(chosen, key=lambda x: (x[2], x[0]))

    def _runs(self, k: int, pair: np.ndarray, mine: np.ndarray, starts: np.ndarray) -> list[tuple[float, int, int]]:
        """All runs of lines that match template ``k``; ``mine`` are the places of its bigrams. A run of lines i..j has
        the bigrams starts[i] … starts[j + 1] - 2. A run without a bigram of the template in its first and last line is no
        better than the shorter one."""
        runs = []
        least, most, size, counts = self.least[k], self.most[k], self.sizes[k], self.counts[k]
        last_line = len(starts) - 2
        for i in np.unique(np.searchsorted(starts, mine, side="right") - 1).tolist():
            j_top = min(last_line, int(np.searchsorted(starts, starts[i] + most + 1, side="right")) - 1)
            inside = mine[np.searchsorted(mine, starts[i]) : np.searchsorted(mine, starts[i] + most)]
            if len(inside) < least:
                continue
            ends = np.unique(np.searchsorted(starts, inside[least - 1 :] + 1, side="right") - 1)
            seen: Counter = Counter()
            common, place = 0, 0
            for j in ends.tolist():
                if j > j_top:
                    break
                stop = int(starts[j + 1]) - 1
                n = stop - int(starts[i])
                if n > most:
                    break
                while place < len(inside) and inside[place] < stop:
                    key = int(pair[inside[place]])
                    seen[key] += 1
                    common += seen[key] <= counts[key]
                    place += 1
                if n < least:
                    continue
                dice = 2 * common / (n + size)
                if dice >= self.threshold:
                    runs.append((dice, i, j))
        return runs


FINDINGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("license_id", T.StringType()),
            T.StructField("dice", T.DoubleType()),
            T.StructField("first_line", T.LongType()),
            T.StructField("last_line", T.LongType()),
        ]
    )
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row a finding: id, license_id, dice, first_line, last_line (lines from 0)."""

    def start():
        scanner, names = Scanner(templates, threshold), FINDINGS.elementType.fieldNames()

        def work(texts: pa.Array):
            return [[[dict(zip(names, f, strict=True)) for f in scanner.scan(t)] for t in texts.to_pylist()]]

        return work

    found = arrow_columns(docs, [id_col], [quoted(text_col).cast("binary")], T.StructType([T.StructField("found", FINDINGS)]), start)
    return found.toDF("id", "found").select(F.col("id").alias(id_col), F.inline("found"))
