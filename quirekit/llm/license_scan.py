"""Licence scans: lines and paragraphs compared with licence templates by the Dice coefficient of their word bigrams.

All of it is column functions within a row: no Python worker, no shuffle. A text is cut into lines and into paragraphs of
more than one line; each segment is normalised (a-z and digits, single spaces) and reduced to its set of word bigrams.
Two bounds, both exact, keep templates away from segments:

* Dice >= t needs set sizes a, b with ``a t / (2 - t) <= b <= a (2 - t) / t``, so a segment meets only the templates
  that a table lists for its size, and segments beyond every template's reach meet none;
* a segment that reaches t shares more bigrams with a template than the template has without one of ``MARKERS``, so a
  segment without any marker word is dropped before it is normalised.

Defined cases: null and empty texts have no segments; a segment of one word has no bigram and matches nothing; the best
template wins, of equal ones the first by name; repeated rows give repeated rows; texts are scanned whole.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least Dice coefficient of a match.
THRESHOLD = 0.8

#: Words too frequent in prose to be markers.
COMMON = set("a all an and any are at be but by for from in is it not of on or that the this to under was with you".split())

# Wording of public licences and of their usual notices.
NOTICES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "Released under CC0 1.0 Universal.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
             "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = ["AGPL-3.0-only", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "MIT", "MPL-2.0"]


def templates() -> list[tuple[str, str]]:
    """``(licence, wording)`` in order of name."""
    out = [(name, text) for name, texts in NOTICES.items() for text in texts]
    for kind, words in _CC_KINDS.items():
        out += [(f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0."),
                (f"CC-{kind}-4.0", f"This work is licensed under a Creative Commons {words} 4.0 International License.")]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in _SPDX]
    return sorted(out)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def markers(all_bigrams: list[list[str]], threshold: float) -> list[str]:
    """Words such that every segment that reaches the threshold with a template has one of them.

    A match shares at least ``t m / (2 - t)`` of a template's m bigrams, so at most that many less one may be without a
    marker. Words are added greedily until that holds for every template.
    """
    chosen: list[str] = []
    while True:
        short = []
        for bigrams in all_bigrams:
            bare = [b for b in bigrams if not any(w in b.split() for w in chosen)]
            if len(bare) >= math.ceil(threshold * len(bigrams) / (2 - threshold)):
                short.append(bare)
        if not short:
            return sorted(chosen)
        gain: dict[str, int] = {}
        for bare in short:
            for word in {w for b in bare for w in b.split() if len(w) > 1} - COMMON:
                gain[word] = gain.get(word, 0) + sum(word in b.split() for b in bare)
        # Long words are rarer in prose, so a short one must gain much more.
        chosen.append(max(sorted(gain), key=lambda w: gain[w] * len(w) ** 2))


_ALL = templates()
_BIGRAMS = [bigrams_of(text) for _, text in _ALL]
MARKERS = markers(_BIGRAMS, THRESHOLD)


def reach(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Least and most bigrams of a segment that can reach the threshold with a template of the given size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


LEAST_SIZE = min(reach(len(b))[0] for b in _BIGRAMS)
MOST_SIZE = max(reach(len(b))[1] for b in _BIGRAMS)
MARKER_PATTERN = "(?i)(?<![a-z0-9])(?:" + "|".join(MARKERS) + ")(?![a-z0-9])"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _by_size() -> Column:
    """For each number of bigrams the templates within reach, as positions from 1."""
    listed = []
    for size in range(MOST_SIZE + 1):
        near = [i + 1 for i, b in enumerate(_BIGRAMS) if reach(len(b))[0] <= size <= reach(len(b))[1]]
        listed.append(F.array(*map(F.lit, near)) if near else F.array().cast("array<int>"))
    return F.array(*listed)


def segments(text: Column) -> Column:
    """Lines, and paragraphs of more than one line, that have a marker word."""
    lines = F.split(text, "\n")
    paragraphs = F.filter(F.split(text, "\n[ \\t\\r]*\n"), lambda p: F.trim(F.regexp_replace(p, "^\\s+|\\s+$", "")).contains("\n"))
    return F.filter(F.concat(lines, paragraphs), lambda s: s.rlike(MARKER_PATTERN))


def segment_bigrams(segment: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(segment), "[^a-z0-9]+", " ")), " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``matches``: for each matching segment ``dice, licence, template, segment``, best first.

    Bigrams, sizes and candidate lists are set up once a row, so a text without a marker costs one pattern search.
    """
    has_marker = F.coalesce(F.col("text").rlike(MARKER_PATTERN), F.lit(False))
    found = F.when(has_marker, segments(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(*keep, F.transform(found, lambda s: F.struct(s.alias("segment"), segment_bigrams(s).alias("bigrams"))).alias("__found"))
    names = _strings([name for name, _ in _ALL])
    all_bigrams = F.array(*map(_strings, _BIGRAMS))
    by_size = _by_size()

    def best(segment: Column) -> Column:
        bigrams = segment["bigrams"]
        size = F.size(bigrams)
        near = F.when(size <= MOST_SIZE, F.element_at(by_size, size + 1)).otherwise(F.array().cast("array<int>"))
        scored = F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(bigrams, F.element_at(all_bigrams, t))) / (size + F.size(F.element_at(all_bigrams, t)))).alias("dice"),
            (-t).alias("order")))
        top = F.array_max(F.filter(scored, lambda s: s["dice"] >= THRESHOLD))
        return F.struct(top["dice"].alias("dice"), top["order"].alias("order"), segment["segment"].alias("segment"))

    tops = F.filter(F.transform("__found", best), lambda m: m["dice"].isNotNull())
    named = F.transform(F.sort_array(tops, asc=False), lambda m: F.struct(
        m["dice"].alias("dice"), F.element_at(names, -m["order"]).alias("licence"), (-m["order"]).alias("template"), m["segment"].alias("segment")))
    return rows.select(*keep, named.alias("matches"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: how many segments match, the licences found, and the best match's licence and coefficient."""
    done = scan(docs, ["doc_id"])
    return done.select(
        "doc_id", F.size("matches").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.licence")), ",").alias("licences"),
        F.try_element_at("matches", F.lit(1))["licence"].alias("best_licence"),
        F.round(F.try_element_at("matches", F.lit(1))["dice"], 6).alias("best_dice"))


def oracle() -> str:
    """The same result by joins over unnested segments and bigrams, without the bounds."""
    rows = ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(_ALL, 1))

    def words(column: str) -> str:
        return f"string_split(trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g')), ' ') AS w"

    pairs = "list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2])) AS b"
    return f"""
WITH template(t, licence, wording) AS (VALUES {rows}),
tb AS (SELECT t, licence, {pairs} FROM (SELECT t, licence, {words('wording')} FROM template)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
piece AS (
  SELECT r, unnest(string_split(text, chr(10))) AS s FROM doc
  UNION ALL
  SELECT r, s FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS s FROM doc)
  WHERE contains(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), chr(10))),
kept AS MATERIALIZED (SELECT r, row_number() OVER () AS p, {words('s')} FROM piece),
pb AS MATERIALIZED (SELECT r, p, {pairs} FROM kept WHERE len(w) > 1),
hit AS (
  SELECT p, any_value(r) AS r, t, count(*) AS shared FROM (SELECT r, p, unnest(b) AS g FROM pb) JOIN (SELECT t, unnest(b) AS g FROM tb) USING (g) GROUP BY p, t),
scored AS (
  SELECT hit.r, hit.p, tb.t, tb.licence, 2.0 * shared / (len(pb.b) + len(tb.b)) AS dice FROM hit JOIN pb USING (p) JOIN tb USING (t)),
best AS (
  SELECT r, p, arg_min(licence, t) AS licence, min(t) AS t, any_value(dice) AS dice
  FROM (SELECT *, max(dice) OVER (PARTITION BY p) AS top FROM scored WHERE dice >= {THRESHOLD}) WHERE dice = top GROUP BY r, p),
whole AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences,
         first(licence ORDER BY dice DESC, t) AS best_licence, max(dice) AS best_dice FROM best GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_matches, coalesce(licences, '') AS licences, best_licence, round(best_dice, 6) AS best_dice
FROM doc LEFT JOIN whole USING (r)
"""
