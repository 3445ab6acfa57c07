"""Licence scans: passages of a text against templates of licence notices by Dice's coefficient over word bigrams.

A text's passages are its lines, its paragraphs (between empty lines) and itself, which is what the query's SQL compares. With `windows`,
which the query leaves off since its SQL has none, also stretches of as many words as a template has, wherever they stand: a notice
within prose, or wrapped over the lines of a comment, is found. WHOLE has whole licence texts, to be given as templates beside the notices; with
`without_copyright` the lines of a text that name a copyright's holder are no part of what is compared. Text and templates are normalised:
lower case, words of letters and digits, `licence` as `license`. The coefficient of
two sets of bigrams is 2 |A and B| / (|A| + |B|); it can reach t only if |A| lies between |B| t / (2 - t) and |B| (2 - t) / t,
so a passage meets only the templates whose sizes are within these bounds, and of those only the ones that hold one of its bigrams.

Before lines are cut, a text is passed by if it can't match: a passage that reaches t shares at least |B| t / (2 - t) of a
template's bigrams, so of any |B| - that + 1 of them it holds one, and the text holds that one's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, text_udf

#: Short notices and opening passages of public licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Clauses that several licences share, and whole texts without their copyright lines, by SPDX identifier.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
ZLIB_TERMS = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
MIT_KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_notice = {name: text for name, text in TEMPLATES}  # the last of a name
WHOLE = (
    ("MIT", f"{_notice['MIT']} {MIT_KEEP} {AS_IS}"),
    ("ISC", f"{_notice['ISC']} {ISC_AS_IS}"),
    ("BSD-2-Clause", f"{BSD_TERMS} {BSD_AS_IS}"),
    ("BSD-3-Clause", f"{BSD_TERMS} {BSD_THIRD} {BSD_AS_IS}"),
    ("Zlib", f"{_notice['Zlib']} {ZLIB_TERMS}"),
)
#: Lines that name the holder of a copyright, behind whatever leads a comment.
COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright\b(?=[^\n]*(?:\d{4}|\(c\)|©))|\(c\)\s*\d{4}|©|all rights reserved)[^\n]*$", re.I | re.M)
WORDS = re.compile(r"[a-z0-9]+")
LETTERS = re.compile(r"[A-Za-z0-9]+")
THRESHOLD = 0.8


def words(text: str) -> list[str]:
    """Lower-case words of ASCII letters and digits; licence reads license."""
    return WORDS.findall(text.lower().replace("licence", "license"))


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    w = words(text)
    return frozenset(zip(w, w[1:]))


class Index:
    """Templates by bigram, and the words without one of which no passage matches."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        self.t, self.names = threshold, [n for n, _ in templates]
        self.grams = [bigrams(t) for _, t in templates]
        self.lengths = [len(words(t)) for _, t in templates]
        if not all(self.grams):
            raise ValueError("a template needs two words at least")
        slack = 1e-9  # so that rounding never prunes a passage that lies on a bound
        self.low, self.high = threshold / (2 - threshold) * (1 - slack), (2 - threshold) / threshold * (1 + slack)
        self.least = min(len(g) for g in self.grams) * self.low
        self.by_gram: dict[tuple[str, str], list[int]] = {}
        for k, g in enumerate(self.grams):
            for x in g:
                self.by_gram.setdefault(x, []).append(k)
        self.needles: set[str] = set()
        for g in self.grams:
            # of this many bigrams a match holds one; those with the longest rare words are looked for
            n = len(g) - max(1, ceil(len(g) * self.low)) + 1
            ordered = sorted(g, key=lambda x: (-max(map(len, x)), x))
            self.needles |= {max(x, key=lambda w: (len(w), w)) for x in ordered[: max(1, n)]}
        self.sieve = re.compile("(?:" + "|".join(sorted({w.replace("license", "licen[cs]e") for w in self.needles}, key=lambda w: (-len(w), w))) + ")(?![a-z0-9])")

    def may_match(self, text: str) -> bool:
        low = text.lower()
        return any(m.start() == 0 or not (low[m.start() - 1].isascii() and low[m.start() - 1].isalnum()) for m in self.sieve.finditer(low))

    def best(self, passage: str) -> tuple[float, str] | None:
        """The largest coefficient at the threshold or above and its licence, the first of the templates among equals."""
        own = bigrams(passage)
        if len(own) < self.least:
            return None
        shared: dict[int, int] = {}
        for x in own:
            for k in self.by_gram.get(x, ()):
                shared[k] = shared.get(k, 0) + 1
        best = None
        for k in sorted(shared):
            size = len(self.grams[k])
            if size * self.low <= len(own) <= size * self.high and (d := 2 * shared[k] / (size + len(own))) >= self.t and (best is None or d > best[0]):
                best = d, self.names[k]
        return best

    def windows(self, text: str, without_copyright: bool = False) -> Iterator[tuple[str, float, int, int]]:
        """For each template the stretches that match it: windows of its number of words that begin at one of its bigrams, up to the last of its bigrams within."""
        read = unclaimed(text) if without_copyright else text
        place = [(m[0].lower(), *m.span()) for m in LETTERS.finditer(read)]
        # British spelling as words() reads it
        own = [w.replace("licence", "license") for w, _, _ in place]
        hits: dict[int, list[int]] = {}
        for i, x in enumerate(zip(own, own[1:])):
            for k in self.by_gram.get(x, ()):
                hits.setdefault(k, []).append(i)
        for k, at in hits.items():
            size, need = len(self.grams[k]), len(self.grams[k]) * self.low
            inside: dict[tuple[str, str], int] = {}
            every: dict[tuple[str, str], int] = {}
            last = end = 0  # the next hit and the next bigram to come in
            for first, i in enumerate(at):
                while last < len(at) and at[last] < i + self.lengths[k] - 1:
                    x = own[at[last]], own[at[last] + 1]
                    inside[x] = inside.get(x, 0) + 1
                    last += 1
                end = max(end, i)
                stop = at[last - 1] + 1
                while end < stop:
                    x = own[end], own[end + 1]
                    every[x] = every.get(x, 0) + 1
                    end += 1
                if len(inside) >= need and (d := 2 * len(inside) / (size + len(every))) >= self.t:
                    yield self.names[k], d, place[i][1], place[at[last - 1] + 1][2]
                for j in range(i, min(end, at[first + 1]) if first + 1 < len(at) else end):
                    x = own[j], own[j + 1]
                    every[x] -= 1
                    if not every[x]:
                        del every[x]
                x = own[i], own[i + 1]
                inside[x] -= 1
                if not inside[x]:
                    del inside[x]

    def scan(self, text: str | None, windows: bool = False, without_copyright: bool = False) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, start, end) of each passage (and window) that matches, by place; of passages within each other the best, and of equals the longest."""
        if not text or not self.may_match(text):
            return []
        found = []
        read = unclaimed(text) if without_copyright else text
        for a, b in passages(text):
            if hit := self.best(read[a:b]):
                found.append((hit[1], hit[0], a, b))
        if windows:
            found += self.windows(text, without_copyright)
        found.sort(key=lambda f: (-f[1], f[2] - f[3], f[2]))
        kept: list[tuple[str, float, int, int]] = []
        for f in found:
            if all(f[3] <= k[2] or k[3] <= f[2] for k in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[2])


def unclaimed(text: str) -> str:
    """text with its copyright lines blank, so that every place keeps its number."""
    return COPYRIGHT.sub(lambda m: " " * len(m[0]), text)


def passages(text: str) -> Iterator[tuple[int, int]]:
    """Distinct spans of the lines, the paragraphs and the whole; code points, end exclusive."""
    spans, at, start = {(0, len(text)): None}, 0, 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            spans[at, end] = None
        else:
            if start < at:
                spans[start, at - 1] = None
            start = end + 1
        at = end + 1
    if start < len(text):
        spans[start, len(text)] = None
    yield from sorted(s for s in spans if s[0] < s[1])


@lru_cache(4)
def index(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Index:
    return Index(templates, threshold)


FOUND = "array<struct<license:string,dice:double,start:int,end:int>>"


def scan_udf(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False, without_copyright: bool = False):
    """A UDF: text to its licences, an array of (license, dice, start, end). Null and empty texts have none."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scan = index(templates, threshold).scan
        return lambda texts: pa.array([[dict(zip(("license", "dice", "start", "end"), f, strict=True)) for f in scan(t, windows, without_copyright)] for t in texts], kind)

    return text_udf(make, FOUND)


def scan(docs: DataFrame, text_col: str = "text", out: str = "licenses", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False, without_copyright: bool = False) -> DataFrame:
    """docs with the licences found in its text added as `out`; with windows also those within lines and across them, without_copyright leaving out the lines that name holders."""
    return docs.withColumn(out, scan_udf(templates, threshold, windows, without_copyright)(F.col(text_col)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_found, license (of the best passage, the first among equals; null if none), dice (0 if none), licenses (name:start:end, comma-joined)."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses")
    top = F.array_max(F.transform("licenses", lambda x: F.struct(x["dice"].alias("dice"), (-x["start"]).alias("before"), x["license"].alias("license"))))
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_found"), top["license"].alias("license"), F.coalesce(top["dice"], F.lit(0.0)).alias("dice"), listed.alias("licenses"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: SQL for a text's normalised words and their distinct pairs.
WORDS_SQL = "regexp_extract_all(replace(lower({0}), 'licence', 'license'), '[a-z0-9]+')"
PAIRS_SQL = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP3_SQL = f"""
WITH RECURSIVE t AS (SELECT k, license, {PAIRS_SQL} AS g FROM (SELECT k, license, {WORDS_SQL.format("text")} AS w FROM (VALUES {", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))}) v(k, license, text))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
b AS (SELECT *, a + length(line) AS b, NOT regexp_matches(line, '\\S') AS blank FROM l),
c AS (SELECT *, sum(blank::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
s AS (SELECT r, a, b FROM c WHERE NOT blank UNION SELECT r, min(a), max(b) FROM c WHERE NOT blank GROUP BY r, run UNION SELECT r, 0, length(text) FROM d),
p AS (SELECT r, a, b, {PAIRS_SQL} AS g FROM (SELECT r, a, b, {WORDS_SQL.format("substring(text, (a + 1)::BIGINT, (b - a)::BIGINT)")} AS w FROM s JOIN d USING (r) WHERE a < b)),
m AS (SELECT r, a, b, k, license, 2 * len(list_intersect(p.g, t.g)) / (len(p.g) + len(t.g)) AS dice FROM p, t WHERE len(p.g) > 0),
best AS (SELECT r, a, b, max(dice) AS dice, arg_max(license, (dice, -k)) AS license FROM m WHERE dice >= {THRESHOLD} GROUP BY 1, 2, 3),
q AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, b - a DESC, a) AS n FROM best),
kept(r, n, spans) AS (SELECT DISTINCT r, 0::BIGINT, []::STRUCT(a BIGINT, b BIGINT)[] FROM q UNION ALL
  SELECT q.r, q.n, CASE WHEN len(list_filter(spans, lambda x: x.a < q.b AND q.a < x.b)) = 0 THEN list_append(spans, {{'a': q.a::BIGINT, 'b': q.b::BIGINT}}) ELSE spans END FROM kept JOIN q ON q.r = kept.r AND q.n = kept.n + 1),
f AS (SELECT best.* FROM (SELECT r, arg_max(spans, n) AS spans FROM kept GROUP BY r) k JOIN best USING (r) WHERE list_contains(k.spans, {{'a': best.a::BIGINT, 'b': best.b::BIGINT}})),
o AS (SELECT r, count(*) AS n_found, arg_max(license, (dice, -a, license)) AS license, max(dice) AS dice, string_agg(license || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a) AS licenses FROM f GROUP BY r)
SELECT doc_id, coalesce(n_found, 0) AS n_found, license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(licenses, '') AS licenses FROM d LEFT JOIN o USING (r)
"""
