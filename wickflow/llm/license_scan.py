"""Licence scans: Dice coefficient over word bigrams between text units and licence templates, built-ins only.

A unit is a whole text, each of its lines, or a run of as many words as a template has that begins with one of the
template's bigrams, so licence files, notices of a line, and texts that are wrapped or stand inside others are all found.
Texts are normalised to lower-case words of letters and digits. Two sets of bigrams of sizes a and b have a Dice
coefficient of at most 2 min(a, b) / (a + b), so a template is compared only with units whose size lies
within bounds of its own, and only where enough of its bigrams stand close together; most texts have no such place.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

THRESHOLD = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"

# The notices by which texts name their licence, whole short licences, and openings of long ones.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide. This software is distributed without any warranty."
    ),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
        "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote "
        "the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-opening": (
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 "
        "through 9 of this document. \"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner "
        "that is granting the License."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details."
    ),
    "GPL-2.0-opening": (
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU "
        "General Public License is intended to guarantee your freedom to share and change free software--to make sure the "
        "software is free for all its users."
    ),
    "GPL-3.0-opening": (
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for "
        "most software and other practical works are designed to take away your freedom to share and change the works."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}
UNITS = ("text", "line", "run")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def template_bigrams(text: str) -> list[str]:
    tokens = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:])})


def bigram_hash(bigram: str) -> int:
    """The long that xxhash64 of both words gives in Spark."""
    seed = 42
    for word in bigram.split():
        seed = xxh64_intdigest(word, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of a bigram set that can reach the threshold with one of this size, without rounding."""
    t = Fraction(str(threshold))
    return math.ceil(size * t / (2 - t)), math.floor(size * (2 - t) / t)


def scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, license, unit, place, dice): for each row and template, the best unit that reaches the threshold.

    unit is text, line or run, and place the number of the line, or of the run's first word, from 0. Ties go to the text, then to
    lines, then runs, and to the first of them. Texts that name several licences give a row for each. Null, blank and
    one-word texts match nothing, nor does a template of one word. A null id is kept, repeated rows give their matches
    each, an empty table gives none; texts are read whole, and other columns are ignored.
    """
    found = {n: t for n, t in (TEMPLATES if templates is None else templates).items() if template_bigrams(t)}
    doc_id, text = docs[f"`{id_col}`"].cast("long"), F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    if not found:
        none = docs.select(doc_id.alias("doc_id"), *(F.lit("").alias(c) for c in ("license", "unit")), F.lit(0).alias("place"), F.lit(0.0).alias("dice"))
        return none.where("false")
    hashes = {n: sorted({bigram_hash(g) for g in template_bigrams(t)}) for n, t in found.items()}
    length = {n: len(template_words(t)) for n, t in found.items()}
    bounds = {n: size_bounds(len(h), threshold) for n, h in hashes.items()}
    every = sorted(set().union(*hashes.values()))

    def tokens(unit: Column) -> Column:
        return F.filter(F.split(F.lower(unit), NOT_WORD), lambda w: w != "")

    def bigrams(words: Column) -> Column:
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.xxhash64(a, b))
        return F.when(n > 1, pairs).otherwise(F.array().cast("array<long>"))

    # Each step is its own projection, as its column is used more than once.
    rows = docs.select(doc_id.alias("doc_id"), F.transform(F.split(text, "\n", -1), tokens).alias("lines"))
    rows = rows.select("doc_id", "lines", F.flatten("lines").alias("w")).select("doc_id", "lines", bigrams(F.col("w")).alias("h"))
    at = F.filter(F.transform("h", lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "lines", "h", at.alias("hits"))

    table = F.array(
        *(
            F.struct(
                F.lit(n).alias("name"),
                *(F.lit(v).alias(c) for c, v in (("low", bounds[n][0]), ("high", bounds[n][1]), ("words", length[n]), ("size", len(hashes[n])))),
                F.array(*map(F.lit, hashes[n])).alias("grams"),
            )
            for n in found
        )
    )

    def match(t: Column) -> Column:
        def scored(kind: int, place: Column, grams: Column) -> Column:
            """(minus, kind, place) of a unit of these bigrams, repeats included; minus is NULL where its size can't match."""
            dice = bind(
                F.array_distinct(grams),
                lambda g: F.when(
                    F.size(g).between(t["low"], t["high"]), 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["size"])
                ),
            )
            return F.struct((-dice).alias("minus"), F.lit(kind).alias("kind"), place.alias("place"))

        def best(mine: Column) -> Column:
            lines = F.filter(
                F.transform("lines", lambda ws, k: F.when(F.size(ws) > t["low"], scored(1, k, bigrams(ws)))), lambda u: u.isNotNull()
            )
            close = F.filter(
                F.transform(mine, lambda p, j: F.when(F.get(mine, j + t["low"] - 1) <= p + t["words"] - 2, p)), lambda p: p.isNotNull()
            )
            runs = F.transform(close, lambda p: scored(2, p, F.slice("h", p + 1, t["words"] - 1)))
            every_unit = F.concat(F.array(scored(0, F.lit(0), F.col("h"))), lines, runs)
            return F.array_min(F.filter(every_unit, lambda s: s["minus"] <= -threshold))

        mine = F.filter("hits", lambda i: F.array_contains(t["grams"], F.get("h", i)))
        distinct = F.size(F.array_distinct(F.transform(mine, lambda i: F.get("h", i))))
        return F.struct(t["name"].alias("license"), F.when(distinct >= t["low"], bind(mine, best)).alias("m"))

    # An outer explode, since a filter on the array would be pushed below and worked out twice.
    enough = F.size("hits") >= min(b[0] for b in bounds.values())
    tops = F.when(enough, F.filter(F.transform(table, match), lambda x: x["m"].isNotNull()))
    rows = rows.select("doc_id", F.explode_outer(tops).alias("top")).where("top is not null")
    names = F.array(*map(F.lit, UNITS))
    return rows.select("doc_id", "top.license", F.get(names, F.col("top.m.kind")).alias("unit"), F.col("top.m.place").alias("place"), (-F.col("top.m.minus")).alias("dice"))


def bind(value: Column, use) -> Column:
    """use(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, by unnesting units and bigrams."""
    rows = ", ".join(
        f"('{name}', '{g}', {len(grams)}, {len(template_words(t))})"
        for name, t in TEMPLATES.items()
        for grams in [template_bigrams(t)]
        for g in grams
    )
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return rf"""
WITH t(license, gram, n, words) AS (VALUES {rows}),
d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d),
u AS (
  SELECT doc_id, NULL AS lic, 0 AS kind, 0 AS pos, w FROM d
  UNION ALL
  SELECT doc_id, NULL, 1, pos, {words.format("x")} FROM (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS x FROM d)
  UNION ALL
  SELECT doc_id, license, 2, (i - 1)::INT, w[i : i + words - 1] FROM p JOIN t ON t.gram = w[i] || ' ' || w[i + 1]),
b AS (
  SELECT doc_id, lic, kind, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM u WHERE len(w) > 1),
g AS (SELECT doc_id, lic, kind, pos, len(grams) AS m, unnest(grams) AS gram FROM b),
s AS (
  SELECT doc_id, license, kind, pos, 2.0::DOUBLE * count(*) / (any_value(m) + any_value(n)) AS dice
  FROM g JOIN t ON g.gram = t.gram AND (lic IS NULL OR lic = license) GROUP BY doc_id, license, kind, pos),
r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, kind, pos) AS k
  FROM s WHERE dice >= {threshold})
SELECT doc_id, license, ['text', 'line', 'run'][kind + 1] AS unit, pos AS place, dice FROM r WHERE k = 1"""
