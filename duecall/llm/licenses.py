"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them. DataFrame functions only.

Texts and templates become words: lower case, parted by whatever is neither letter nor
digit. A shingle has ``WIDTH`` words; a shorter template is one shingle of its own width.
For templates of s shingles a text's windows have 2 s shingles and begin every s, so any
s shingles in a row lie in one window whole. A template held with at least
``CONTAINED`` % of its shingles has a Jaccard similarity of 0.36 or more with such a window;
with ``BANDS`` bands of one row the chance of meeting in a band is 1 - (1 - 0.36)^24 > 0.9999.

The templates' bands are a table: (width, shingle, template, bands), one row for each
shingle that is a template's least in some band. A window meets a template in a band only
if it holds that shingle, so the texts' shingles are joined to the table (a broadcast: its
size is that of the templates, which are a parameter, and not of the data). Each shingle met names its
two windows; where the window's least hash of the band is the template's, the pair is
retrieved. Each retrieved pair is verified: the share of the template's distinct shingles
in the window. Texts that hold no anchor, the longest word of each shingle in the table, hold
none of these shingles and are passed over; that changes no result. Texts are worked in blocks of ``BLOCK``
shingles, written with as many around them as a window reaches, so no row grows with its text.

A null text has no windows, nor has one with fewer words than a shingle. Rows of equal text
have equal results, each its own; ties between windows go to the first. An empty table gives no rows, and no
templates give no matches. Extra columns pass through, whatever their names; one named licenses is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import documents, let, packed, unpacked, written

WIDTH, BANDS, CONTAINED = 5, 24, 80
#: Shingles of a text that are worked in one row.
BLOCK = 1024

# The wording of public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}


@dataclass(frozen=True)
class Template:
    name: str
    width: int
    size: int
    shingles: tuple[int, ...]
    bands: tuple[tuple[int, tuple[int, ...]], ...]
    anchors: tuple[str, ...]


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(found: Column, width: int) -> Column:
    """The hashed shingles of an array of words, in order; empty if it is too short."""
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    some = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))))
    return F.when(F.size(found) >= width, some).otherwise(F.array().cast("array<long>"))


#: A hash function is the shingle's hash xor one of these; its least value over a window picks one shingle at random.
SALTS = tuple(np.array([xxhash.xxh64_intdigest(b"band%d" % k) for k in range(BANDS)], np.uint64).view(np.int64).tolist())


def templates(spark: SparkSession, texts: dict[str, str]) -> list[Template]:
    """The templates are a parameter, so the driver holds them; their words and shingles are made as the texts' are."""
    if not texts:
        return []
    frame = spark.createDataFrame(list(texts.items()), "name string, text string").select("name", normal_words(F.col("text")).alias("w"))
    by_width = [F.when(F.size("w") >= k if k == WIDTH else F.size("w") == k, shingles(F.col("w"), k)) for k in range(1, WIDTH + 1)]
    out = []
    for name, words, found in frame.select("name", "w", F.coalesce(*by_width)).collect():
        if not words:
            continue
        width = min(WIDTH, len(words))
        bands: dict[int, list[int]] = {}
        for salt in SALTS:
            bands.setdefault(min(found, key=lambda x: x ^ salt), []).append(salt)
        anchors = tuple(max(words[found.index(x) : found.index(x) + width], key=len) for x in bands)
        out.append(Template(name, width, len(found), tuple(dict.fromkeys(found)), tuple((x, tuple(s)) for x, s in bands.items()), anchors))
    return out


BAND_TABLE = "shingle long, license string, size int, salts array<long>, held array<long>"


def blocks(found: DataFrame, known: list[Template], width: int) -> DataFrame:
    """(key, base, n, h) of (key, w): BLOCK shingles from base on, with as many around them as a window
    may reach, where one of them is in the band table; n is the text's number of shingles."""
    reach = 2 * max(t.size for t in known)
    from_ = lambda b: F.greatest(b - reach, F.lit(0))
    block = lambda h, b: F.struct(b.alias("base"), F.size(h).alias("n"), F.slice(h, from_(b) + 1, b - from_(b) + BLOCK + reach).alias("h"))
    cut = let(shingles(F.col("w"), width), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: block(h, b)))
    rows = found.select("key", F.lit(width).alias("width"), F.inline(cut))
    core = F.slice("h", F.col("base") - from_(F.col("base")) + 1, F.lit(BLOCK))
    known_shingles = F.array(*(F.lit(x) for x in sorted({x for t in known for x, _ in t.bands})))
    return rows.filter(F.arrays_overlap(core, known_shingles)).select("key", "width", "base", "n", "h", core.alias("core"), from_(F.col("base")).alias("from"))


def retrieved(rows: DataFrame, known: list[Template]) -> DataFrame:
    """(key, license, at, containment) of the windows of blocks that meet a template of their width in a band and hold it."""
    table = rows.sparkSession.createDataFrame([(x, t.name, t.size, list(s), list(t.shingles)) for t in known for x, s in t.bands], BAND_TABLE)
    rows = rows.select("key", "base", "n", "h", "from", F.posexplode("core").alias("i", "shingle")).join(F.broadcast(table), "shingle")
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("size")).cast("int") - 1) - 1
    block = F.floor((F.col("base") + F.col("i")) / F.col("size")).cast("int")
    rows = rows.select("*", F.explode(F.filter(F.array(block - 1, block), lambda j: (j >= 0) & (j <= last))).alias("j"))
    at = F.col("j") * F.col("size")
    rows = rows.select("key", "license", "salts", "held", "shingle", at.alias("at"), F.slice("h", at - F.col("from") + 1, 2 * F.col("size")).alias("window"))
    least = lambda s: F.array_min(F.transform("window", lambda x: x.bitwiseXOR(s)))
    met = rows.filter(F.exists("salts", lambda s: least(s) == F.col("shingle").bitwiseXOR(s)))
    share = F.size(F.array_intersect("window", "held")) * 100.0 / F.size("held")
    return met.select("key", "license", "at", share.alias("containment")).filter(F.col("containment") >= CONTAINED)


NONE = "array<struct<license:string,at:int,containment:double>>"


def scanned(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """docs with a column ``licenses``: array<struct(license, at, containment)>, at being the window's first word.

    Matches are found by text, aggregated and written, so the join back can split the
    partition of a text that very many rows hold.
    """
    known = templates(docs.sparkSession, TEMPLATES if texts is None else texts)
    none = F.array().cast(NONE)
    key = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    if not known:
        return unpacked(packed(docs), docs.columns, licenses=none)
    anchors = F.array(*map(F.lit, sorted({a for t in known for a in t.anchors})))
    found = docs.select(key.alias("key"), normal_words(F.col("text")).alias("w")).filter(F.arrays_overlap("w", anchors))
    by_width = {k: [t for t in known if t.width == k] for k in sorted({t.width for t in known})}
    rows = written(reduce(DataFrame.union, (blocks(found, own, k) for k, own in by_width.items())), "license-blocks")
    every = reduce(DataFrame.union, (retrieved(rows.filter(F.col("width") == k), own) for k, own in by_width.items()))
    every = every.groupBy("key", "license", "at").agg(F.max("containment").alias("containment"))
    own = F.sort_array(F.collect_list(F.struct("license", "at", "containment"))).cast(NONE)
    matches = written(every.groupBy("key").agg(own.alias("found")), "matches")
    rows = packed(docs, k=key).join(matches, F.col("k") == F.col("key"), "left")
    return unpacked(rows, docs.columns, licenses=F.coalesce("found", none))


def per_document(docs: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licenses): each license once with its first window and greatest containment, by name."""
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda m: m["license"])))

    def line(name: Column) -> Column:
        own = F.filter("licenses", lambda m: m["license"] == name)
        return F.concat(name, F.lit("@"), F.array_min(F.transform(own, lambda m: m["at"])).cast("string"), F.lit(":"), F.round(F.array_max(F.transform(own, lambda m: m["containment"]))).cast("int").cast("string"))

    return docs.select("doc_id", F.size("licenses").cast("long").alias("n_matches"), F.array_join(F.transform(names, line), ",").alias("licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(scanned(documents(spark, sf_dir).select("doc_id", "text")))


def oracle() -> str:
    """Exact containment of every window, without bands; the templates enter as SQL text."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    return rf"""
WITH t0 AS (SELECT name, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM (VALUES {values}) v(name, t)),
t1 AS (SELECT name, least(5, len(w)) AS k, w FROM t0),
t2 AS (SELECT DISTINCT name, k, len(w) - k + 1 AS s, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM t1),
tn AS (SELECT name, k, s, count(*) AS n FROM t2 GROUP BY ALL),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, k, len(w) - k + 1 AS m, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g, unnest(range(len(w) - k + 1)) AS i
      FROM d, (SELECT DISTINCT k FROM tn) WHERE len(w) >= k),
h AS (SELECT doc_id, t2.name, t2.s, m, i, t2.g FROM g JOIN t2 ON g.g = t2.g AND g.k = t2.k),
j AS (SELECT doc_id, name, g, jj FROM (SELECT doc_id, name, g, s, m, unnest([i // s, i // s - 1]) AS jj FROM h) WHERE jj >= 0 AND jj <= greatest(1, ceil(m / s)::INT - 1) - 1),
c AS (SELECT doc_id, name, jj * s AS at_, count(DISTINCT g) * 100.0::DOUBLE / n AS share FROM j JOIN tn USING (name) GROUP BY doc_id, name, jj, s, n HAVING count(DISTINCT g) * 100 >= 80 * n),
l AS (SELECT doc_id, name, count(*) AS n, name || '@' || min(at_) || ':' || round(max(share))::INT AS line FROM c GROUP BY doc_id, name)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_matches, coalesce(string_agg(line, ',' ORDER BY name), '') AS licenses FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id
"""
