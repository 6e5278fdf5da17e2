"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

A text's words are lower-cased runs of letters and digits; shingles are five words.

Bands.  A text is read in windows of 2 * PIECE shingles that start every PIECE, and a template in pieces of PIECE; a copy
of a piece lies whole in some window.  A band is one permutation of the shingles' hashes: its key is the least permuted
hash of the window or piece.  Windows' keys are joined with the table of the templates' keys, and a text that agrees with
a template on any band is its candidate.  Of a template copied with containment c some piece keeps at least c of its
shingles, so a window and that piece agree on a band with probability c / (3 - c) at least (their Jaccard similarity), and
all BANDS miss with probability (1 - c / (3 - c)) ** BANDS at most: 2e-5 for a whole copy, 1e-3 for c = 0.8, and less for
each further piece.  Templates of fewer shingles than PIECE have windows and pieces of one shingle, whose least hash is its hash:
enough of them are taken as pieces that a copy with the least containment holds one for certain.

Verification.  A candidate's text is read again and the template's shingles in it are counted, as text, in windows of
twice the template's length that start every length.

Defined results: null, empty and short texts match nothing; a template matches once a document, with its best containment
and first matching word; repeated rows of a doc_id are one document; templates of fewer than five words are refused;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: Shingles of a piece; windows hold twice as many.
PIECE = 16
BANDS = 16
#: Candidates that are broadcast to the second pass; more of them are shuffled.
BROADCAST_ROWS = 200_000
SPLIT = r"[^\p{L}\p{N}]+"

# Public licence notices and phrases.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
    " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met",
    "bsd-disclaimer": "This software is provided by the copyright holders and contributors as is and any express or implied warranties,"
    " including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions"
    " and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions"
    " and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of"
    " the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
    " without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY"
    " EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A"
    " PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
    " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
    " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN"
    " IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and"
    " accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit"
    " the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to"
    " do so, all subject to the following",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this"
    " work. This work is published under the Creative Commons CC0 1.0 Universal Public Domain Dedication",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
    " License as published by the Free Software Foundation",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General"
    " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General"
    " Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
    " granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit-line": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
    " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,"
    " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished"
    " to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all"
    " copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
    " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
    " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
    " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any"
    " damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including"
    " commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this"
    " software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a"
    " product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must"
    " be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or"
    " altered from any source distribution.",
}


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), SPLIT, " ")), " ")


def places(n: Column, step: int = 1) -> Column:
    """0, step, 2 * step ... below n."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def hashes_of(words: Column) -> Column:
    """Hash of the shingle at each position of an array of words; each word is hashed once."""
    by_word = F.transform(words, lambda w: F.xxhash64(w))
    return let(by_word, lambda v: F.transform(places(F.size(v) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(v, i + 1, SHINGLE))))


def shingles_of(words: Column) -> Column:
    """The shingle at each position, as text."""
    return F.transform(places(F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where the optimiser copies the expression into a filter."""
    return F.get(F.transform(F.array(value), body), 0)


def mask(band: int) -> int:
    """What a band's permutation of the hashes is: they are uniform, so exclusive or with a number orders them anew."""
    x = (band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def least_keys(hashes: Column, starts: Column, size: int) -> Column:
    """Of each window of `size` hashes from a start, the least permuted hash in every band.

    A key tells its band, as the same hash is another key in each.
    """

    def keys(band: int) -> Column:
        permuted = F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask(band))))
        return let(permuted, lambda p: F.transform(starts, lambda at: F.array_min(F.slice(p, at + 1, size))))

    return F.concat(*[keys(band) for band in range(BANDS)])


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """license, shingles (distinct, as text), hashes, span (positions): a row a template, whatever the corpus."""
    table = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    table = table.select("license", words_of(F.col("text")).alias("words"))
    rows = table.select("license", F.array_distinct(shingles_of(F.col("words"))).alias("shingles"), hashes_of(F.col("words")).alias("hashes"))
    rows = rows.where(F.size("hashes") > 0).withColumn("span", F.size("hashes"))
    if rows.count() < len(templates):
        raise ValueError(f"templates of fewer than {SHINGLE} words: {sorted(set(templates) - {r.license for r in rows.select('license').collect()})}")
    return rows


def bands(table: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """key, license: the keys that retrieve a template, a few a piece."""
    distinct = F.array_sort(F.array_distinct("hashes"))
    spare = F.size(distinct) - F.ceil(F.size(distinct) * F.lit(min_containment)).cast("int")
    few = F.slice(distinct, 1, spare + 1)
    # The last piece ends with the template.
    starts = F.transform(places(F.ceil(F.col("span") / PIECE).cast("int")), lambda k: F.least(k * PIECE, F.col("span") - PIECE))
    keys = F.when(F.col("span") < PIECE, few).otherwise(least_keys(F.col("hashes"), starts, PIECE))
    return table.select("license", F.explode(keys).alias("key")).select("key", "license").distinct()


def candidates(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, licenses of the documents that agree with a template on a band."""
    windows = lambda h: F.transform(places(F.size(h), PIECE), lambda at: F.slice(h, at + 1, 2 * PIECE))
    rows = docs.select("doc_id", F.explode(let(words_of(common.text_of()), lambda w: let(hashes_of(w), windows))).alias("window"))
    # A row for each band, and one for each shingle by itself, so that the least of a window is an expression that Spark compiles.
    asked = F.array(*[F.struct(F.lit(mask(b)).alias("mask"), F.lit(None).cast("int").alias("at")) for b in range(BANDS)],
                    *[F.struct(F.lit(None).cast("long").alias("mask"), F.lit(at).alias("at")) for at in range(PIECE)])
    rows = rows.select("doc_id", "window", F.explode(asked).alias("ask"))
    least = F.least(*[F.get("window", F.lit(i)).bitwiseXOR(F.col("ask.mask")) for i in range(2 * PIECE)])
    # Places behind a text's last shingle have a key like any other: what it meets is verified.
    own = rows.select("doc_id", F.coalesce(F.get("window", F.col("ask.at")), least, F.lit(0)).alias("key"))
    # The templates' keys: BANDS a piece at most, whatever the corpus.
    met = own.join(F.broadcast(keys), "key").groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("n"))
    return met.groupBy("doc_id").agg(F.collect_list("license").alias("licenses"))  # as many as there are templates at most


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word of each document and template at or above min_containment."""
    table = template_table(docs.sparkSession, templates)
    docs = docs.select("doc_id", "text")
    found = common.written(candidates(docs, bands(table, min_containment)), "licenses").withColumnRenamed("doc_id", "__sw_id")
    few = found.count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(found) if few else found, F.col("doc_id").eqNullSafe(F.col("__sw_id")))
    rows = rows.select("doc_id", let(words_of(common.text_of()), shingles_of).alias("own"), F.explode("licenses").alias("license"))
    rows = rows.join(F.broadcast(table.drop("hashes")), "license")  # the given templates

    at = F.filter(places(F.size("own")), lambda i: F.array_contains("shingles", F.get("own", i)))
    rows = rows.select("doc_id", "license", "span", F.size("shingles").alias("n"), F.transform(at, lambda i: F.struct(i.alias("at"), F.get("own", i).alias("shingle"))).alias("hits"))
    number = lambda x: F.floor(x["at"] / F.col("span")).cast("int")
    windows = F.filter(F.array_distinct(F.flatten(F.transform("hits", lambda x: F.array(number(x), number(x) - 1)))), lambda w: w >= 0)
    rows = rows.select("*", F.explode(windows).alias("window"))
    start = F.col("window") * F.col("span")
    rows = rows.withColumn("inside", F.filter("hits", lambda x: (x["at"] >= start) & (x["at"] < start + 2 * F.col("span"))))
    share = F.size(F.array_distinct(F.transform("inside", lambda x: x["shingle"]))) / F.col("n")
    checked = rows.select("doc_id", "license", share.alias("containment"), F.array_min(F.transform("inside", lambda x: x["at"])).alias("at"))
    checked = checked.where(F.col("containment") >= min_containment)
    return checked.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))
