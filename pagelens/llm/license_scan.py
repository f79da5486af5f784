"""License scans by MinHash bands over overlapping text windows, in DataFrame functions alone.

Words are lower-cased runs of letters, digits and characters beyond ASCII; a shingle is five of them.  A template of T
shingles belongs to the size s, the least power of two from T on.  A text's windows of that size hold 2 s shingles (one
if s is 1) and start every s, so that each run of T shingles lies whole in one of them.

A window holds a template if it has at least 0.8 of the template's shingles, so their Jaccard similarity is at least
J = need / (2 s + T - need).  A band is one MinHash: the least shingle hash after an exclusive or with the band's
constant.  With k bands a window that holds the template misses all of them with probability (1 - J) ** k, and k is
chosen for each size so that this is at most ``MISS`` for every template of it.

A MinHash is the hash of a shingle, so a window that agrees with a template in a band holds a shingle that is one of
the template's MinHashes, its anchor.  One pass over the texts finds anchors; only windows around them get bands;
those that agree in a band are candidates, and these are compared shingle by shingle.  Anchors, band keys and
templates stand in tables of a bounded size.  Of the texts only those with anchors are shuffled: a bitmap of fixed size drops
the others as they are read.

Cases: a null or short text has no shingles and holds nothing; a template under five words is refused; templates of
equal shingles are all named; rows repeat as they are; a null doc_id is kept; an empty table of documents or templates
gives no finds; other columns are ignored.

The notices of the query are the sentences and passages by which texts commonly state a license; a work's own license
texts are given as ``templates``.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import settled
from .columns import bitmap, keyed, maybe_in, plain_words

WIDTH, PERCENT, MISS = 5, 80, 0.001
#: What may be scanned for at once, as it is sent to all tasks; more is to be scanned for in several calls.
MOST_TEMPLATES, MOST_SHINGLES = 2000, 500_000
# Notices by which texts state their license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MIT-disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)


def _hashes(words: Column, width: int) -> Column:
    """Hashes of the shingles of an array of word hashes."""
    none = F.array().cast("array<long>")
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(width))))).otherwise(none)


def _grams(words: Column, width: int) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.size(words) >= width, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.array_join(F.slice(words, i, width), " ")))).otherwise(none)


def constant(band: int) -> int:
    """The band's 64 bits, as a signed number; none are set for the first."""
    bits = band * 0x9E3779B97F4A7C15 % 2**64
    return bits - 2**64 if bits >= 2**63 else bits


def needed(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def held_by(side: int) -> int:
    """Shingles of a window: each run of ``side`` shingles lies whole in one of the windows."""
    return 1 if side == 1 else 2 * side


def bands_for(sizes: list[int], side: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """How many bands keep the chance of a miss at most ``miss`` for templates of these shingle counts."""
    worst = min(needed(n, percent) / (held_by(side) + n - needed(n, percent)) for n in sizes)
    return 1 if worst == 1 else math.ceil(math.log(miss) / math.log(1 - worst))


def _read(templates: DataFrame, width: int) -> list[tuple[int, str, list[int], list[str]]]:
    """(size, name, shingle hashes and shingles) of the templates."""
    words = templates.select(F.col("license").cast("string").alias("license"), plain_words(F.col("text").cast("string")).alias("w"))
    rows = words.select("license", F.array_distinct(_hashes(F.transform("w", lambda x: F.xxhash64(x)), width)).alias("h"), _grams(F.col("w"), width).alias("g")).distinct().limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES or sum(len(r.g) for r in rows) > MOST_SHINGLES or any(not r.g for r in rows):
        raise ValueError(f"at most {MOST_TEMPLATES} templates of {MOST_SHINGLES} shingles together, each of {width} words or more")
    return [(1 << (len(r.g) - 1).bit_length(), r.license, r.h, r.g) for r in sorted(rows)]


def find_licenses(docs: DataFrame, templates: DataFrame, width: int = WIDTH, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """doc_id and licenses (sorted names) of every row of docs."""
    spark, docs = docs.sparkSession, keyed(docs)
    names = F.array().cast("array<string>")
    known = _read(templates, width)
    if not known:
        return docs.select("doc_id", names.alias("licenses"))
    sizes = defaultdict(list)
    for side, _, _, g in known:
        sizes[side].append(len(g))
    count = {side: bands_for(n, side, percent, miss) for side, n in sizes.items()}
    keys = [(side, k, min(x ^ constant(k) for x in h), tid) for tid, (side, _, h, _) in enumerate(known) for k in range(count[side])]
    anchors = sorted({(key ^ constant(k), side) for side, k, key, _ in keys})
    # Of these four the sizes are bounded by MOST_TEMPLATES and MOST_SHINGLES.
    anchors = F.broadcast(spark.createDataFrame(anchors, "h long, side int"))
    bands = F.broadcast(spark.createDataFrame([(side, [constant(k) for k in range(n)]) for side, n in count.items()], "side int, constants array<long>"))
    keys = F.broadcast(spark.createDataFrame(keys, "side int, band int, key long, tid int"))
    held = F.broadcast(spark.createDataFrame([(tid, name, g) for tid, (_, name, _, g) in enumerate(known)], "tid int, license string, grams array<string>"))

    hashed = docs.where("text is not null").select("_id", "_k", F.transform(plain_words(F.col("text")), lambda x: F.xxhash64(x)).alias("each"))
    hashed = hashed.select("_id", "_k", _hashes(F.col("each"), width).alias("all"))
    # An outer explode, as no filter is then moved below the columns made here, where they would be made anew.
    met = hashed.select("_id", "_k", F.posexplode_outer("all").alias("pos", "h")).join(anchors, "h")
    first = F.floor(F.col("pos") / F.col("side")).cast("int")
    windows = F.when(F.col("side") == 1, F.array(first)).otherwise(F.filter(F.array(first, first - 1), lambda i: i >= 0))
    asked = met.select("_id", "_k", "side", F.explode(windows).alias("i")).groupBy("_id", "_k").agg(F.collect_set(F.struct("side", "i")).alias("asked"))
    asked = settled(asked)

    key = F.xxhash64("_id", "_k")
    texts = maybe_in(docs, key, bitmap(key, asked)).dropDuplicates(["_id", "_k"]).join(asked, ["_id", "_k"])
    texts = texts.select("_id", "_k", "asked", plain_words(F.col("text")).alias("w"))
    size = F.when(F.col("a.side") == 1, 1).otherwise(2 * F.col("a.side"))
    found = texts.select("_id", "_k", "w", F.explode_outer("asked").alias("a")).select("_id", "_k", "a.side", F.slice("w", F.col("a.i") * F.col("a.side") + 1, size + (width - 1)).alias("words"))
    found = found.select("*", _hashes(F.transform("words", lambda x: F.xxhash64(x)), width).alias("hashes")).join(bands, "side")
    least = F.transform("constants", lambda c: F.array_min(F.transform("hashes", lambda x: x.bitwiseXOR(c))))
    found = found.select("_id", "_k", "side", "words", F.posexplode_outer(least).alias("band", "key")).join(keys, ["side", "band", "key"])
    found = found.select("_id", "_k", "words", "tid").distinct().join(held, "tid")
    sure = F.size(F.array_intersect("grams", _grams(F.col("words"), width))) * 100 >= F.size("grams") * percent
    found = found.where(sure).groupBy("_id", "_k").agg(F.array_sort(F.collect_set("license")).alias("licenses"))
    return docs.select("doc_id", "_id", "_k").join(found, ["_id", "_k"], "left").select("doc_id", F.coalesce("licenses", names).alias("licenses"))


def license_report(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    if templates is None:
        templates = docs.sparkSession.createDataFrame(list(TEMPLATES), "license string, text string")
    return find_licenses(docs, templates).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))
