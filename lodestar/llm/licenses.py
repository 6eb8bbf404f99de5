"""License scans by diagonal voting. DataFrame functions only.

All rolling word k-gram hashes of a text are joined to the positions that the templates have them at. A match of text word i
with template word j votes for the diagonal i - j; neighbouring diagonals are merged (a word put in or left out moves the
diagonal by one), and a merged span is verified: its k-grams, compared as text, must cover enough of the template in a
span not much longer than the template. Of spans that overlap the one that covers its template best wins, so that texts which
share most of their words (versions, lesser and affero forms) are told apart by the rest. Before rows are exploded for the
join, a blocked Bloom filter of the templates' hashes drops grams that no template has: what is shuffled are matches and a
few false ones, which the join removes. The templates are a table of any size. Fixed phrases are found beside that, by their
words.

Defined cases: a null or empty text has no words and no labels, score 0; repeated rows (equal id and text) get equal
results; very long texts are scanned whole; an empty table gives an empty result. Added columns replace input columns of the
same names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bloom, bloom_blocks, bloom_hit, literals, materialize, small, table

K = 4
GAP = 3  # neighbouring diagonals differ by at most this
COVER = 0.6  # of the template's k-grams
STRETCH = 1.5  # span's words to template's words

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
_NO_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_CC = "This work is licensed under {article} Creative Commons {name} {version} International License"

#: Public license texts and notices, by label. Their words count, not case or punctuation.
TEMPLATES = {
    "mit-notice": ["Released under the MIT License"],
    "mit-text": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        _AS_IS + "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "boost": ["Distributed under the Boost Software License, Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "bsd": [_BSD, _BSD + _NO_WARRANTY],
    "bsd-3": [_BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _NO_WARRANTY],
    "apache-2-notice": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2", _FREE.format(name="General Public License", version="2")],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3", _FREE.format(name="General Public License", version="3")],
    "lgpl-2.1": [_FREE.format(name="Lesser General Public License", version="2.1"), _FREE.format(name="Lesser General Public License", version="2.1").replace("This program", "This library")],
    "lgpl-3": [_FREE.format(name="Lesser General Public License", version="3"), _FREE.format(name="Lesser General Public License", version="3").replace("This program", "This library")],
    "agpl-3": [_FREE.format(name="Affero General Public License", version="3")],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by": [_CC.format(article="a", name="Attribution", version="4.0")],
    "cc-by-sa": [_CC.format(article="a", name="Attribution-ShareAlike", version="4.0")],
    "cc-by-nc": [_CC.format(article="a", name="Attribution-NonCommercial", version="4.0")],
    "cc-by-nd": [_CC.format(article="a", name="Attribution-NoDerivatives", version="4.0")],
    "cc-by-nc-sa": [_CC.format(article="a", name="Attribution-NonCommercial-ShareAlike", version="4.0")],
}

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased text
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of the text as it is


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATOR, -1), lambda w: w != "")


def template_grams(spark: SparkSession, templates: Mapping[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """(label, template, grams, size, j, gram, h): one row a k-gram of a template."""
    rows = [(label, f"{label}#{n}", text) for label, texts in templates.items() for n, text in enumerate(texts)]
    t = literals(spark, rows, "label string, template string, text string").withColumn("w", words_of(F.col("text"))).filter(F.size("w") >= k)
    t = t.select("label", "template", F.size("w").alias("size"), (F.size("w") - k + 1).alias("grams"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, k), " "))).alias("j", "gram"))
    return t.withColumn("h", F.xxhash64("gram"))


def phrase_places(words: str, text: Column, phrases: Mapping[str, str] = PHRASES) -> Column:
    """array<struct<at, label>> of the places where phrases stand; texts that lack their words in a row are not looked at."""
    conditions = []
    for phrase, label in phrases.items():
        ws = phrase.split()
        conditions.append((" AND ".join(f"{words}[i + {n}] = '{w}'" if n else f"{words}[i] = '{w}'" for n, w in enumerate(ws)), len(ws), label))
    gate = "(?i)" + "|".join(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+".join(p.split()) for p in phrases)
    one = [f"CASE WHEN size({words}) >= {n} THEN transform(filter(sequence(0, size({words}) - {n}), i -> {c}), i -> struct(i AS at, '{label}' AS label)) ELSE array() END" for c, n, label in conditions]
    empty = "CAST(array() AS array<struct<at: int, label: string>>)"
    return F.when(text.rlike(gate), F.expr(f"array_sort(concat({empty}, {', '.join(one)}))")).otherwise(F.expr(empty))


def matches(words: str, blocks: int, filter_: str, k: int = K) -> Column:
    """array<struct<at, gram>> of the rolling k-grams whose hash the Bloom filter lets pass."""
    gram = f"concat_ws(' ', {', '.join(f'{words}[i + {n}]' if n else f'{words}[i]' for n in range(k))})"
    hit = bloom_hit(f"xxhash64({gram})", filter_, blocks)
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(filter(sequence(0, size({words}) - {k}), i -> {hit}), i -> struct(i AS at, {gram} AS gram)) ELSE CAST(array() AS array<struct<at: int, gram: string>>) END")


def scan(docs: DataFrame, templates: Mapping[str, list[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """(doc_id, text_hash) rows with n_words, places (of phrases) and spans (of templates: label, first, last, score), one a row of docs."""
    grams = template_grams(docs.sparkSession, templates)
    hashes = grams.select("h").distinct()
    blocks = bloom_blocks(hashes.count())
    words = materialize(bloom(hashes, "h", blocks), "license-filter")
    rows = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    rows = rows.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(RAW_WORD)), F.lit(0)).cast("long")).withColumn("w", words_of(F.col("text"))).withColumn("filter_", words.scalar())
    read = materialize(rows.select("doc_id", "text_hash", "n_words", phrase_places("w", F.col("text"), phrases).alias("places"), matches("w", blocks, "filter_").alias("matches")), "license-matches")
    votes = read.select("doc_id", "text_hash", F.explode("matches").alias("m")).select("doc_id", "text_hash", "m.at", "m.gram").withColumn("h", F.xxhash64("gram"))
    # joined by hash, verified by text
    hit = votes.join(small(grams.withColumnRenamed("gram", "own_gram")), "h").filter("gram = own_gram").withColumn("diagonal", F.col("at") - F.col("j"))
    key = ["doc_id", "text_hash", "label", "template"]
    diagonals = hit.groupBy(*key, "size", "grams", "diagonal").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("j").alias("js"))
    by = Window.partitionBy(*key).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > GAP).cast("int"), F.lit(0))
    merged = diagonals.withColumn("apart", apart).withColumn("band", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy(*key, "size", "grams", "band").agg(F.min("first").alias("first"), (F.max("last") + K - 1).alias("last"), (F.size(F.array_distinct(F.flatten(F.collect_list("js")))) / F.col("grams")).alias("score"))
    good = spans.filter((F.col("score") >= COVER) & (F.col("last") - F.col("first") + 1 <= STRETCH * F.col("size")))
    # spans that overlap are a cluster, of which the best covered template wins, then the longest
    along = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last", "template")
    apart = good.withColumn("apart", F.coalesce((F.col("first") > F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0)))
    clusters = apart.withColumn("cluster", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("label", "first", "last", "score"), F.struct("score", "grams", "label")).alias("b")
    good = clusters.groupBy("doc_id", "text_hash", "cluster").agg(best).select("doc_id", "text_hash", "b.*")
    found = good.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("label", "first", "last", "score")).alias("spans"))
    found = found.withColumnRenamed("doc_id", "f_id").withColumnRenamed("text_hash", "f_hash")
    joined = read.join(found, read["doc_id"].eqNullSafe(found["f_id"]) & read["text_hash"].eqNullSafe(found["f_hash"]), "left")
    return joined.select("doc_id", "text_hash", "n_words", "places", F.coalesce("spans", F.expr("CAST(array() AS array<struct<label: string, first: int, last: int, score: double>>)")).alias("spans"))


def op8_licenses(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    labels = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*a))), ",")
    base, own = F.transform("places", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    at = F.transform("places", lambda p: p["at"])
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(base, own).alias("labels"), score.alias("score"))
