"""License scans by diagonal voting, in DataFrame operations only.

Words are runs of digits, a-z (A-Z lower-cased) and characters from U+0080. Base labels come from
phrases whose words stand consecutively. The method adds labels from template texts: the hashes of
all rolling k-word grams of a text are joined to the positions of the templates' grams (a few
thousand rows, fixed by the templates, so they are broadcast); hits vote for the diagonal text
position minus template position; neighbouring diagonals, as small edits shift them, are merged; a
merged span that holds enough of the template at enough density is verified word by word: a word of the
template counts where the text has it on one of the span's diagonals, and the share of such words
decides and is the score. Spans are joined back to the texts for that, as a broadcast table while they
are at most ``most_broadcast``.

Defined cases: a null or empty text has no words, no places, null first and last word, empty labels
and score 0; rows that repeat a doc_id and text get equal results; a null doc_id is a doc_id like any
other; texts shorter than k words have no grams; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices by which works name their license, as their publishers word them.
TEMPLATES = {
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text: Column) -> Column:
    """The words, lower-cased and joined by one space each."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP, " "))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def template_grams(spark: SparkSession, k: int, templates: dict[str, str]) -> DataFrame:
    """(h, label, tpos, grams): a row for each k-gram of each template."""
    rows = []
    for label, text in templates.items():
        w = _WORD.findall(text.translate(str.maketrans(_UPPER, _LOWER)))
        rows += [(label, i, len(w) - k + 1, *w[i : i + k]) for i in range(len(w) - k + 1)]
    names = [f"w{i}" for i in range(k)]
    df = spark.createDataFrame(rows, "label string, tpos int, grams int, " + ", ".join(f"{n} string" for n in names))
    return df.select(F.xxhash64(*names).alias("h"), "label", "tpos", "grams")


def _verified(words: DataFrame, spans: DataFrame, templates: dict[str, str], coverage: float, most_broadcast: int) -> DataFrame:
    """(doc_id, th, label, share) of the spans (doc_id, th, label, d1, d2: diagonals) of which enough
    words of the template stand in the text."""
    rows = [(label, _WORD.findall(text.translate(str.maketrans(_UPPER, _LOWER)))) for label, text in templates.items()]
    few = spans.count() <= most_broadcast
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("label", "d1", "d2")).alias("s"))
    spans = F.broadcast(spans) if few else spans
    once = words.alias("a").join(spans.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))).select("a.doc_id", "a.th", "w", F.explode("s").alias("s"))
    once = once.join(F.broadcast(spans.sparkSession.createDataFrame(rows, "tlabel string, tw array<string>")), F.col("s.label") == F.col("tlabel"))
    has = lambda t, i: F.exists(F.sequence("s.d1", "s.d2"), lambda d: (i + d >= 0) & F.get("w", i + d).eqNullSafe(t))
    share = F.size(F.filter("tw", has)) / F.size("tw")
    return once.select("doc_id", "th", F.col("s.label").alias("label"), share.alias("share")).where(F.col("share") >= coverage)


def scan(docs: DataFrame, k: int = 4, templates: dict[str, str] = TEMPLATES, coverage: float = 0.6, density: float = 0.5, drift: int = 3, most_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), plain_words(F.col("text")).alias("plain"))

    # Base: places of the phrases, counted where a text has any.
    n_words = F.when(F.col("plain") == "", F.lit(0)).otherwise(_spaces(F.col("plain")) + 1)
    base = keyed.select("doc_id", "th", n_words.cast("long").alias("n_words"), F.concat(F.lit(" "), "plain", F.lit(" ")).alias("padded"))
    found, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES.items():
        has = F.contains("padded", F.lit(f" {phrase} "))
        found.append(F.when(has, F.regexp_count("padded", F.lit(f"(?<= ){phrase}(?= )"))).otherwise(F.lit(0)))
        before = F.substring_index("padded", f" {phrase} ", 1)
        after = F.substring_index("padded", f" {phrase} ", -1)
        firsts.append(F.when(has, _spaces(before)))
        lasts.append(F.when(has, F.col("n_words") - _spaces(after) - len(phrase.split())))
        names.append(F.when(has, F.lit(label)))
    some = lambda cols, pick: pick(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    base = base.select(
        "doc_id", "th", "n_words", sum(found[1:], found[0]).cast("long").alias("n_base"), some(firsts, F.array_min).cast("long").alias("first_word"),
        some(lasts, F.array_max).cast("long").alias("last_word"), some(names, F.array_distinct).alias("own"),
    )

    # Method: grams, diagonals, spans.
    words = keyed.select("doc_id", "th", F.split("plain", " ").alias("w"))
    gram = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(k)]))
    grams = words.select("doc_id", "th", F.posexplode(F.when(F.size("w") >= k, gram)).alias("pos", "h"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, k, templates)), "h")
    hits = hits.select("doc_id", "th", "label", "grams", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    votes = hits.groupBy("doc_id", "th", "label", "grams", "diagonal").agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    line = Window.partitionBy("doc_id", "th", "label").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > drift) | F.lag("diagonal").over(line).isNull()
    merged = votes.withColumn("run", F.sum(apart.cast("int")).over(line)).groupBy("doc_id", "th", "label", "grams", "run")
    spans = merged.agg(F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("d1"), F.max("diagonal").alias("d2"))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    spans = spans.where((share >= coverage) & (F.col("votes") >= density * (F.col("hi") - F.col("lo") + 1)))
    spans = Workspace(docs.sparkSession, "license").keep(spans.select("doc_id", "th", "label", "d1", "d2"), "spans")
    labels = _verified(words, spans, templates, coverage, most_broadcast).groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    a, b = base.alias("a"), labels.alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left")
    empty = F.array().cast("array<string>")
    text_of = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.coalesce("b.share", F.lit(0.0)), F.when(F.col("a.n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return out.select(
        "a.doc_id", "n_words", "n_base", "first_word", "last_word", text_of(F.col("own")).alias("base_labels"),
        text_of(F.concat("own", F.coalesce("more", empty))).alias("labels"), score.alias("score"),
    )
