"""License scans by diagonal voting.

Templates are license texts as words. All rolling k-word hashes of every
document are joined with the template positions of the same hash; a hit at word
i of the document and j of the template lies on diagonal i - j. Hits are counted
by diagonal, neighbouring diagonals (inserted or dropped words) merge into one
candidate, and a candidate is verified by the share of the template's words that
its hits cover - hits count only if the words themselves are equal.

The template table is fixed by the parameter (checked against ``MAX_GRAMS``), so
it is broadcast: the rolling hashes are joined where the text is read and only
hits are shuffled.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z are lower-cased.
Defined cases: null text is empty; repeated rows give repeated results; a null id
is carried; ties of labels are sorted and distinct; empty in, empty out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
MERGE = 3
COVER = 0.6
MAX_GRAMS = 100_000

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Statements of public licenses and the labels of the method.
TEMPLATES: list[tuple[str, str]] = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "This project is licensed under the terms of the MIT license."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2.0-disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-disclaimer", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> DataFrame:
    """(template, label, length, tpos, gram words) of every k-word gram."""
    rows = []
    for t, (label, text) in enumerate(templates):
        w = template_words(text)
        rows += [(t, label, len(w), i, w[i : i + k]) for i in range(len(w) - k + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"templates have {len(rows)} grams; at most {MAX_GRAMS} are broadcast")
    df = spark.createDataFrame(rows, "template int, label string, t_len int, t_pos int, t_words array<string>")
    return df.withColumn("t_hash", F.xxhash64(*[F.get("t_words", F.lit(i)) for i in range(k)]))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, words): lower-cased A-Z, words of the license alphabet."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low = F.translate(F.col("text"), _UPPER, _LOWER)
    parts = F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")
    return rows.select("doc", F.xxhash64("text").alias("th"), parts.alias("words"))


def base_places(words: Column) -> Column:
    """array<struct<at, label>> of the phrases' places, by position; ``words`` must be a column."""

    def here(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            hit = None
            for j, w in enumerate(phrase.split(" ")):
                c = F.get(words, i + j) == w
                hit = c if hit is None else hit & c
            out = F.when(F.coalesce(hit, F.lit(False)), F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("at"), out.alias("label"))

    last = {p.split(" ")[-1] for p in PHRASES}
    some = None
    for w in sorted(last):
        c = F.array_contains(words, w)
        some = c if some is None else some | c
    places = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), here), lambda x: x["label"].isNotNull())
    return F.when((F.size(words) > 0) & some, places).otherwise(F.expr("cast(array() as array<struct<at:bigint,label:string>>)"))


def diagonal_hits(rows: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """(doc, th, template, label, t_len, pos, t_pos) of the grams that a document shares with a template, words compared."""
    n = F.size("words")
    word = lambda i, j: F.get(F.col("words"), i + j)
    gram = lambda i: F.struct(i.alias("pos"), F.xxhash64(*[word(i, j) for j in range(k)]).alias("hash"), *[word(i, j).alias(f"g{j}") for j in range(k)])
    # a row of a gram holds its own words only: the text's array would be copied for every gram
    rolled = rows.select("doc", "th", F.explode(F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram))).alias("x")).select("doc", "th", "x.*")
    equal = None
    for j in range(k):
        c = F.col(f"g{j}") == F.get("t_words", F.lit(j))
        equal = c if equal is None else equal & c
    return rolled.join(F.broadcast(grams), (F.col("hash") == F.col("t_hash"))).where(equal).select("doc", "th", "template", "label", "t_len", "pos", "t_pos")


def verified_spans(hits: DataFrame, k: int, merge: int = MERGE, cover: float = COVER) -> DataFrame:
    """(doc, th, label, template, first, last, votes, score): merged diagonals that cover enough of their template."""
    votes = hits.withColumn("diag", F.col("pos") - F.col("t_pos")).groupBy("doc", "th", "template", "label", "t_len", "diag").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("t_set")
    )
    by = Window.partitionBy("doc", "th", "template").orderBy("diag")
    fresh = F.when(F.col("diag") - F.lag("diag").over(by) <= merge, 0).otherwise(1)
    runs = votes.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by))
    spans = runs.groupBy("doc", "th", "template", "label", "t_len", "run").agg(
        F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + (k - 1)).alias("last"), F.array_distinct(F.flatten(F.collect_list("t_set"))).alias("t_set")
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("t_set", lambda t: F.sequence(t, t + (k - 1))))))
    return spans.withColumn("score", words / F.col("t_len")).where(F.col("score") >= cover).drop("t_set", "run", "t_len")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, k: int = K) -> DataFrame:
    """Base places and labels, the method's labels and its best score, one row per input row."""
    rows = with_words(docs, id_col, text_col)
    spans = verified_spans(diagonal_hits(rows, template_grams(docs.sparkSession, templates or TEMPLATES, k), k), k)
    found = spans.groupBy(F.col("doc").alias("fd"), F.col("th").alias("ft")).agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best"), F.count(F.lit(1)).alias("n_spans"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "score"))).alias("spans"),
    )
    base = rows.select("doc", "th", F.size("words").cast("long").alias("n_words"), base_places(F.col("words")).alias("p"))
    base = base.select(
        "doc", "th", "n_words", F.size("p").cast("long").alias("n_base"),
        F.array_min(F.transform("p", lambda x: x["at"])).alias("first_word"), F.array_max(F.transform("p", lambda x: x["at"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("p", lambda x: x["label"]))).alias("b"),
    )
    out = base.join(found, F.col("doc").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")), "left")
    none = F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_distinct(F.concat("b", F.coalesce("more", none))))
    return out.select(
        F.col("doc").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("best", F.when(F.col("n_base") > 0, F.lit(COVER)).otherwise(F.lit(0.0)))).cast("double").alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
