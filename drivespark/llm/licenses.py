"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams (native).

Compared are spans of a document's words: its lines, its whole text, and windows of each template's own length, wherever
lines end, so a notice is found inside a longer line and across several. Of a and b bigrams two spans can only share enough
for a Dice coefficient of t if t/(2-t) <= a/b <= (2-t)/t and if at least b*t/(2-t) are shared. Sizes therefore rule out
templates for lines and whole texts; and a document that lacks as many of a template's words as make up more than the
other bigrams is left before any bigram is built. The templates are a fixed list in this module (or the caller's,
size-checked); texts are never shuffled, only the few bigrams that a template has too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, row_key, small, staged

THRESHOLD = 0.8

# Common licence notices, as their authors ask for them to be written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """``license, text``, one row for each template."""
    rows = sorted((templates or TEMPLATES).items())
    return spark.createDataFrame(rows, "license string, text string")


def words_of(text):
    """Runs of a-z and 0-9 after A-Z are lower-cased."""
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda w: w != "")


def placed_words(text):
    """Words with their line: ``w``, ``line``, and the line's first word and size (``i`` is the word's number in it)."""
    # Each line's words stand in an array of one, so that the inner function refers to them and they are made once.
    lines = F.transform(F.split(lower_ascii(text), "\n"), lambda line: F.array(F.filter(F.split(line, "[^a-z0-9]+"), lambda w: w != "")))
    placed = lambda ws, j: F.transform(ws, lambda w, i: F.struct(w.alias("w"), j.alias("line"), i.alias("i"), F.size(ws).alias("size")))
    return F.flatten(F.flatten(F.transform(lines, lambda own, j: F.transform(own, lambda ws: placed(ws, j)))))


def bigrams(words):
    """``w``: the pairs of neighbouring words, joined by a space."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def placed_bigrams(words):
    """The pairs of ``placed_words`` with the first word and number of bigrams of the line, which are null across lines."""

    def pair(p):
        a, b = F.element_at(words, p), F.element_at(words, p + 1)
        inside = a.line == b.line
        return F.struct(F.concat_ws(" ", a.w, b.w).alias("bigram"), F.when(inside, p - 1 - a.i).alias("first"), F.when(inside, a["size"] - 1).alias("line_n"))

    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), pair)


def needed_words(grams: DataFrame, threshold: float) -> list[str]:
    """Words of which a document must have one for any template to match.

    A bigram stands under the rarer of its words, as far as the templates can tell: one of five letters or more, then the one
    that fewer templates hold, then the longer. Of each template as many words are taken, the rarest first, as hold more bigrams than a match can lack; ``grams``: ``license, t_n, bigram,
    t_c``. The list is no longer than the templates.
    """
    pair = F.split("bigram", " ")
    among = grams.select("license", F.explode(pair).alias("w")).groupBy("w").agg(F.count_distinct("license").alias("held"))
    sides = grams.select("*", F.explode(F.array_distinct(pair)).alias("w")).join(among, "w")
    rarest = F.struct((F.length("w") < 5).alias("short"), "held", (-F.length("w")).alias("size"), "w")
    under = sides.groupBy("license", "t_n", "bigram", "t_c").agg(F.min(rarest).alias("r")).groupBy("license", "t_n", "r").agg(F.sum("t_c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("license").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    spared = F.col("t_n") - F.ceil(F.col("t_n") * F.lit(threshold / (2 - threshold)) - 1e-9)
    return sorted(r.w for r in under.withColumn("upto", upto).where(F.col("upto") - F.col("c") <= spared).select("r.w").distinct().collect())


def _windows(hits: DataFrame, key: list[str], grams: DataFrame) -> DataFrame:
    """``key, start, own, shared`` of windows of a template's length that start at one of its bigrams or end the text.

    A bigram that the template has c times counts in a window unless c of its kind stand before it there. So it counts for all
    starts from just behind the c-th one before it (or the window's length before it) to its own place, and what a window
    shares is a running sum over the ends of such stretches: linear in the hits of a text, whose rows are sorted once.
    """
    at, last = F.col("at"), F.col("n") - F.col("t_n")
    same = Window.partitionBy(*key, "bigram").orderBy("at")
    # As many different counts as there are cost their sum in bigrams: few, for templates of any size.
    counts = [r.t_c for r in grams.select("t_c").distinct().collect()]
    before = F.coalesce(*(F.when(F.col("t_c") == n, F.lag("at", n).over(same)) for n in counts), F.lit(-1)) if counts else F.lit(-1)
    d = hits.where("n > t_n").repartition(*key).select(*key, "at", "n", before.alias("before"))
    event = lambda pos, delta, start: F.struct(pos.cast("long").alias("pos"), F.lit(delta).alias("delta"), F.lit(start).alias("asks"))
    d = d.select(*key, F.inline(F.array(event(F.greatest(at - F.col("t_n"), "before") + 1, 1, False), event(at + 1, -1, False), event(F.least(at, last), 0, True))))
    d = d.withColumn("shared", F.sum("delta").over(Window.partitionBy(*key).orderBy("pos")))
    return d.where("asks").select(*key, F.col("pos").cast("int").alias("start"), F.col("t_n").alias("own"), "shared")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, start, n_words, dice``: of each document and licence, the most similar span, if it reaches ``threshold``.

    Spans: lines of two words or more, the whole text, and windows of as many words as the template has that start at one
    of its bigrams or end the text. Of equally similar ones the first counts, then the shortest; ``start`` counts words from
    0. Words are runs of a-z and 0-9 after lower-casing; bigrams count with their repeats. Null and empty texts and texts of
    one word match nothing; rows that repeat id and text give the same rows once; other columns are ignored, whatever their
    names. No documents or no templates give no rows.
    """
    if templates is None:
        templates = template_table(docs.sparkSession)
    ratio = threshold / (2 - threshold)
    t = templates.select("license", words_of(F.col("text")).alias("ws")).where(F.size("ws") >= 2)
    t = t.select("license", (F.size("ws") - 1).alias("t_n"), F.explode(bigrams(F.col("ws"))).alias("bigram"))
    t = staged(t.groupBy("license", "t_n", "bigram").agg(F.count("*").alias("t_c")))
    key = ["doc_id", "k", "license", "t_n"]
    text = F.col(f"`{text_col}`")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(F.col(f"`{id_col}`"), text).alias("k"), text.alias("text"))
    some = d.where(F.arrays_overlap(words_of(F.col("text")), F.array(*map(F.lit, needed_words(t, threshold) or [""]))))
    at = some.select("doc_id", "k", placed_words(F.col("text")).alias("ws")).where(F.size("ws") >= 2)
    # ``n`` is made before the rows of the bigrams, which else would all carry the words.
    at = at.select("doc_id", "k", "ws", (F.size("ws") - 1).alias("n")).select("doc_id", "k", "n", F.posexplode(placed_bigrams(F.col("ws"))).alias("at", "b")).select("doc_id", "k", "n", "at", "b.*")
    hits = staged(at.join(small(t), "bigram").dropDuplicates([*key, "at"]))

    fits = lambda n: (F.col(n) >= F.col("t_n") * ratio - 1e-9) & (F.col(n) * ratio <= F.col("t_n") + 1e-9)
    lines = hits.where(F.col("first").isNotNull() & fits("line_n")).select(*key, F.lit(1).alias("kind"), F.col("first").alias("start"), F.col("line_n").alias("own"), "bigram", "t_c")
    whole = hits.where(fits("n")).select(*key, F.lit(2).alias("kind"), F.lit(0).alias("start"), F.col("n").alias("own"), "bigram", "t_c")
    spans = lines.unionByName(whole).groupBy(*key, "kind", "start", "own", "bigram", "t_c").agg(F.count("*").alias("c"))
    shared = spans.groupBy(*key, "kind", "start", "own").agg(F.sum(F.least("c", "t_c")).alias("shared"))
    dice = shared.drop("kind").unionByName(_windows(hits, key, t)).withColumn("dice", F.col("shared") * 2.0 / (F.col("own") + F.col("t_n"))).where(F.col("dice") >= threshold)
    best = dice.groupBy(*key).agg(F.min(F.struct((-F.col("dice")).alias("d"), "start", "own")).alias("b"))
    return best.select("doc_id", "license", F.col("b.start").alias("start"), (F.col("b.own") + 1).alias("n_words"), (-F.col("b.d")).alias("dice"))
