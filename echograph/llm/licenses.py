"""Licence scan by a positional rare-token index, native Spark only.

Licence texts are indexed by word and position. Of each template the ``RARE_WORDS`` words with the
highest inverse document frequency, counted over all documents, are looked up in the files; postings
are intersected by relative position (file position minus template position, in overlapping bins, so
that a name or a year put in doesn't part a licence). A template stands in a file if ``AGREEMENT`` of
its rare words' places agree and one of its mandatory key phrases is there. The score is the best
share of agreeing places among templates with a key phrase in the file, 0 without any; base phrases
give their label whatever the score.

A null or empty text has no words. Ties in frequency go by the alphabet. Repeated rows get equal
results, and a null doc_id is told apart by its text; an empty table gives no rows. Only doc_id and
text are read, so extra columns don't matter. Long texts are handled whole: postings leave the row as
rows of (document, template, bin), never as a group of many documents.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm.quality import let, row_key
from echograph.session import materialise

# The phrases of the base rules, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Fixed values: (label, public licence text or notice, key phrases of which one is mandatory).
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
     and this permission notice shall be included in all copies or substantial portions of the Software.""",
     ["permission is hereby granted"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
     this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
     distribution.""",
     ["redistribution and use in source and binary forms"]),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies.""",
     ["permission to use copy modify"]),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
     with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
     by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
     WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
     governing permissions and limitations under the License.""",
     ["apache license"]),
    ("apache", "Licensed under the Apache License, Version 2.0.", ["apache license"]),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
     implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
     ["gnu general public license", "free software foundation"]),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution"]),
    ("cc-by", "Licensed under CC BY 4.0.", ["cc by"]),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
     ["mozilla public license"]),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
     use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
     commercial or non-commercial, and by any means.""",
     ["unencumbered software released into the public domain"]),
]

#: Words of a template that are looked up, and the share of their places that must agree.
RARE_WORDS = 8
AGREEMENT = 0.6
#: Words by which places may differ and still agree, at least; bins are twice as wide.
SLACK = 8


def normal_text(text: Column) -> Column:
    """Words between single spaces, with a space at either end. Lower-casing beyond A-Z changes no
    word border and makes no letter of the phrases, so it stands for lower-casing A-Z."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(clean == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), clean, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _place(norm: Column, n_words: Column, phrase: str, label: str) -> Column:
    """A struct of count, first, last and label of a phrase's places, or null."""
    with_ends = f" {phrase} "
    first = _spaces(F.substring(norm, F.lit(1), F.instr(norm, with_ends))) - 1
    after = _spaces(F.substring_index(norm, with_ends, -1))
    found = F.struct(
        F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )")).cast("long").alias("n"),
        first.cast("long").alias("first"),
        (n_words - after - len(phrase.split())).cast("long").alias("last"),
        F.lit(label).alias("label"),
    )
    return F.when(F.contains(norm, F.lit(with_ends)), found)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in template_words(text)})


def document_counts(docs: DataFrame) -> dict[str, int]:
    """Documents that hold each of the templates' words; one number a word comes to the driver."""
    words, known = F.split(F.trim(normal_text(F.col("text"))), " "), vocabulary()
    held = docs.select(F.explode(F.array_distinct(F.filter(words, lambda w: w.isin(known)))).alias("w"))
    return {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def rare_postings(counts: dict[str, int]) -> list[tuple[str, int, int, int]]:
    """(word, template, place, places in all) of each template's rarest words. The fewer documents hold
    a word the higher its inverse document frequency; a common word ranks last, none is left out for it.
    Words that no document has tell nothing and only fill up."""
    out = []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = template_words(text)
        rare = set(sorted(set(words), key=lambda w: (w not in counts, counts.get(w, 0), w))[:RARE_WORDS])
        places = [(w, i) for i, w in enumerate(words) if w in rare]
        out += [(w, t, i, len(places)) for w, i in places]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    postings = rare_postings(document_counts(docs))
    rare = sorted({w for w, *_ in postings})

    def anchors(words: Column) -> Column:
        placed = F.transform(words, lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), i.alias("pos"))))
        return F.filter(placed, lambda x: x.isNotNull())

    def measure(norm: Column) -> Column:
        n = _spaces(norm) - 1
        places = F.filter(F.array(*[_place(norm, n, p, label) for p, label in PHRASES]), lambda x: x.isNotNull())
        held = lambda phrases: F.array_contains(F.array(*[F.contains(norm, F.lit(f" {p} ")) for p in phrases]), True)
        keys = F.array_compact(F.array(*[F.when(held(phrases), F.lit(t)) for t, (_, _, phrases) in enumerate(TEMPLATES)]))
        found = lambda k: F.struct(k.alias("keys"), F.when(F.size(k) > 0, anchors(F.split(F.trim(norm), " "))).alias("anchors"))
        return F.struct(n.cast("long").alias("n_words"), places.alias("places"), let(keys, found).alias("found"))

    rows = docs.select(*row_key(F.col("text")), "doc_id", let(normal_text(F.col("text")), measure).alias("m"))
    rows = materialise(rows.select("_id", "_text", "doc_id", "m.n_words", "m.places", "m.found.*"), "licence-rows")
    index = spark.createDataFrame(postings, "w string, template int, tpos int, of int")
    held = rows.filter("size(anchors) > 0").select("_id", "_text", "keys", F.inline("anchors"))
    offset = F.col("pos") - F.col("tpos")
    bins = F.array(*[F.struct(F.lit(k).alias("shift"), F.floor((offset + k * SLACK) / (2 * SLACK)).alias("bin")) for k in (0, 1)])
    agreed = (
        held.join(F.broadcast(index), "w")  # the rare words of the templates, a constant
        .filter(F.array_contains("keys", F.col("template")))
        .select("_id", "_text", "template", "of", "tpos", F.inline(bins))
        .groupBy("_id", "_text", "template", "of", "shift", "bin").agg(F.size(F.collect_set("tpos")).alias("n"))
    )
    names = F.create_map(*[F.lit(x) for t, (label, _, _) in enumerate(TEMPLATES) for x in (t, label)])
    share = F.col("n") / F.col("of")
    stands = agreed.groupBy("_id", "_text").agg(F.collect_set(F.when(share >= AGREEMENT, names[F.col("template")])).alias("found"), F.max(share).alias("share"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    out = rows.join(stands, ["_id", "_text"], "left")
    every = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words",
        F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["last"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce("share", F.lit(0.0)).alias("score"),
    )


def op4_rare_token_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
