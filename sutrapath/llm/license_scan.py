"""License scans: which license notices a text contains, verbatim or nearly so.

Method.  Words are runs of [a-z0-9] after lower-casing A-Z; shingles are five words.  A template
of n words is sought in windows of twice its length class (10, 20, 40, ... words, in steps of half
a window), so that any n words in a row lie in one window whole.  A window's MinHash signature
meets a template's in bands of one row; their number follows from the least Jaccard index that a
window holding ``containment`` of the template can have, such that a miss is less likely than
``miss``.  What a band retrieves is verified: the share of the template's distinct shingles that
the window holds must reach ``containment``.

Two exact filters keep the work small.  A set of words is chosen for each template so that more
than 1 - containment of its shingles hold one of them; a text, or a window, without any such
word can't match.

Defined results
* null, empty and short texts match nothing; texts are scanned whole, whatever their length;
* one row for each distinct (doc_id, license_id): rows with equal doc_id are scanned each and their
  matches put together; windows with equal containment tie, and the first word of the first counts;
* a template with fewer than five words is rejected;
* no rows: no rows.  Columns other than doc_id and text are neither read nor needed.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

SHINGLE = 5
TOKEN = "[a-z0-9]+"

#: Notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall(TOKEN, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)))


def window_words(words: list[str]) -> int:
    """The window of a template: the least of 10, 20, 40, ... that is at least twice its length."""
    size = 2 * SHINGLE
    while size < 2 * len(words):
        size *= 2
    return size


def bands_needed(shingles: int, window: int, containment: float, miss: float) -> int:
    """Bands of one row so that a window with ``containment`` of the template is missed less often than ``miss``."""
    held = math.ceil(containment * shingles)
    least = held / (window - SHINGLE + 1 + shingles - held)
    return 1 if least >= 1 else math.ceil(math.log(miss) / math.log(1 - least))


def anchors(shingles: list[str], containment: float) -> list[str]:
    """Words such that shingles with none of them are fewer than ``containment`` of all: longest words first, as they are rarest."""
    left, chosen = set(shingles), []
    words = sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w))
    for word in words:
        if len(left) < containment * len(shingles) - 1e-9:
            break
        if any(word in s.split() for s in left):
            chosen.append(word)
            left = {s for s in left if word not in s.split()}
    return chosen


def signature(shingles: Column, bands: int) -> Column:
    """(band, least hash) for each band."""
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, b))).alias("least")))


def _prepared(spark: SparkSession, templates: dict[str, str], containment: float, miss: float) -> tuple[DataFrame, dict[int, int], dict[int, list[str]]]:
    rows, bands, words_of = [], {}, {}
    for name, text in templates.items():
        words = template_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        shingles, window = template_shingles(words), window_words(words)
        bands[window] = max(bands.get(window, 1), bands_needed(len(shingles), window, containment, miss))
        words_of[window] = sorted({*words_of.get(window, []), *anchors(shingles, containment)})
        rows.append((name, window, shingles))
    return spark.createDataFrame(rows, "license_id string, window int, template array<string>"), bands, words_of


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """The operator: (doc_id, license_id, containment, n_windows, first_word) for each notice that a document contains.

    ``templates`` is a parameter of bounded size (its signatures are broadcast): notices, not whole corpora.
    """
    table, bands, words_of = _prepared(docs.sparkSession, templates, containment, miss)
    every = sorted({w for words in words_of.values() for w in words})
    # a word that holds another anchor is found with it
    short = [w for w in every if not any(o != w and o in w for o in every)]
    folded = F.lower("text")
    hit = folded.contains(short[0])
    for word in short[1:]:
        hit = hit | folded.contains(word)
    words = docs.select("doc_id", "text").where(hit).select("doc_id", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TOKEN), F.lit(0)).alias("words"))

    found = None
    for window, count in sorted(bands.items()):
        step = window // 2
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - SHINGLE), F.lit(step))
        marks = F.array(*[F.lit(w) for w in words_of[window]])
        cut = words.where(F.arrays_overlap("words", marks)).select("doc_id", "words", F.explode(starts).alias("start")).select("doc_id", "start", F.slice("words", F.col("start") + 1, window).alias("part"))
        cut = cut.where((F.size("part") >= SHINGLE) & F.arrays_overlap("part", marks))
        shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("part") - SHINGLE + 1), lambda i: F.concat_ws(" ", F.slice("part", i, SHINGLE))))
        cut = cut.select("doc_id", "start", shingles.alias("shingles"))
        signed = cut.select("*", F.explode(signature(F.col("shingles"), count)).alias("s")).select("doc_id", "start", "shingles", "s.band", "s.least")
        own = table.where(F.col("window") == window)
        own = own.select("license_id", "template", F.explode(signature(F.col("template"), count)).alias("t")).select("license_id", "template", "t.band", "t.least")
        share = F.size(F.array_intersect("template", "shingles")) / F.size("template")
        met = signed.join(F.broadcast(own), ["band", "least"]).withColumn("containment", share).where(F.col("containment") >= containment)
        met = met.select("doc_id", "license_id", "start", "containment")
        found = met if found is None else found.unionByName(met)
    found = found.groupBy("doc_id", "license_id", "start").agg(F.max("containment").alias("containment"))
    return found.groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_word"))


def oracle_sql(templates: dict[str, str] = TEMPLATES, containment: float = 0.8) -> str:
    """The same result by exact containment of every window."""
    values = ", ".join("('{}', {}, [{}])".format(name, window_words(w := template_words(text)), ", ".join(f"'{s}'" for s in template_shingles(w))) for name, text in templates.items())
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH templates(license_id, window_words, template) AS (VALUES {values}),
words AS (SELECT doc_id, regexp_extract_all({lower}, '{TOKEN}') AS words FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT window_words FROM templates),
cut AS (
  SELECT doc_id, window_words, s.start AS start, list_slice(words, s.start + 1, s.start + window_words) AS part
  FROM words, sizes, LATERAL (SELECT unnest(generate_series(0, len(words) - {SHINGLE}, window_words // 2)) AS start) s
),
shingled AS (
  SELECT doc_id, window_words, start,
    list_distinct([array_to_string(list_slice(part, i, i + {SHINGLE - 1}), ' ') FOR i IN generate_series(1, len(part) - {SHINGLE - 1})]) AS shingles
  FROM cut WHERE len(part) >= {SHINGLE}
),
matched AS (
  SELECT DISTINCT doc_id, license_id, start, CAST(len(list_intersect(template, shingles)) AS DOUBLE) / len(template) AS containment
  FROM shingled JOIN templates USING (window_words)
)
SELECT doc_id, license_id, max(containment) AS containment, CAST(count(DISTINCT start) AS BIGINT) AS n_windows, CAST(min(start) AS BIGINT) AS first_word
FROM matched WHERE containment >= {containment}
GROUP BY doc_id, license_id"""
