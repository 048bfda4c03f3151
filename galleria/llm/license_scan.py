"""License scans: MinHash bands over overlapping windows of text retrieve templates; exact shingle containment decides.

Words are runs of letters and digits in lower case, shingles are five of them. A template of s shingles belongs to the
window class W, the smallest power of two of at least 2 s (and 4); texts are read in windows of W shingles every W / 2, so
an occurrence of the template lies in one window as a whole. If a window holds 80 % of the template's shingles, their
Jaccard similarity is at least 0.8 s / (W + 0.2 s) > 0.19. With 40 bands of one minimum each, each under a hash function of
its own, the window misses the template's bands with a probability of some 0.81^40 = 0.0002. Every retrieved pair is
verified by its exact containment.

Native: DataFrame functions only, no Python on the executors. A text that shares no shingle with any template cannot hold
80 % of one, so such texts leave before windows are built.

Scale: up to `FEW_SHINGLES` shingles of templates are a literal of that test and their bands a broadcast table; the texts are
not shuffled, and matches are aggregated by (document, template). A larger template table is joined: the texts' shingles
with the templates' to find the documents that share one, and bands by their keys, with no broadcast hint. Long texts become
many windows, and copies cost their own windows only.

Defined results: null, empty or shorter texts match nothing; rows with equal ids are one document; extra columns are
ignored; an empty table gives no matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import literal_rows

# Short forms of public licence statements, as they stand in sources and works.
TEMPLATES: list[tuple[str, str, str]] = [
    ("apache-2.0-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Apache-2.0", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.')),
    ("mit-short", "MIT", "Released under the MIT License."),
    ("mit-permission", "MIT", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")),
    ("gpl-3-short", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3-notice", "GPL-3.0-or-later", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    ("bsd-redistribution", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

WORDS, BANDS, CONTAINED = 5, 40, 0.8
FEW_SHINGLES = 10_000


def template_table(spark: SparkSession, rows: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return literal_rows(spark, rows or TEMPLATES, "template_id: string, license: string, template: string")


def shingles(column: str) -> str:
    """SQL of the array of shingle hashes of a text column; fewer than five words: an empty array."""
    words = rf"filter(split(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), w -> w <> '')"
    hashed = f"transform({words}, w -> xxhash64(w))"
    grams = "transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))"
    return f"element_at(transform(array({hashed}), h -> CASE WHEN size(h) < 5 THEN cast(array() AS array<bigint>) ELSE {grams} END), 1)"


def _minima(window: str) -> str:
    """SQL of the array of band keys of an array of shingles: the minimum of each band's own hash of them."""
    return f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform({window}, x -> xxhash64(x, b))))"


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, template_id, license, containment, first_word: a row per document and template found in it."""
    spark = docs.sparkSession
    templates = templates if templates is not None else template_table(spark)
    t = templates.select("template_id", "license", F.expr(f"array_distinct({shingles('template')})").alias("ts")).filter(F.size("ts") > 0)
    size = t.agg(F.coalesce(F.sum(F.size("ts")), F.lit(0))).first()[0]
    few = size <= FEW_SHINGLES
    t = t.withColumn("w", F.expr("cast(greatest(4, pow(2, ceil(log2(2 * size(ts))))) as int)"))
    bands = t.select("template_id", "license", "ts", "w", F.posexplode(F.expr(_minima("ts")))).withColumnsRenamed({"pos": "t_band", "col": "t_key"})
    bands = F.broadcast(bands) if few else bands
    sizes = [r["w"] for r in t.select("w").distinct().collect()]
    known = t.select(F.explode("ts").alias("known")).distinct()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    read = rows.select("id", F.expr(shingles("text")).alias("sh"))
    if few:
        read = read.filter(F.arrays_overlap("sh", F.array(*[F.lit(r["known"]) for r in known.collect()]).cast("array<bigint>")))
    else:
        some = read.select(F.col("id").alias("known_id"), F.explode("sh").alias("s")).join(known, F.col("s") == F.col("known")).select("known_id").distinct()
        read = read.join(some, F.col("id").eqNullSafe(F.col("known_id")), "left_semi")
    classes = F.array(*[F.lit(int(s)) for s in sizes]) if sizes else F.array().cast("array<int>")
    windows = read.select("id", "sh", F.explode(classes).alias("win")).selectExpr(
        "id", "win", "explode(transform(sequence(0, greatest(0, size(sh) - 1), div(win, 2)), s -> struct(s AS at, array_distinct(slice(sh, s + 1, win)) AS ws))) AS x".replace("div(win, 2)", "cast(win / 2 as int)")
    ).select("id", "win", "x.at", "x.ws")
    probes = windows.select("id", "win", "at", "ws", F.posexplode(F.expr(_minima("ws"))).alias("band", "key"))
    found = probes.join(bands, (F.col("win") == F.col("w")) & (F.col("band") == F.col("t_band")) & (F.col("key") == F.col("t_key")))
    share = F.size(F.array_intersect("ws", "ts")) / F.size("ts")
    sure = found.select("id", "template_id", "license", "at", share.alias("containment")).filter(F.col("containment") >= CONTAINED)
    return sure.groupBy(F.col("id").alias(id_col), "template_id", "license").agg(F.max("containment").alias("containment"), F.min("at").alias("first_window_word"))
