"""License scans: MinHash bands over overlapping text windows, then exact shingle containment. DataFrame functions only.

Words are lower-cased runs of letters and digits. Templates fall into classes by length; for each class a text is read in
windows that overlap so far that a template's words always lie within one of them. A window's bands are the least of its
shingle hashes under several permutations; a template that shares a band with a window is compared with it in full. The
number of bands follows from the least similarity that a window holding a match can have, so that a match shares one with
probability ``FOUND`` at least. Windows without any shingle of any template can't hold a match and get no bands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, null_safe, stored
from larder.llm.quality_rules import let

# Notices by name, as their licenses word them. Callers may pass their own.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Words of a shingle, share of a template's shingles that a window must hold, and chance that a match shares a band.
WIDTH, CONTAINED, FOUND = 5, 0.8, 0.999


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    """Hash of the run of WIDTH words that starts at each word but the last ones; none in shorter texts."""
    run = lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WIDTH)])
    return F.when(F.size(w) < WIDTH, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - WIDTH + 1), run))


def _plan(sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """For shingle counts of templates: classes (least and most shingles, step, window, bands)."""
    out, rest = [], sorted(set(sizes))
    while rest:
        least = rest[0]
        most = max(s for s in rest if s <= 2 * least)
        step = max(1, most // 4)
        window = most + step - 1  # in shingles: any run of `most` lies within a window
        held = math.ceil(CONTAINED * least)
        alike = held / (least + window - held)
        out.append((least, most, step, window, max(1, math.ceil(math.log(1 - FOUND) / math.log(1 - min(alike, 0.999))))))
        rest = [s for s in rest if s > most]
    return out


def _bands(hashes: Column, count: int) -> Column:
    """The least hash under each permutation, with its number."""
    seeds = F.array(*[F.xxhash64(F.lit("band"), F.lit(i)) for i in range(count)])
    return F.transform(seeds, lambda s, i: F.struct(i.alias("band"), F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))).alias("token")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """Rows (name, hashes) of templates with WIDTH words or more, and the plan of windows for them."""
    rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", F.array_distinct(shingle_hashes(words(F.col("text")))).alias("hashes"))
    kept = [(r["name"], list(r["hashes"])) for r in rows.where(F.size("hashes") > 0).collect()]  # bounded: the caller's templates
    return spark.createDataFrame(kept, "name string, hashes array<long>"), _plan([len(h) for _, h in kept])


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, licenses, an array of (name, start, end, contained) by name.

    ``start`` and ``end`` count words (end exclusive) of the first of the windows that hold most of the template's distinct
    shingles, a share ``contained`` of CONTAINED or more. Templates shorter than WIDTH words are passed over. A null or
    empty text has no license. Rows that repeat id and text have the same result; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    table, plan = template_table(spark, TEMPLATES if templates is None else templates)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), text.alias("text"))
    known = sorted({h for r in table.collect() for h in r["hashes"]})  # bounded: the caller's templates
    vocabulary = F.array(*map(F.lit, known)) if known else F.array().cast("array<long>")

    def hits(h: Column) -> Column:
        common = F.array_intersect(h, vocabulary)
        at = lambda c: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(c, x), i)), lambda i: i.isNotNull())
        some = lambda c: F.when(F.size(c) > 0, F.struct(h.alias("hashes"), at(c).alias("hits")))
        return let(common, some)

    seen = rows.select("id", "sha", let(words(F.col("text")), lambda w: let(shingle_hashes(w), hits)).alias("x"))
    seen = stored(seen.select("id", "sha", "x.hashes", "x.hits"), "shingles")
    some = seen.where(F.col("hits").isNotNull()).dropDuplicates(["id", "sha"])
    found: DataFrame | None = None
    for least, most, step, window, bands in plan:
        of_class = table.where(F.size("hashes").between(least, most)).withColumn("bands", _bands(F.col("hashes"), bands))
        own = of_class.select("name", F.col("hashes").alias("whole"), F.explode("bands").alias("b"))
        # windows start at multiples of `step`; those that hold a hit
        first = lambda i: F.greatest(F.lit(0), F.ceil((i - (window - 1)) / step)).cast("int")
        starts = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.sequence(first(i), F.floor(i / step).cast("int")))))
        windows = some.select("id", "sha", "hashes", F.explode(starts).alias("k"))
        windows = windows.select("id", "sha", (F.col("k") * step).alias("start"), F.array_distinct(F.slice("hashes", F.col("k") * step + 1, F.lit(window))).alias("part"))
        banded = windows.select("id", "sha", "start", "part", F.explode(_bands(F.col("part"), bands)).alias("w"))
        met = banded.join(F.broadcast(own), (F.col("w.band") == F.col("b.band")) & (F.col("w.token") == F.col("b.token")))  # bounded: the caller's templates
        share = F.size(F.array_intersect("part", "whole")) / F.size("whole")
        verified = met.select("id", "sha", "name", "start", share.alias("contained")).where(f"contained >= {CONTAINED}")
        verified = verified.withColumn("end", F.col("start") + window + WIDTH - 1)
        found = verified if found is None else found.union(verified)
    none = F.array().cast("array<struct<name:string,start:int,end:int,contained:double>>")
    if found is None:
        return seen.select("id", none.alias("licenses"))
    best = found.groupBy("id", "sha", "name").agg(F.min(F.struct((-F.col("contained")).alias("less"), "start", "end")).alias("x"))
    best = best.groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha")).agg(F.array_sort(F.collect_list(F.struct("name", "x.start", "x.end", (-F.col("x.less")).alias("contained")))).alias("licenses"))
    best = broadcast_if_small(stored(best, "licenses"))
    joined = seen.select("id", "sha").join(best, null_safe(seen, best, {"id": "__id", "sha": "__sha"}), "left")
    return joined.select("id", F.coalesce("licenses", none).alias("licenses"))

