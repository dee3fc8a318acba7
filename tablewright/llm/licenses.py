"""License scan: sparse TF-IDF cosine of statements and whole files to templates, inherited down the directories.

Every line of every text and every whole text is a unit. A unit's vector holds its words weighted by frequency and
inverse document frequency, the latter counted over the whole corpus; words outside the templates' vocabulary count
with the weight of a word that no document has, so foreign words lower the similarity. Cosines of at least
``THRESHOLD`` are kept and the best template of a file, a line's or the file's, is its own licence. Templates are
passages of licences and declarations: every name of a licence in every frame ("Released under ...") and its SPDX line.
Declarations of different licences are alike but for a word or two, so a unit matches one only if it has the words that
tell its name apart, the version among them: a licence that is not listed is not taken for one that is.

Units are first sieved without loss: a template's vector is split so that its lightest words together have a norm below
the threshold; a unit with none of the heavier words ("anchors") cannot reach it. Where the rarest word that a template
needs is rarer than these, it is the anchor. Only lines and files with an anchor are cut into words, so hardly any of
the corpus is shuffled.

A file without a licence of its own inherits from the nearest directory above it that has one. A directory's licence is
that of its licence files: the one with the best similarity, then the smallest path. Paths are joined level by level
against that small table; no pairs of files are formed.

Only DataFrame functions are used. Cases: NULL texts and paths match and inherit nothing and are returned; empty texts
may inherit; repeated rows are scored each; ties between templates go to the first name; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import own_names, stored

THRESHOLD = 0.6

# Passages of licences that are declared without being named, or in a fixed notice (licence, statement).
PASSAGES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

# Names by which a licence is declared (licence, its names).
NAMES = (
    ("AGPL-3.0", ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License, version 3.0", "AGPL-3.0", "AGPL v3", "AGPLv3")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "Apache-2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License",)),
    ("BSD-3-Clause", ("the BSD 3-Clause License",)),
    ("CC0-1.0", ("CC0 1.0", "the Creative Commons Zero 1.0 Universal License")),
    ("GPL-2.0", ("the GNU General Public License, version 2", "the GNU General Public License, version 2.0", "GPL-2.0", "GPL v2", "GPLv2")),
    ("GPL-3.0", ("the GNU General Public License, version 3", "the GNU General Public License, version 3.0", "GPL-3.0", "GPL v3", "GPLv3")),
    ("LGPL-2.0", ("the GNU Lesser General Public License, version 2", "the GNU Lesser General Public License, version 2.0", "LGPL-2.0", "LGPL v2", "LGPLv2")),
    ("LGPL-2.1", ("the GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPL v2.1", "LGPLv2.1")),
    ("LGPL-3.0", ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 3.0", "LGPL-3.0", "LGPL v3", "LGPLv3")),
    ("MIT", ("the MIT License",)),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "MPL-2.0")),
    ("Unlicense", ("the Unlicense",)),
    *(
        (f"CC-{short}-{version}", (f"CC {short} {version}", f"a Creative Commons {long} {version} {scope} License"))
        for short, long in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for version, scope in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
    ),
)
FRAMES = ("This work is licensed under {}.", "Licensed under {}.", "Released under {}.")
SPDX = "SPDX-License-Identifier: {}"
#: Words of a name that do not tell licences apart.
LOOSE = {"a", "the", "gnu", "license", "version", "generic", "unported", "international", "universal"}

NOT_WORD = r"[^\p{L}\p{N}.]+|\.(?![\p{N}])"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def template_words(statement: str) -> list[str]:
    return [w for w in re.split(r"[^\w.]+|\.(?!\d)", statement.lower()) if w]


def declarations() -> dict[tuple[str, str], frozenset[str]]:
    """(licence, statement) of every name in every frame and as SPDX line, with the words that a unit must have for it."""
    found = {}
    for name, called in NAMES:
        stated = [(frame.format(n), n) for n in called for frame in FRAMES] + [(SPDX.format(name), name)]
        found |= {(name, statement): frozenset(template_words(n)) - LOOSE for statement, n in stated}
    return found


NEEDED = declarations()
TEMPLATES = (*PASSAGES, *NEEDED)


def corpus_weights(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], float]:
    """Inverse document frequency of each vocabulary word over all texts, and that of a word no text has."""
    spark = files.sparkSession
    terms = F.broadcast(spark.createDataFrame([(v,) for v in vocabulary], "term string"))  # bounded by the templates
    used = files.where("text IS NOT NULL").select(F.explode(F.array_distinct(F.split(F.lower("text"), NOT_WORD))).alias("term"))
    counts = {r["term"]: r["count"] for r in used.join(terms, "term", "left_semi").groupBy("term").count().collect()}
    total = files.count()
    weight = lambda n: math.log((total + 1) / (n + 1)) + 1
    return {v: weight(counts.get(v, 0)) for v in vocabulary}, weight(0)


def anchors(vectors: list[dict[str, float]], threshold: float, needed: list[frozenset[str]], idf: dict[str, float]) -> list[str]:
    """Words without which no unit reaches the threshold for any template or has the words it needs."""
    found: set[str] = set()
    for vector, need in zip(vectors, needed):
        norm, light, heavy = math.sqrt(sum(x * x for x in vector.values())), 0.0, set()
        for word, x in sorted(vector.items(), key=lambda e: (e[1], e[0])):
            light += (x / norm) ** 2
            if light >= (0.999 * threshold) ** 2:
                heavy.add(word)
        rarest = set(sorted(need, key=lambda w: (-idf[w], w))[:1])
        often = lambda ws: sum(math.exp(-idf[w]) for w in ws)
        found |= rarest if need and often(rarest) < often(heavy) else heavy
    return sorted(found)


def own_licenses(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, license, score, unit) of the files (key, text) that carry one; unit is 'line' or 'file'."""
    spark = files.sparkSession
    bags: list[dict[str, int]] = []
    for _, statement in templates:
        bag: dict[str, int] = {}
        for w in template_words(statement):
            bag[w] = bag.get(w, 0) + 1
        bags.append(bag)
    vocabulary = sorted(set().union(*bags))
    idf, foreign = corpus_weights(files, vocabulary)
    vectors = [{w: n * idf[w] for w, n in bag.items()} for bag in bags]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    needed = [NEEDED.get(t, frozenset()) for t in templates]
    some = F.array(*[F.lit(a) for a in anchors(vectors, threshold, needed, idf)])
    anchored = lambda c: F.arrays_overlap(F.split(F.lower(c), NOT_WORD), some)
    postings = spark.createDataFrame(
        [(w, t, x / norm, idf[w], int(w in needed[t]), len(needed[t])) for t, (v, norm) in enumerate(zip(vectors, norms)) for w, x in v.items()],
        "term string, template int, y double, idf double, has int, needs int",
    )
    weights = F.broadcast(postings.select("term", "idf").distinct())  # bounded by the templates
    with_anchor = files.where(anchored("text"))
    lines = with_anchor.select("key", F.posexplode(F.split("text", "\n")).alias("no", "unit")).where(anchored("unit"))
    units = lines.union(with_anchor.select("key", F.lit(-1).alias("no"), F.col("text").alias("unit")))
    terms = units.select("key", "no", F.explode(words(F.col("unit"))).alias("term")).groupBy("key", "no", "term").agg(F.count(F.lit(1)).alias("tf"))
    terms = stored(terms.join(weights, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(foreign))), "unit-terms")
    length = terms.groupBy("key", "no").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = terms.join(F.broadcast(postings.drop("idf")), "term").groupBy("key", "no", "template", "needs").agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum("has").alias("has"))
    dots = dots.where("has = needs")
    names = F.array(*[F.lit(name) for name, _ in templates])
    scored = dots.join(length, ["key", "no"]).select(
        "key", "no", F.get(names, F.col("template")).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("score")
    )
    scored = scored.where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), "license", "no")).alias("best")
    return scored.groupBy("key").agg(best).select(
        "key", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"),
        F.when(F.col("best.no") < 0, "file").otherwise("line").alias("unit"),
    )


def folder(path: Column) -> Column:
    """The directory above a path, the empty text at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def license_scan(files: DataFrame, path: str = "path", text: str = "text", is_license_file: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: path, license, score, origin ('own', 'inherited' or NULL), origin_path (the directory inherited from).

    ``is_license_file`` says, by path, license and score, which files speak for their directory; by default those named
    LICENSE, LICENCE, COPYING, NOTICE or UNLICENSE.
    """
    named = F.col("path").rlike(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$")
    speaks = named if is_license_file is None else is_license_file
    key = F.xxhash64("path", "text")  # rows of one path and text share their result
    files = own_names(files, path=path, text=text).withColumn("key", key)
    own = stored(own_licenses(files.select("key", "text").where("text IS NOT NULL"), templates, threshold), "own-licenses")
    paths = files.select("path", "key")
    carrying = paths.join(own, "key")
    best = F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("best")
    folders = carrying.where(F.col("path").isNotNull() & speaks).groupBy(folder(F.col("path")).alias("folder")).agg(best)
    folders = stored(folders.select("folder", F.col("best.license").alias("given"), (-F.col("best.s")).alias("given_score")), "folders")
    # Every directory that files stand in, and its ancestors, nearest first.
    places = paths.where("path IS NOT NULL").select(folder(F.col("path")).alias("place")).distinct()
    parts = F.split("place", "/")
    levels = F.when(F.col("place") == "", F.array(F.lit(0))).otherwise(F.sequence(F.size(parts), F.lit(0), F.lit(-1)))
    above = places.select("place", F.explode(levels).alias("level")).withColumn("folder", F.array_join(F.slice(F.split("place", "/"), 1, F.col("level")), "/"))
    nearest = above.join(folders, "folder").groupBy("place").agg(F.max(F.struct("level", "folder", "given", "given_score")).alias("near"))
    placed = paths.join(own, "key", "left").withColumn("place", folder(F.col("path"))).join(nearest, "place", "left")
    mine = F.col("license").isNotNull()
    return placed.select(
        "path",
        F.coalesce("license", "near.given").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("near.given_score")).alias("score"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("near.folder")).alias("origin_path"),
        "unit",
    )
