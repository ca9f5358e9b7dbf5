"""License scans: TF-IDF cosine of notices to templates, then inheritance along directories.

Units are compared, not whole files: single lines and paragraphs that speak of licensing, windows of the templates' lengths
in long ones, and the text of files
named as licence files. A unit is a sparse vector of words, weighted by their rarity among the
templates; its best template above a threshold is its licence, if family words and versions agree. Files without one of their own inherit from the licence file in the nearest
directory above: distinct directories are joined with their ancestors, never files with files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import durable
from loomgraph.llm.frames import map_rows

LEAST_COSINE = 0.6
# Lines and paragraphs up to this length are compared as they are; from the second length on in windows, too.
UNIT_CHARS = 4_000
WINDOW_CHARS = 200

# Wording of common licences, as statements and as notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]
# Words that tell licences of one family apart; a notice has those of its template and no others.
FAMILY_WORDS = ("lesser", "affero", "library", "sharealike", "noncommercial", "noderivatives", "sa", "nc", "nd", "endorse", "cc0")
# Versions and short names have to be there, but others may stand beside them.
NEEDED_WORDS = r"\d+(\.\d+)*|mit|apache|mozilla|isc"
ANCHOR = r"licen[cs]ed?|copyright|spdx|permission|redistributions?|warranty|domain|commons|waived"
SPEAKS_OF_LICENSING = r"(?i)licen[cs]e|copyright|spdx|creative commons|public domain|permission to use|permission is hereby|without warrant|redistribution and use"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _vectors() -> tuple[list[dict[str, float]], dict[str, float], float]:
    """The templates as unit-length vectors, the idf of their words, and the idf of all other words."""
    found = [Counter(words(text)) for _, text in TEMPLATES]
    times = Counter(w for counts in found for w in counts)
    idf = {w: math.log((1 + len(found)) / (1 + n)) + 1 for w, n in times.items()}
    vectors = []
    for counts in found:
        weights = {w: (1 + math.log(n)) * idf[w] for w, n in counts.items()}
        length = math.sqrt(sum(v * v for v in weights.values()))
        vectors.append({w: v / length for w, v in weights.items()})
    return vectors, idf, math.log(1 + len(found)) + 1


def template_weights(spark: SparkSession) -> tuple[DataFrame, float]:
    """``word, idf, vector`` of the templates' vocabulary, where ``vector`` holds (template, unit-length weight), and the idf of
    all other words. Its size is fixed by TEMPLATES."""
    vectors, idf, other = _vectors()
    rows: dict[str, list[tuple[int, float]]] = {}
    for t, vector in enumerate(vectors):
        for w, v in vector.items():
            rows.setdefault(w, []).append((t, v))
    table = spark.createDataFrame([(w, idf[w], v) for w, v in sorted(rows.items())], "word string, idf double, vector array<struct<template: int, weight: double>>")
    return table, other


def _anchored() -> dict[str, list[tuple[int, int, int]]]:
    """For each word that speaks of licensing: its places in the templates, as (template, words before it, words in all)."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for t, (_, text) in enumerate(TEMPLATES):
        own = words(text)
        for at, word in enumerate(own):
            if re.fullmatch(ANCHOR, word):
                found.setdefault(word, []).append((t, at, len(own)))
    return found


def windows(text: str, least: float, anchored: dict[str, list[tuple[int, int, int]]], vectors: list[dict[str, float]]) -> Iterator[str]:
    """Stretches of a text as long as a template, laid so that a word of licensing stands where the template has it.

    By Cauchy and Schwarz a cosine is at most the length of the template's vector over the words they share: stretches
    that cannot reach ``least`` are left out."""
    places = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(WORD, text, re.IGNORECASE | re.ASCII)]
    seen = set()
    for i, (word, _, _) in enumerate(places):
        for t, before, n in anchored.get(word, ()):
            a, b = max(0, i - before), min(len(places), i - before + n)
            if (a, b) not in seen:
                vector = vectors[t]
                if sum(vector.get(w, 0.0) ** 2 for w in {p[0] for p in places[a:b]}) >= least * least - 1e-6:
                    seen.add((a, b))
                    yield text[places[a][1] : places[b - 1][2]]


def _units(rows: Iterator[tuple], least: float) -> Iterator[tuple]:
    anchored, vectors = _anchored(), _vectors()[0]
    speaks = re.compile(SPEAKS_OF_LICENSING)
    for key, whole, text in rows:
        parts = [*re.split(r"\r?\n", text), *re.split(r"\r?\n[ \t]*\r?\n", text)]
        parts = [x for x in dict.fromkeys(parts) if speaks.search(x)]
        if whole and text not in parts:
            parts.append(text)
        found = dict.fromkeys(x for x in parts if len(x) <= UNIT_CHARS)
        found |= dict.fromkeys(w for x in parts if len(x) > WINDOW_CHARS for w in windows(x, least, anchored, vectors))
        for n, unit in enumerate(found):
            yield key, n, unit


def units(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``key, unit, part``: what of each file (``key, whole, text``) is compared. Distinct lines and paragraphs that speak of
    licensing, and the text of a file that is ``whole`` a licence, up to ``UNIT_CHARS`` characters; of all longer than
    ``WINDOW_CHARS``, however long, the windows that may reach ``least``."""
    return map_rows(files.select("key", "whole", "text"), lambda rows: _units(rows, least), "key long, unit int, part string")


def own_licenses(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``key, license, score`` of the rows of ``files`` (``key, name, text``) with a notice close enough to a template.

    Family words and versions of notice and template have to agree. Ties go to the licence first in the alphabet; a key
    that repeats counts once."""
    whole = F.coalesce(F.col("name").rlike(LICENSE_FILE), F.lit(False)).alias("whole")
    speaking = files.where(F.col("text").rlike(SPEAKS_OF_LICENSING) | (whole & F.col("text").isNotNull()))
    parts = units(speaking.select("key", whole, "text").dropDuplicates(["key"]), least)
    tokens = parts.select("key", "unit", F.explode(F.regexp_extract_all(F.lower("part"), F.lit(WORD), 0)).alias("word"))
    counts = tokens.groupBy("key", "unit", "word").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    vocabulary, other = template_weights(files.sparkSession)
    weighed = counts.join(F.broadcast(vocabulary), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    # One pass per unit gives its length and its product with every template.
    products = [F.sum(F.col("w") * _weight_of(t)).alias(f"t{t}") for t in range(len(TEMPLATES))]
    telling = sorted({w for _, text in TEMPLATES for w in _telling(text)} | set(FAMILY_WORDS))
    marks = F.collect_set(F.when(F.col("word").isin(telling), F.col("word"))).alias("marks")
    scored = weighed.groupBy("key", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"), marks, *products)
    agreeing = [F.when(_agrees(text), F.struct(F.round(F.col(f"t{t}") / F.col("length"), 6).alias("score"), F.lit(-rank).alias("rank"))) for t, ((_, text), rank) in enumerate(zip(TEMPLATES, _ranks(), strict=True))]
    top = scored.select("key", F.array_max(F.array(*agreeing)).alias("best")).groupBy("key").agg(F.max("best").alias("best")).where(F.col("best.score") >= least)
    names = F.array(*(F.lit(name) for name in sorted({name for name, _ in TEMPLATES})))
    return top.select("key", F.element_at(names, (1 - F.col("best.rank")).cast("int")).alias("license"), F.col("best.score").alias("score"))


def _telling(text: str) -> set[str]:
    """A template's own family words, versions and short names."""
    return {w for w in words(text) if w in FAMILY_WORDS or re.fullmatch(NEEDED_WORDS, w)}


def _agrees(text: str) -> Column:
    """Whether a unit's ``marks`` hold all telling words of a template and no family word that it lacks."""
    own = _telling(text)
    needed = [F.array_contains("marks", w) for w in sorted(own)]
    barred = [~F.array_contains("marks", w) for w in FAMILY_WORDS if w not in own and w not in words(text)]
    return reduce(lambda a, b: a & b, needed + barred)


def _weight_of(template: int) -> Column:
    """A word's weight in a template."""
    own = F.filter("vector", lambda v: v["template"] == template)
    return F.coalesce(F.aggregate(own, F.lit(0.0), lambda a, v: a + v["weight"]), F.lit(0.0))


def _ranks() -> list[int]:
    names = sorted({name for name, _ in TEMPLATES})
    return [names.index(name) for name, _ in TEMPLATES]


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``doc_id, path, license, score, origin, inherited_from`` of each row of ``files`` (``doc_id, path, text``).

    ``origin`` is ``own`` for a file with a notice, ``inherited`` for one below a licence file that has one (the nearest; in
    one directory the best score, then the first path), else ``none``. Null and empty texts have no notice and may
    inherit; a null path inherits nothing; repeated rows and null ids are rows like others; an empty table gives no rows;
    other columns are ignored."""
    path = F.col("path")
    rows = files.select(F.xxhash64("doc_id", "path", "text").alias("key"), "doc_id", "path", F.element_at(F.split(path, "/"), -1).alias("name"), "text")
    own = durable.cut(own_licenses(rows.select("key", "name", "text"), least))
    placed = durable.cut(rows.select("key", "doc_id", "path", "name", _folder(path).alias("folder")))
    known = placed.join(own, "key", "left_semi").dropDuplicates(["key"]).join(own, "key")
    licensed = known.where(F.col("name").rlike(LICENSE_FILE))
    first = licensed.groupBy("folder", "score").agg(F.min(F.struct("path", "license")).alias("named"))
    giving = first.groupBy("folder").agg(F.max_by("named", "score").alias("named")).select(F.col("folder").alias("above"), F.col("named.license").alias("license"), F.col("named.path").alias("path"))
    folders = placed.where("path is not null").select("folder").distinct()
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chains = folders.select("folder", F.explode(F.array_distinct(above)).alias("above"))
    nearest = (
        chains.join(giving, "above")
        .groupBy("folder")
        .agg(F.max_by(F.struct("license", "path"), F.length("above")).alias("from"))
        .select("folder", F.col("from.license").alias("given"), F.col("from.path").alias("inherited_from"))
    )
    # A folder may hold very many files: AQE splits its partition, as the session's settings ask for.
    found = placed.join(nearest, "folder", "left").join(own, "key", "left")
    has, gets = F.col("license").isNotNull(), F.col("given").isNotNull() & F.col("path").isNotNull()
    return found.select(
        "doc_id",
        "path",
        F.when(has, F.col("license")).when(gets, F.col("given")).alias("license"),
        "score",
        F.when(has, "own").when(gets, "inherited").otherwise("none").alias("origin"),
        F.when(~has & gets, F.col("inherited_from")).alias("inherited_from"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: sources hold languages, these hold folders of 200 ids; of every 50 ids one is
    its folder's licence file."""
    doc = F.col("doc_id")
    name = F.when(doc % 50 == 0, F.concat(F.lit("LICENSE."), doc)).otherwise(F.concat(doc, F.lit(".txt")))
    folder = F.when(doc % 1000 == 0, F.col("source")).otherwise(F.concat_ws("/", "source", "lang", F.floor(doc / 200)))
    return docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")
