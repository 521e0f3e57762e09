"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file's units are its headers (runs of neighbouring lines, between blank ones), its sentences
and lines, and, where its name is that of a licence file, the whole text.  In a header or a
whole text a line feed is a space.  A unit that shares a term with a template is scored against
each template, whole headers and licence texts among them, by the cosine of their TF-IDF
vectors; terms that no template has count as rare ones.  A file has the licence of its best
unit.  Files without one inherit from the licence file (LICENSE, COPYING, NOTICE, with any
suffix) of the nearest directory above them.  Directories are resolved once each, by joining
their ancestors' paths with the directories of licence files, and files join their own directory.

DataFrame functions only; the templates are a fixed, small table.  Units are filtered inside
their row, so only those that can reach the threshold are exploded.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import stored

THRESHOLD = 0.6

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:")
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:")
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.")
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.")
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
    "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")


def _gnu_header(name: str, version: str) -> str:
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        f"{name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")


# fixed values: headers, titles, licence texts and sentences by which public licences are declared
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT) Copyright (c)"),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _gnu_header("GNU General Public License", "3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _gnu_header("GNU General Public License", "2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _gnu_header("GNU Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", _gnu_header("GNU Lesser General Public License", "2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _gnu_header("GNU Affero General Public License", "3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", _BSD_GRANT),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_CLAUSES} {_BSD_NAME} {_BSD_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC_GRANT),
    ("ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *[(name, f"SPDX-License-Identifier: {name}{form}") for name, forms in [
        ("MIT", [""]), ("Apache-2.0", [""]), ("GPL-2.0", ["", "-only", "-or-later"]), ("GPL-3.0", ["", "-only", "-or-later"]),
        ("LGPL-2.1", ["", "-only", "-or-later"]), ("LGPL-3.0", ["", "-only", "-or-later"]), ("AGPL-3.0", ["", "-only", "-or-later"]),
        ("BSD-2-Clause", [""]), ("BSD-3-Clause", [""]), ("MPL-2.0", [""]), ("CC-BY-4.0", [""]), ("CC-BY-SA-4.0", [""]),
        ("CC-BY-NC-4.0", [""]), ("CC0-1.0", [""]), ("ISC", [""]), ("Unlicense", [""])] for form in forms],
]
# fixed values: words that say nothing about a licence
STOP = "a an and any are at be by for from in is it its may not of on or that the this to under use was with without work you".split()

# fixed values: template terms that ordinary prose is full of
COMMON = (
    "public general file form person version source software free work code name purpose terms conditions provided permission "
    "copyright notice rights permitted following above see copies obtain find found other data loss use").split()

HEADER_BREAK = r"\n[^\p{L}0-9]*\n"    # a blank line, or one of comment marks only
UNIT_BREAK = r"[.!?;][\x20\x09-\x0D]+|\n"
TERM_BREAK = r"[^\p{L}0-9.-]+"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)([.-].*)?$"


def terms(text: str) -> list[str]:
    found = (w.strip(".-") for w in re.split(r"[^\w.-]+", text.lower()))
    return [w for w in found if w and w not in STOP]


def vocabulary() -> tuple[dict[str, float], float]:
    """Inverse document frequency of each template term, and that of any other term."""
    n = len(TEMPLATES)
    df = Counter(w for _, t in TEMPLATES for w in set(terms(t)))
    return {w: math.log((1 + n) / (1 + d)) + 1 for w, d in sorted(df.items())}, math.log(1 + n) + 1


def template_weights() -> list[tuple[int, str, str, float]]:
    """(template, licence, term, weight) with vectors of length one."""
    idf, _ = vocabulary()
    out = []
    for n, (licence, text) in enumerate(TEMPLATES):
        tf = Counter(terms(text))
        norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
        out += [(n, licence, w, c * idf[w] / norm) for w, c in sorted(tf.items())]
    return out


def telling(threshold: float) -> list[str]:
    """Terms of which a unit must have one to reach the threshold.

    The cosine is at most the length of the template's part that the unit shares.  Common
    terms are set aside one by one while their part of every template stays shorter than
    the threshold; a unit with no other term cannot reach it.
    """
    aside: set[str] = set()
    for word in COMMON:
        parts: dict[int, float] = {}
        for n, _, w, share in template_weights():
            parts[n] = parts.get(n, 0.0) + share ** 2 * (w in aside | {word})
        if max(parts.values()) < (threshold - 0.001) ** 2:
            aside.add(word)
    return [w for w in vocabulary()[0] if w not in aside]


def unit_terms(unit: Column) -> Column:
    cleaned = F.transform(F.split(F.lower(unit), TERM_BREAK), lambda w: F.btrim(w, F.lit(".-")))
    return F.filter(cleaned, lambda w: (w != "") & ~w.isin(STOP))


def telling_units(parts: Column, kind: int, threshold: float) -> Column:
    """The units among a text's parts that can reach the threshold: (kind, unit, words).

    A unit needs a telling term.  With v terms of the templates and o other ones, its cosine is
    at most v / sqrt(v * v + o), as no term weighs more than another one.
    """
    need, known, words_of = max(threshold - 0.001, 0) ** 2, list(vocabulary()[0]), telling(threshold)
    units = F.transform(parts, lambda x, n: F.struct(F.lit(kind).alias("kind"), n.alias("unit"), unit_terms(x).alias("words")))

    def reaches(u: Column) -> Column:
        v = F.size(F.filter(u["words"], lambda w: w.isin(known))).cast("double")
        return F.exists(u["words"], lambda w: w.isin(words_of)) & (v * v * (1 - need) >= (F.size(u["words"]) - v) * need)

    return F.filter(units, reaches)


def scores(files: DataFrame, threshold: float) -> DataFrame:
    """(path, licence, score, kind, unit) of each file with a unit at or above the threshold: its best one."""
    idf, rare = vocabulary()
    spark = files.sparkSession
    text = F.coalesce("text", F.lit(""))
    whole = F.when(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE), F.array(text)).otherwise(F.array().cast("array<string>"))
    # every term of a header or a whole text is in one of its lines, so texts without a telling line are read once
    any_line = F.exists(F.split(text, UNIT_BREAK), lambda x: F.exists(unit_terms(x), lambda w: w.isin(telling(threshold))))
    units = F.when(any_line, F.concat(
        telling_units(F.split(text, HEADER_BREAK), 0, threshold), telling_units(F.split(text, UNIT_BREAK), 1, threshold), telling_units(whole, 2, threshold)))
    # rows that share a path but not a text have units of their own; equal rows only scale their vectors.
    # hash and units stand below the generator, so that no exploded row carries the text
    own = ["path", "body", "kind", "unit"]
    held = files.select("path", F.xxhash64("text").alias("body"), units.alias("units")).where(F.size("units") > 0)
    units = held.select("path", "body", F.inline("units")).where(F.size("words") > 0)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in idf.items() for x in p]), F.col("word")), F.lit(rare))
    tf = units.select(*own, F.explode("words").alias("word")).groupBy(*own, "word").agg(F.count("*").alias("tf"))
    weighed = tf.select(*own, "word", (F.col("tf") * weight).alias("w"))
    normed = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*own))))
    # some thousand fixed rows
    templates = F.broadcast(spark.createDataFrame(template_weights(), "template int, licence string, word string, share double"))
    dots = normed.join(templates, "word").groupBy(*own, "norm", "template", "licence").agg(F.sum(F.col("w") * F.col("share")).alias("dot"))
    cosine = dots.select("path", "kind", "unit", "licence", F.round(F.col("dot") / F.col("norm"), 3).alias("score"))
    # the best score, then the first header, sentence or text, then the first licence by name
    best = F.min(F.struct((-F.col("score")).alias("s"), "kind", "unit", "licence"))
    return cosine.where(F.col("score") >= threshold).groupBy("path").agg(best.alias("b")).select(
        "path", "b.licence", (-F.col("b.s")).alias("score"), "b.kind", "b.unit")


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def license_scan(
    files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each distinct path: path, licence, score, origin and origin_path.

    origin is "header" (a unit of the file, or of the licence file itself), "inherited" (with the
    licence file's directory as origin_path) or "none".  Rows that share a path are one file; a
    null path is a file in the directory "" that nothing but its own units licenses.  Null and
    empty texts have no unit.  Of licence files in one directory the better score counts, then
    the first licence and path by name.  Other columns are not read.  An empty table gives no rows.
    """
    own = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    # written, as the texts would be read again for each of its uses
    found = stored(scores(own, threshold), "licence-scores")
    paths = own.select("path").distinct().withColumn("dir", folder(F.col("path")))
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILE)
    declared = found.where(named).select(folder(F.col("path")).alias("at"), "licence", "score", "path").groupBy("at").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence", "path")).alias("b")).select("at", "b.licence", (-F.col("b.s")).alias("score"))
    dirs = paths.where("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("at"))
    nearest = above.join(declared, "at").groupBy("dir").agg(F.max_by(F.struct("licence", "score", "at"), F.length("at")).alias("up"))
    joined = paths.alias("p").join(found.alias("f"), F.expr("p.path <=> f.path"), "left").join(nearest.alias("n"), F.expr("p.dir = n.dir AND p.path IS NOT NULL"), "left")
    has, up = F.col("f.licence").isNotNull(), F.col("n.up").isNotNull()
    return joined.select(
        F.col("p.path").alias(path_col), F.coalesce("f.licence", "n.up.licence").alias("licence"), F.coalesce("f.score", "n.up.score").alias("score"),
        F.when(has, "header").when(up, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("p.path")).otherwise(F.col("n.up.at")).alias("origin_path"))
