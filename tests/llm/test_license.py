import math
import re
from collections import Counter

import pytest

from fieldloom.llm.license_scan import STOP, TEMPLATES, THRESHOLD, license_scan, scores, telling, template_weights, terms, vocabulary
from fieldloom.llm.queries import QUERIES, SQL
from tests.llm.helpers import as_rows, oracle


def cosine(a, b):
    idf, rare = vocabulary()
    x, y = ({w: c * idf.get(w, rare) for w, c in Counter(terms(t)).items()} for t in (a, b))
    return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


FILES = [
    ("a/LICENSE", "Some words. Licensed under the Apache License, Version 2.0."),
    ("a/x.txt", "nothing to see"), ("a/b/y.txt", None), ("a/b/COPYING.md", "first line\nReleased under the MIT License.\nlast line"),
    ("a/b/c/d/z.txt", ""), ("a/b/c/w.txt", "Licensed under CC BY-NC 4.0."), ("LICENSE", "This work is licensed under the GNU General Public License, version 3."),
    ("top.txt", "text"), ("ab/x.txt", "the public work of general versions"), (None, "Released under the ISC License."), (None, "Released under the ISC License."),
    ("a/x.txt", "a second row of the file"), ("q/LICENCE", "no licence named here"), ("q/r.txt", "x"), ("LICENSES/f.txt", " "),
]


def scan(spark, rows):
    frame = spark.createDataFrame([(p, t, "u", 1) for p, t in rows], "path string, text string, licence string, unit int")
    return {r.path: (r.licence, r.origin, r.origin_path) for r in license_scan(frame).collect()}


def test_headers_and_nearest_directory(spark):
    gpl = ("GPL-3.0", "inherited", "")
    assert scan(spark, FILES) == {
        "a/LICENSE": ("Apache-2.0", "header", "a/LICENSE"), "a/x.txt": ("Apache-2.0", "inherited", "a"), "a/b/y.txt": ("MIT", "inherited", "a/b"),
        "a/b/COPYING.md": ("MIT", "header", "a/b/COPYING.md"), "a/b/c/d/z.txt": ("MIT", "inherited", "a/b"),
        "a/b/c/w.txt": ("CC-BY-NC-4.0", "header", "a/b/c/w.txt"), "LICENSE": ("GPL-3.0", "header", "LICENSE"), "top.txt": gpl, "ab/x.txt": gpl,
        None: ("ISC", "header", None), "q/LICENCE": gpl, "q/r.txt": gpl, "LICENSES/f.txt": gpl,
    }


def units(path, text):
    """Headers, sentences and lines, and the whole text of a licence file."""
    out = re.split(r"\n[\W\d_]*\n", text) if not re.search(r"\n[^\n]*[0-9][^\n]*\n", text) else re.split(r"\n[^A-Za-z0-9]*\n", text)
    return out + re.split(r"[.!?;][\x20\x09-\x0D]+|\n", text) + ([text] if re.match(r"(?i)(licen[sc]e|copying|notice)([.-].*)?$", path.split("/")[-1]) else [])


@pytest.mark.parametrize("threshold", [0.05, THRESHOLD, 0.9])
def test_scores_are_cosines_of_the_best_unit(spark, threshold):
    said = [t for _, t in TEMPLATES] + ["Licensed under a License like the Apache License of old", "version 3 of the public licence", "license license"]
    said += [f"Some first words.\n{t}\n\nand more prose\nlicense" for _, t in TEMPLATES[::3]] + ["\n * ".join(t.split()) for _, t in TEMPLATES[::4]]
    files = [(f"{n}/LICENSE" if n % 3 == 0 else f"{n}/a.txt", t) for n, t in enumerate(said)]
    got = {r.path: r.score for r in scores(spark.createDataFrame(files, "path string, text string"), threshold).collect()}
    for path, text in files:
        best = max(cosine(u, t) for u in units(path, text) if terms(u) for _, t in TEMPLATES)
        assert abs(got[path] - best) < 6e-4 if best >= threshold + 6e-4 else got.get(path, 0) <= best + 6e-4


GPL_3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
LGPL_21 = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *"""
ISC = """Copyright (c) 2001, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL_2_FILE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed."""


@pytest.mark.parametrize("path,text,licence", [
    ("a.py", GPL_3, "GPL-3.0"), ("a.c", LGPL_21, "LGPL-2.1"), ("a.js", ISC, "ISC"), ("a.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"),
    ("a.go", "# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("x/LICENSE", GPL_2_FILE, "GPL-2.0"), ("LICENSE", GPL_2_FILE.replace("2, June 1991", "3, 29 June 2007"), "GPL-3.0"),
    ("p.txt", "words\nThis work is licensed under a Creative Commons Attribution 4.0 International License.\nwords", "CC-BY-4.0"),
    ("LICENSE.md", "\n\n".join(t for n, t in TEMPLATES if n == "BSD-2-Clause" and "SOFTWARE IS" in t), "BSD-2-Clause"),
    ("LICENSE.txt", next(t for n, t in TEMPLATES if n == "BSD-3-Clause" and "SOFTWARE IS" in t).replace(". ", ".\n\n"), "BSD-3-Clause"),
    ("n.txt", "SPDX-License-Identifier: Other-9", None), ("n.txt", "The public may use the general work of any person, free of charge.", None),
])
def test_real_headers_and_licence_files(spark, path, text, licence):
    assert scan(spark, [(path, text)])[path][0] == licence


def test_many_lines_in_a_small_heap(spark):
    """Units carry their own words only: 20,000 telling lines of one text."""
    text = "\n".join(f"line {n} Released under the MIT License" for n in range(20_000))
    assert scan(spark, [("a/LICENSE", text), ("a/b", None)])["a/b"] == ("MIT", "inherited", "a")


def test_ties_long_and_empty(spark):
    both = [("d/LICENSE", "Released under the MIT License."), ("d/COPYING", "Released under the MIT License."), ("d/f", "w " * 200_000)]
    assert scan(spark, both)["d/f"] == ("MIT", "inherited", "d")
    frame = spark.createDataFrame([("a", "b")], "path string, text string")
    assert license_scan(frame.limit(0)).count() == 0


def test_templates_have_unit_length():
    weights = template_weights()
    for n in range(len(TEMPLATES)):
        assert abs(sum(w * w for k, *_, w in weights if k == n) - 1) < 1e-9
    assert not {w for _, _, w, _ in weights} & set(STOP)


def test_units_without_a_telling_term_cannot_reach_the_threshold():
    assert len(telling(THRESHOLD)) < len(vocabulary()[0]) == len(telling(0.01))
    for n in range(len(TEMPLATES)):
        shared = [(w, s) for k, _, w, s in template_weights() if k == n and w not in telling(THRESHOLD)]
        assert sum(s * s for _, s in shared) ** 0.5 < THRESHOLD


def test_null_sources_are_files_of_their_own(spark, tmp_path):
    mit = "Released under the MIT License."
    rows = [(101, mit, None), (102, "words only", None), (203, "words only", "web"), (300, mit, None), (301, "words only", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_license_scan"](spark, str(tmp_path)).toPandas()
    assert as_rows(got) == as_rows(oracle(SQL["op7_license_scan"], str(tmp_path)))
    assert dict(zip(got.doc_id, got.origin)) == {101: "header", 102: "none", 203: "none", 300: "header", 301: "inherited"}
