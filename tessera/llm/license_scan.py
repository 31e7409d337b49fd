"""Licence scan: sparse TF-IDF cosine of file lines to licence templates, then
inheritance from the nearest directory that holds a licence file.

Units of a file are its lines, its paragraphs of several lines (runs of lines
with a letter or digit, so that comment marks do not matter), the comment block
it begins with, and, of a licence file, its whole text. A file's own licence is
that of its best unit at or above ``threshold``. A file without one takes the
licence of the nearest ancestor directory (its own first) in which a licence
file was recognised. Templates are notices of a line, headings, SPDX tags, and
headers and licence texts of several lines.

A word's weight is (1 + ln tf) * idf, idf = 1 + ln((1 + N) / (1 + df)) with df
counted over all files, for the words of the templates and all words of the
units scored. Few lines can reach the threshold, and they are found exactly:
without a template's heaviest words, up to where the rest's norm falls below
the threshold, no unit can reach it (prefix filtering). Only units that hold
such a word are looked at, and of these only units are scored whose dot product
reaches the threshold for the least norm that their words allow.

All of it is DataFrame functions. The templates are a fixed short list;
corpus tables are joined on words and directories only. Ancestors are joined
once for each distinct directory, so a directory that holds a third of all
files costs one row.

Edge cases. A null text has no own licence; a null path has no directory and
inherits nothing, but a text of its own counts. Files are told apart by path
and text, so two of one path keep their own licences. Ties go to the template of smaller name; of two licence
files in one directory the higher score counts, then the smaller licence
name, then the smaller path. Repeated rows are scanned alike. Empty tables
give empty results. Extra columns are not read.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

# Notices that declare a licence, one per licence or wording.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
)
# Titles of licence texts.
HEADINGS = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)
# SPDX names and the licence they stand for.
SPDX = (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-3.0-only", "GPL-3.0"), ("GPL-3.0-or-later", "GPL-3.0"),
        ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0"), ("CC-BY-4.0", "CC-BY-4.0"),
        ("CC-BY-NC-4.0", "CC-BY-NC-4.0"))
# Headers and licence texts of several lines, without copyright lines.
TEXTS = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
)
TEMPLATES = NOTICES + HEADINGS + tuple((name, f"SPDX-License-Identifier: {tag}") for tag, name in SPDX) + TEXTS
THRESHOLD = 0.7
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying)(\.[a-z]+)?$"
_COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)"  # a line of a comment
_TOKEN = r"[^\p{L}\p{N}.-]+"


def _tokens(text: Column) -> Column:
    """Lower-case words, without dots and hyphens at their ends."""
    return F.array_remove(F.transform(F.split(F.lower(text), _TOKEN), lambda w: F.regexp_replace(
        w, r"^[.-]+|[.-]+$", "")), "")


def _template_words() -> list[dict[str, int]]:
    import re
    out = []
    for _, text in TEMPLATES:
        tf: dict[str, int] = {}
        for w in re.split(r"[^\w.-]+", text.lower()):
            if w := w.strip(".-"):
                tf[w] = tf.get(w, 0) + 1
        out.append(tf)
    return out


def _file_words(files: DataFrame, text_col: str) -> Column:
    """The words of a file, '' among them; none for a null text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return F.split(F.lower(text), r"[.-]*[^\p{L}\p{N}.-]+[.-]*|^[.-]+|[.-]+$")


def document_frequencies(files: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and how many of them hold each template word."""
    vocabulary = sorted({w for t in _template_words() for w in t})
    held = F.array_intersect(_file_words(files, text_col), F.array(*(F.lit(w) for w in vocabulary)))
    rows = (files.select(F.explode(F.concat(held, F.array(F.lit(None).cast("string")))).alias("w"))
            .groupBy("w").agg(F.count("*").alias("n")).collect())  # the vocabulary, and null for all files
    df = {r["w"]: r["n"] for r in rows}
    return df.pop(None, 0), df


def unit_idf(files: DataFrame, units: DataFrame, n_files: int, text_col: str = "text") -> DataFrame:
    """(word, idf) of every word of the units, counted over all files."""
    wanted = units.select(F.explode("words").alias("word")).distinct()
    held = files.select(F.explode(F.array_distinct(_file_words(files, text_col))).alias("word"))
    # Counted before the join: a task hands on each word once, however many files hold it.
    df = held.groupBy("word").agg(F.count("*").alias("df")).join(wanted, "word")
    return df.select("word", (1 + F.log(F.lit(1.0 + n_files) / (1 + F.col("df")))).alias("idf"))


class Weights:
    """Idf and template vectors, from the corpus frequencies."""

    def __init__(self, n_files: int, df: dict[str, int], threshold: float):
        words = _template_words()
        self.idf = {w: 1 + math.log((1 + n_files) / (1 + df.get(w, 0))) for t in words for w in t}
        self.vectors, self.anchors, self.threshold = [], set(), threshold
        for t in words:
            v = {w: (1 + math.log(n)) * self.idf[w] for w, n in t.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            v = {w: x / norm for w, x in v.items()}
            self.vectors.append(v)
            rest = 1.0
            for w in sorted(v, key=lambda w: (-v[w], w)):
                if rest < threshold * threshold * (1 - 1e-9):
                    break
                self.anchors.add(w)
                rest -= v[w] * v[w]


def _key(path: Column, text: Column) -> Column:
    """Names a file by its path and text."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), path), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def _comment_block(text: Column) -> Column:
    """The comment a text begins with; null if it begins otherwise."""
    lines = F.split(text, "\n")
    n = F.array_position(F.transform(lines, lambda x: x.rlike(_COMMENT)), False).cast("int")
    return F.when(text.rlike(_COMMENT), F.when(n == 0, text).otherwise(
        F.array_join(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), "\n")))


def _within_reach(weights: Weights, words: Column) -> Column:
    """Whether a unit may reach the threshold. Its dot products with the templates
    and the weight of its template words are exact; every other distinct word adds
    at least 1 to the square of its norm, for an idf is never below 1."""
    table = {w: {"idf": idf, "x": [v.get(w, 0.0) for v in weights.vectors]} for w, idf in sorted(weights.idf.items())}
    known = F.from_json(F.lit(json.dumps(table)), "map<string, struct<idf: double, x: array<double>>>")
    held = F.array_intersect(words, F.map_keys(known))
    parts = F.transform(held, lambda w: F.struct(
        F.element_at(known, w).alias("t"),
        (1 + F.log(F.size(F.filter(words, lambda x: x == w)).cast("double"))).alias("tf")))
    parts = F.transform(parts, lambda p: F.struct((p["tf"] * p["t"]["idf"]).alias("y"), p["t"]["x"].alias("x")))
    dots = F.aggregate(parts, F.array_repeat(F.lit(0.0), len(weights.vectors)),
                       lambda acc, p: F.zip_with(acc, p["x"], lambda a, x: a + x * p["y"]))
    square = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["y"] * p["y"])
    others = F.size(F.array_distinct(words)) - F.size(held)
    least = weights.threshold - 1e-6  # scores are rounded to six digits
    return F.pow(F.array_max(dots), F.lit(2.0)) >= F.lit(least * least) * (square + others)


def units(files: DataFrame, weights: Weights, path_col: str, text_col: str) -> DataFrame:
    """(key, path, words) of the units that hold an anchor word and may reach
    the threshold."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(weights.anchors):
        by_first.setdefault(w[0], []).append(_quoted(w[1:]))
    anchor = (r"(?<![\p{L}\p{N}])(?:" + "|".join(f"{_quoted(c)}(?:{'|'.join(ws)})" for c, ws in by_first.items())
              + r")(?![\p{L}\p{N}])")
    path, text = F.col(f"`{path_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    held = F.lower("part").rlike(anchor)
    # lines without a letter or digit part paragraphs; no unit but the last two kinds spans them
    parts = files.select(_key(path, text).alias("key"), path.alias("path"), F.explode(F.split(
        text, r"\n[^\p{L}\p{N}]*\n")).alias("part")).where(held)
    lines = parts.select("key", "path", F.explode(F.array_distinct(F.concat(
        F.array("part"), F.split("part", "\n")))).alias("part")).where(held)
    whole = F.when(path.rlike(LICENCE_FILE), text)
    wide = files.select(_key(path, text).alias("key"), path.alias("path"), F.explode(F.array_distinct(F.array_compact(
        F.array(whole, _comment_block(text))))).alias("part")).where(held)
    # filtered inside the generator, so that a unit is cut into words once
    return lines.unionByName(wide).select("key", "path", F.explode(F.filter(
        F.array(_tokens(F.col("part"))), lambda words: _within_reach(weights, words))).alias("words"))


def _quoted(word: str) -> str:
    return word.replace(".", r"\.")


def own_licences(files: DataFrame, threshold: float = THRESHOLD, path_col: str = "path",
                 text_col: str = "text") -> DataFrame:
    """(key, path, license, score) of the files that declare a licence themselves."""
    spark = files.sparkSession
    n, df = document_frequencies(files, text_col)
    w = Weights(n, df, threshold)
    # Distinct units: a notice that many files share is scored once.
    found = materialize(units(files, w, path_col, text_col), "license-units")
    distinct = found.select("words").distinct().withColumn("unit", F.monotonically_increasing_id())
    distinct = materialize(distinct, "license-distinct")
    tf = distinct.select("unit", F.explode("words").alias("word")).groupBy("unit", "word").agg(
        (1 + F.log(F.count("*"))).alias("tf"))
    idf = unit_idf(files, distinct, n, text_col)
    parts = spark.createDataFrame([(i, TEMPLATES[i][0], word, x) for i, v in enumerate(w.vectors)
                                   for word, x in sorted(v.items())], "t int, license string, word string, x double")
    weighed = materialize(tf.join(idf, "word").select("unit", "word", (F.col("tf") * F.col("idf")).alias("y")),
                          "license-weights")
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    dots = weighed.join(F.broadcast(parts), "word").groupBy("unit", "t", "license").agg(
        F.sum(F.col("x") * F.col("y")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 6)
    best = (dots.join(norms, "unit").withColumn("score", score).where(F.col("score") >= threshold)
            .groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best")))
    scored = distinct.join(best, "unit").select("words", "best")
    return (found.join(scored, "words").groupBy("key", "path").agg(F.min("best").alias("best"))
            .select("key", "path", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score")))


def _directory(path: Column) -> Column:
    """Directory of a path, '' for the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = THRESHOLD, path_col: str = "path", text_col: str = "text",
         carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, license, score, origin, license_dir) of every file, after the
    columns named in ``carry``; origin is 'own', 'inherited' or 'none'. Score
    is that of the deciding unit."""
    own = materialize(own_licences(files, threshold, path_col, text_col), "license-own")
    paths = files.select(F.struct(*(F.col(f"`{c}`") for c in (*carry, path_col))).alias("carried"),
                         F.col(f"`{path_col}`").cast("string").alias("path"),
                         _key(F.col(f"`{path_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).alias("key"))
    paths = paths.withColumn("dir", _directory(F.col("path")))
    given = (own.where(F.col("path").rlike(LICENCE_FILE)).withColumn("at", _directory(F.col("path")))
             .groupBy("at").agg(F.min(F.struct((-F.col("score")).alias("s"), "license", "path")).alias("best"))
             .select("at", F.col("best.license").alias("dir_license"), (-F.col("best.s")).alias("dir_score")))
    steps = F.split("dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")))
    nearest = (paths.where("dir is not null").select("dir").distinct()
               .withColumn("at", F.explode(F.array_distinct(ancestors)))
               .join(given, "at").groupBy("dir")
               .agg(F.max(F.struct(F.length("at").alias("n"), "at", "dir_license", "dir_score")).alias("near")))
    found = (paths.join(own.drop("path"), "key", "left").join(nearest, "dir", "left"))
    is_own = F.col("license").isNotNull()
    return found.select(
        *(F.col(f"carried.`{c}`") for c in carry), "path", F.coalesce("license", "near.dir_license").alias("license"),
        F.coalesce("score", "near.dir_score").alias("score"),
        F.when(is_own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~is_own, F.col("near.at")).alias("license_dir"))
