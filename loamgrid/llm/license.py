"""License scans: sparse TF-IDF cosine of header lines and licence files to templates, then inheritance from the nearest ancestor directory.

Every text is cut into lines and sentences, which are compared with TEMPLATES, and into paragraphs with their wrapped lines joined, which
are, as whole texts, compared with NOTICES: TF-IDF rows of words and word pairs times the sparse template matrix. A file whose notices
make up most of its text, or whose name says so, is a licence file: files below its directory that state nothing themselves inherit from
the nearest such directory, by joins on ancestor paths. Pieces whose words can't reach the cosine are told from their words alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import cut, discard, map_texts

#: Words that many licences, and other texts, share. What a piece has in common with a template must be more than these and numbers.
NAMELESS = frozenset("a an and any are as at be but by can each for from has if in is it its may modify not of on or other redistribute subject terms that the this to under version was were with work you".split())
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
#: The cosine from which a piece states a licence, and the share of a file's words in notices that makes it a licence file.
COSINE, FILE_SHARE = 0.5, 0.5
#: Shares into which the files of a directory, and the directories below one, are dealt.
SPREAD = 32
#: Template texts by licence (fixed values: the public names and header sentences).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
]
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by "
    "the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
)
_OLD_GNU = _GNU.replace("software: you", "software; you").replace(", either", "; either")
_ONLY_GNU = _GNU.replace(", either version {v} of the License, or (at your option) any later version", ", version {v}")
_NO_WARRANTY = (
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_AS_IS = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under "
    "the License."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_GNU_KINDS = [("GPL-3.0", "program", "", "3"), ("GPL-2.0", "program", "", "2"), ("LGPL-2.1", "library", "Lesser", "2.1"), ("LGPL-3.0", "library", "Lesser", "3"), ("AGPL-3.0", "program", "Affero", "3")]
#: Standard notices and licence texts, for paragraphs and whole files.
NOTICES = [
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_NOTICE}"),
    ("MIT", f"MIT License {_MIT} {_MIT_NOTICE} {_MIT_AS_IS}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAMES}"),
    ("MPL-2.0", _MPL),
    *[(i, form.format(what=what, name=name, v=v)) for i, what, name, v in _GNU_KINDS for form in (_GNU, _OLD_GNU, _ONLY_GNU, f"{_GNU} {_NO_WARRANTY}")],
]
_WORDS = re.compile("[a-z0-9]+").findall
#: Where texts are cut: a paragraph into sentences, so that a statement inside a long line stands alone; and a file into paragraphs at
#: lines without a letter or digit (also those of comments).
SENTENCES, PARAGRAPHS = r"\n|(?<=[^0-9][.!?])[ \t\n\x0B\f\r]+(?=\p{Lu})", r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def template_weights(templates: list[tuple[str, str]]) -> tuple[dict[str, list[tuple[int, float]]], dict[str, float], float]:
    """The sparse matrix of templates by term (unit rows), the idf of its terms, and that of terms which no template has. Terms are words and pairs of them."""
    bags = [terms(text)[1] for _, text in templates]
    n = len(bags)
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df.items()}
    columns: dict[str, list[tuple[int, float]]] = {t: [] for t in sorted(df)}
    for i, b in enumerate(bags):
        size = math.sqrt(sum((c * idf[t]) ** 2 for t, c in b.items()))
        for t, c in b.items():
            columns[t].append((i, c * idf[t] / size))
    return columns, idf, math.log(1 + n) + 1


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def naming(templates: list[tuple[str, str]]) -> set[str]:
    """The template words one of which a piece must have: all but NAMELESS ones and numbers."""
    return {w for _, text in templates for w in words_of(text) if w not in NAMELESS and not w.isdigit()}


def terms(text: str) -> tuple[int, Counter]:
    """The number of words of ``text`` and the counts of its words and word pairs."""
    w = words_of(text)
    bag = Counter(w)
    bag.update(map(" ".join, zip(w, w[1:], strict=False)))
    return len(w), bag


def matcher(templates: list[tuple[str, str]], cosine: float):
    """Two functions: whether any part of a text with these words can reach ``cosine``, and from a piece of text to ``(license, score, words)`` of its best template.

    Ties go to the earlier template; below ``cosine``, it is None. Only templates count that share more than NAMELESS words and numbers with
    the piece. A cosine is at most the root of the template's mass in shared terms. A pair needs its first word, so that this mass is
    bounded by a sum over words; what it rules out can't be a statement.
    """
    columns, idf, rare = template_weights(templates)
    names, most = naming(templates), max(idf.values())
    row = {x: i for i, x in enumerate(t for t in columns if " " not in t)}
    mass = np.zeros((len(row), len(templates)))
    for t, column in columns.items():
        for i, tw in column:
            mass[row[t.split(" ")[0]], i] += tw * tw

    def may(words: set[str]) -> bool:
        return not names.isdisjoint(words) and mass[[row[x] for x in words if x in row]].sum(axis=0).max() >= cosine * cosine * (1 - 1e-9)

    def match(piece: str) -> tuple[str, float, int] | None:
        w = words_of(piece)
        if names.isdisjoint(w) or not may(set(w)):
            return None
        bag = Counter(w)
        shared = [x for x in bag if x in columns] if len(bag) < len(columns) else [x for x in columns if x in bag]
        # Pairs that begin with a word have together at most the square of its count; a word that no template has makes a pair that none has.
        own = sum(bag[x] ** 2 * (idf[x] ** 2 + most * most) for x in shared)
        foreign = len(w) - sum(bag[x] for x in shared)
        if own < cosine * cosine * (own + rare * rare * max(0, 2 * foreign - 1)) * (1 - 1e-9):
            return None
        bag.update(map(" ".join, zip(w, w[1:], strict=False)))
        known = bag.keys() & columns.keys() if len(bag) > len(columns) else [t for t in bag if t in columns]
        weights = {t: bag[t] * idf[t] for t in sorted(known)}
        seen = sum(v * v for v in weights.values())
        norm = math.sqrt(seen + rare * rare * (sum(c * c for c in bag.values()) - sum(bag[t] ** 2 for t in weights)))
        # The terms that any template has bound the cosine with each of them: pieces below it are not multiplied.
        if math.sqrt(seen) < cosine * norm * (1 - 1e-9):
            return None
        dots, named = [0.0] * len(templates), set()
        for t, v in weights.items():
            for i, tw in columns[t]:
                dots[i] += v * tw
            if t in names:
                named.update(i for i, _ in columns[t])
        i = max(named, key=lambda j: (round(dots[j] / norm, 9), -j))
        return (templates[i][0], round(dots[i] / norm, 6), len(w)) if dots[i] / norm >= cosine else None

    return may, match


def statements(files: DataFrame, path_col: str, text_col: str, kinds: list[tuple[list[tuple[str, str]], str | None]] | None = None, cosine: float = COSINE, lengths: bool = False) -> DataFrame:
    """``path, kind, license, score, words`` of every piece that states a licence; null texts state nothing.

    Each of ``kinds`` (by default lines and sentences with TEMPLATES) is a list of templates and what cuts a text into pieces, None for
    whole texts. Texts are read once for all kinds: each is a block of sparse rows that is multiplied with the template matrix where it
    lies, so that nothing is shuffled and memory is bounded by one text. ``lengths``: also a row of kind -1 per text with its words.
    """
    kinds = [(TEMPLATES, SENTENCES)] if kinds is None else kinds

    def make():
        ready = [(*matcher(t, cosine), regex.compile(c) if c else None) for t, c in kinds]
        letters = regex.compile(r"[\p{L}\p{N}]+").findall

        def run(keys: list, texts: list) -> list:
            out = []
            for (path,), text in zip(keys, texts, strict=True):
                w = words_of(text)
                if lengths:
                    out.append((path, -1, None, None, len(w) if text.isascii() else len(letters(text))))
                distinct = set(w)
                for kind, (may, match, cutter) in enumerate(ready):
                    if not may(distinct):
                        continue
                    for piece in cutter.split(text) if cutter else (text,):
                        if got := match(piece):
                            out.append((path, kind, *got))
            return out

        return run

    return map_texts(files, [F.col(path_col).cast("string")], F.col(text_col), make, "path string, kind int, license string, score double, words int")


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """A join with ``right``, unique by ``on``, whose rows are repeated for SPREAD shares of the left rows (dealt by ``by``): a hot key is many tasks' work."""
    shares = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.withColumn("share", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(shares, [on, "share"], how).drop("share")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", by_content: bool = True) -> DataFrame:
    """One row per distinct non-null path: ``path, license, score, status, from_dir``.

    ``status``: ``own`` (a statement in the file; the best one counts), ``inherited`` (from the licence file of ``from_dir``, the nearest
    ancestor directory that has one; among its files the best statement), or ``none``. Rows of a repeated path are pooled; null texts state
    nothing; ``by_content``: files that are mostly NOTICES are licence files, too, not only those named so (a line that states the file's own licence makes none); ties go to the licence that is first by name; an empty table gives an empty table; other columns are not read.
    """
    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")).where("path IS NOT NULL")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("l"))).alias("b")
    kinds = [(TEMPLATES, SENTENCES), (NOTICES, PARAGRAPHS), (NOTICES, None)]
    # One pass over the texts gives what is stated and how long each file is; it is written, so that no later step does it again.
    found = cut(statements(rows, "path", "text", kinds, lengths=True).groupBy("path", "kind").agg(best, F.sum(F.col("words").cast("bigint")).alias("words")))
    # Paragraphs and files overlap: the words in notices are the most that one of the two has.
    least = F.min(F.when(F.col("kind") >= 0, F.col("b"))).alias("b")
    own = found.groupBy("path").agg(least, F.coalesce(F.max(F.when(F.col("kind") >= 1, F.col("words"))), F.lit(0)).alias("stated"), F.max(F.when(F.col("kind") < 0, F.col("words"))).alias("words"))
    slash = "concat('/', regexp_replace(path, '^/+', ''))"
    paths = cut(own.withColumn("dir", F.expr(f"regexp_replace({slash}, '/[^/]*$', '')")).withColumn("name", F.expr(f"regexp_extract({slash}, '([^/]*)$', 1)")))
    discard(found)
    named = F.col("name").rlike(FILE_NAME)
    whole = paths.where(F.col("b").isNotNull() & (named | (F.col("stated") >= FILE_SHARE * F.col("words")) if by_content else named))
    by_dir = whole.groupBy(F.col("dir").alias("up")).agg(F.min("b").alias("db"))
    # Ancestors are listed once per directory, not per file.
    dirs = paths.select("dir").distinct().select("dir", F.explode(F.expr("transform(sequence(0, size(split(dir, '/')) - 1), i -> array_join(slice(split(dir, '/'), 1, i + 1), '/'))")).alias("up"))
    nearest = spread_join(dirs, by_dir, "up", "dir").groupBy("dir").agg(F.max_by(F.struct("up", "db"), F.length("up")).alias("n"))
    out = spread_join(paths, nearest, "dir", "path", "left")
    status = F.when(F.col("b").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "path",
        F.coalesce("b.l", "n.db.l").alias("license"),
        (-F.coalesce("b.s", "n.db.s")).alias("score"),
        status.alias("status"),
        F.when(F.col("b").isNull(), F.col("n.up")).alias("from_dir"),
    )
