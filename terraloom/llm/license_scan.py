"""License scans: headers and licence files matched to templates, and inherited along directories."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: The identifiers by which licences are named, and the licence that is meant (fixed values of a public list).
SPDX = {
    "MIT": "MIT", "MIT-0": "MIT-0", "ISC": "ISC", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "Unlicense": "Unlicense", "WTFPL": "WTFPL",
    "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "EPL-2.0": "EPL-2.0",
    "GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0": "GPL-3.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0",
    "LGPL-2.1": "LGPL-2.1", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0": "LGPL-3.0", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0",
    "AGPL-3.0": "AGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0",
    "CC0-1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC-BY-ND-4.0": "CC-BY-ND-4.0",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_AS_IS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."

#: Statements, titles, headers and whole texts by which licences are declared (fixed values: their usual wording).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_AS_IS}"),
    ("ISC", "ISC License"),
    ("ISC", _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", f"{_BSD_BEGIN} {_BSD_NAME} {_BSD_AS_IS}"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", f"{_BSD_BEGIN} {_BSD_AS_IS}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((licence, f"SPDX-License-Identifier: {name}") for name, licence in SPDX.items()),
)
#: The least cosine of a statement.
LEAST = 0.75
#: Names of files that speak for their directory, and whose whole text is compared as well.
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
#: Words that every text has; they tell of a licence only where no others do.
COMMON = frozenset("a above all an and any are as at be but by can following for from if in is it its not of on one or such that the these this to was with you".split())
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LINE_END = r"\r\n|[\r\n\x0B\x0C\x{85}\x{2028}\x{2029}]"
#: What a line of a comment begins with, and what it ends with.
COMMENT = r"^[\x20\t]*(?:/[/*]+|\*+/?|#+|--|;+|<!--|%+)[\x20\t]*"
COMMENT_END = r"[\x20\t]*(?:\*/|-->)?[\x20\t]*$"
BREAK = "\x01"


def vectors(templates=TEMPLATES) -> tuple[list[tuple[int, str, str, float, float]], dict[str, float], float]:
    """(template, licence, term, weight, norm), the idf of each term over the templates, and that of any other."""
    found = [Counter(re.findall(TERM, body.lower())) for _, body in templates]
    often = Counter(t for c in found for t in c)
    idf = {t: math.log((1.0 + len(templates)) / (1.0 + n)) + 1.0 for t, n in often.items()}
    rows = []
    for i, c in enumerate(found):
        w = {t: (1.0 + math.log(n)) * idf[t] for t, n in sorted(c.items())}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(i, templates[i][0], t, x, norm) for t, x in w.items()]
    return rows, idf, math.log(1.0 + len(templates)) + 1.0


def telling_terms(least: float = LEAST, templates=TEMPLATES) -> list[str]:
    """Terms of which every text as near as least to a template has one.

    For unit vectors, a text without the terms R of a template has a cosine of at most the norm of
    the template without R (Cauchy-Schwarz). Terms are taken, those that tell most first and common
    words last, until that is below least for each template.
    """
    rows, _, _ = vectors(templates)
    open_ = {i: 1 - least**2 + 1e-9 for i in range(len(templates))}
    weights: dict[str, dict[int, float]] = {}
    for i, _, t, w, norm in rows:
        weights.setdefault(t, {})[i] = (w / norm) ** 2
    out = []
    while open_:
        tells = {t: sum(min(open_[i], w) for i, w in at.items() if i in open_) for t, at in weights.items()}
        best = max(weights, key=lambda t: (tells[t] > 0 and t not in COMMON, tells[t], len(t), t))
        out.append(best)
        for i, w in weights.pop(best).items():
            if i in open_:
                open_[i] -= w
                if open_[i] <= 0:
                    del open_[i]
    return sorted(out)


def _among(terms: Column, some: list[str], inside: bool = True) -> Column:
    return F.filter(terms, lambda t: t.isin(some) if inside else ~t.isin(some))


def may_be_near(terms: Column, least: float = LEAST, templates=TEMPLATES) -> Column:
    """False only for texts whose terms outside all templates are too many for a cosine of least.

    The cosine is at most the share of the text's norm that is on terms of templates. Each different
    other term has the highest idf once at least; a term of a template that comes n times has its idf
    squared times (1 + ln n)^2, which is below 1.48 n. idfs are taken at their class's highest.
    """
    _, idf, other = vectors(templates)
    known = F.lit(0.0)
    for low, high in ((0.0, 2.0), (2.0, 3.0), (3.0, 4.0), (4.0, math.inf)):
        some = [t for t, x in idf.items() if low < x <= high]
        if some:
            known = known + F.size(_among(terms, some)) * F.lit(1.48 * max(idf[t] for t in some) ** 2)
    unknown = F.size(F.array_distinct(_among(terms, list(idf), False)))
    return known * F.lit(1 - least**2) >= unknown * F.lit((least * other) ** 2 - 1e-6)


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def _bare(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, COMMENT, ""), COMMENT_END, "")


def _pieces(lines: Column) -> Column:
    """The units of a text that are compared, from its lines: lines, blocks of lines, sentences that run over lines, and the comments at its head."""
    text = F.array_join(F.transform(lines, _bare), "\n")
    sentences = F.regexp_replace(F.replace(F.regexp_replace(text, "\n\n+", BREAK), F.lit("\n"), F.lit(" ")), "([.!?;:]) +", "$1" + BREAK)
    code = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT) | x.rlike(r"^[\x20\t]*$")), False)
    head = F.when(code != 1, F.array_join(F.transform(F.when(code > 1, F.slice(lines, F.lit(1), (code - 1).cast("int"))).otherwise(lines), _bare), " ")).otherwise("")
    return F.concat(F.split(text, "\n+"), F.split(text, "\n\n+"), F.split(sentences, BREAK), F.array(head))


def templates_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(t, licence, term, w, norm, idf): each template's TF-IDF vector, a constant table of the length of the templates."""
    rows, idf, _ = vectors(templates)
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {quoted(a)}, {quoted(t)}, {w!r}D, {n!r}D, {idf[t]!r}D)" for i, a, t, w, n in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS v(t, licence, term, w, norm, idf)")


def statements(files: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(path, licence, cosine): each file's best licence statement.

    Compared are a file's lines, its blocks (lines up to an empty one), its sentences also where
    they run over lines, the comments it begins with, and of a file named as licence files are the
    whole text; marks of comments are left out. The cosine is of sparse TF-IDF vectors (frequencies by their logarithm); a term in no
    template has the highest idf. Units without any of telling_terms, or with too many terms of no
    template (may_be_near), can't be near enough and aren't looked at. Equal cosines: the first licence by name. Units that are alike count once.
    """
    spark = files.sparkSession
    telling = F.array(*[F.lit(t) for t in telling_terms(least, templates)])
    lines = F.split("text", LINE_END.replace(r"\x{85}\x{2028}\x{2029}", r"\x85  "))
    some = files.select("path", text_or_empty("text").alias("text")).where(F.col("path").isNotNull() & F.arrays_overlap(_terms(F.col("text")), telling))
    whole = F.when(F.col("path").rlike(FILE_NAME), F.array(F.array_join(F.transform("lines", _bare), " "))).otherwise(F.array().cast("array<string>"))
    units = some.select("path", lines.alias("lines")).select("path", F.explode(F.array_distinct(F.concat(_pieces(F.col("lines")), whole))).alias("unit"))
    # exploded, so that the filters read the terms instead of taking them from the text again
    units = units.select("path", F.explode(F.array(F.struct(F.xxhash64("unit").alias("u"), _terms(F.col("unit")).alias("terms")))).alias("e")).select("path", "e.u", "e.terms")
    units = units.where(F.arrays_overlap("terms", telling)).where(may_be_near(F.col("terms"), least, templates))
    tf = units.select("path", "u", F.explode("terms").alias("term")).groupBy("path", "u", "term").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = F.broadcast(templates_table(spark, templates))
    met = tf.join(F.broadcast(vocabulary.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("t", "licence", "w", "norm")).alias("in"))), "term", "left")
    other = vectors(templates)[2]
    x = (F.log("n") + 1.0) * F.coalesce("idf", F.lit(other))
    # of each unit its length, and how far it goes along each template: one table, as both come from the same rows
    of_unit = met.groupBy("path", "u").agg(F.sqrt(F.sum(x * x)).alias("length"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct(x.alias("x"), "in"))).alias("terms"))
    along = of_unit.select("path", "u", "length", F.explode(F.flatten(F.transform("terms", lambda y: F.transform(y["in"], lambda z: F.struct(z["t"].alias("t"), z["licence"].alias("licence"), (y["x"] * z["w"] / z["norm"]).alias("d")))))).alias("e"))
    best = along.groupBy("path", "u", "length", "e.t", "e.licence").agg(F.sum("e.d").alias("d")).select("path", "licence", F.round(F.col("d") / F.col("length"), 6).alias("cosine")).where(F.col("cosine") >= least)
    return best.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b")).select("path", "b.licence", (-F.col("b.c")).alias("cosine"))


def parent(path: Column) -> Column:
    """The directory of a path; the root is ''."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """files' rows with licence, cosine, origin ('own', 'inherited', 'none') and from_path.

    files has path and text. A file's own statement goes first. Only a file named as licence files
    are speaks for its directory and all below; of several, the highest cosine, then the smallest
    path. A file without a statement takes that of its nearest ancestor directory (its own directory
    first) that has one: the directories are few, are resolved among themselves by joins on equal
    paths, and the files join their directory.

    Built-in functions only. Null text has no statement. Rows whose path is null keep origin
    'none'; files with the same path share what is found in any of them. An empty table gives an
    empty table; columns named as the four results are replaced, others pass through whatever their
    names.
    """
    results = ("licence", "cosine", "origin", "from_path")
    names = [f"c{i}" for i in range(len(files.columns))]
    path, text = (F.col(names[files.columns.index(c)]) for c in ("path", "text"))
    rows = files.toDF(*names)
    own = written(statements(rows.select(path.alias("path"), text.alias("text")), least, templates), "licences")
    speaks = own.where(F.col("path").rlike(FILE_NAME))
    dirs = speaks.groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "licence")).alias("b")).select("dir", F.col("b.licence").alias("d_licence"), (-F.col("b.c")).alias("d_cosine"), F.col("b.path").alias("d_path"))
    every = rows.where(path.isNotNull()).select(parent(path).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    up = every.select(F.col("dir").alias("below"), F.posexplode(above).alias("depth", "dir")).join(dirs, "dir")
    nearest = up.groupBy(F.col("below").alias("dir")).agg(F.max_by(F.struct("d_licence", "d_cosine", "d_path"), "depth").alias("n")).select("dir", "n.*")
    mine = own.select(F.col("path").alias("o_path"), F.col("licence").alias("o_licence"), F.col("cosine").alias("o_cosine"))
    found = rows.withColumn("dir_", parent(path)).join(mine, path == F.col("o_path"), "left")
    found = found.join(nearest, F.col("dir_") == nearest["dir"], "left")
    has, inherits = F.col("o_licence").isNotNull(), F.col("d_licence").isNotNull()
    return found.select(
        *[F.col(n).alias(c) for n, c in zip(names, files.columns, strict=True) if c not in results],
        F.coalesce("o_licence", "d_licence").alias("licence"),
        F.coalesce("o_cosine", "d_cosine").alias("cosine"),
        F.when(has, "own").when(inherits, "inherited").otherwise("none").alias("origin"),
        F.when(has, path).otherwise(F.col("d_path")).alias("from_path"),
    )
