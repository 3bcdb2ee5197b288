"""Licence scans in DataFrame functions: TF-IDF cosine to templates, then inheritance by directory.

A unit of text is compared with the templates as a sparse vector: term counts times the inverse
document frequency over the templates (a term in no template weighs as one in none). A licence has several
templates, in four kinds with frequencies of their own: short notices, SPDX tags, standard headers and titles,
and whole texts (``license_texts``). The best over a licence's templates counts; a template may name terms
that a unit must have (the version, "affero"), so that a likeness to the wrong licence is no match. Units are the pieces of a
file that have a cue word: its lines, paragraphs, comment blocks and SPDX tags, and whole licence files. Terms of units meet the
templates' weights by a join; the templates are a fixed list, so that side is bounded and broadcast.

A file without a licence of its own has that of the nearest directory above it with a licence file. The
distinct directories are exploded to their ancestors and joined by path; files then meet their
directory's result. Directories, not files, go through the ancestor join, so the files of a hot directory
add nothing to it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.common import land, small_side

#: Short notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License. Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Terms that a match to a licence's short notice must have.
MUST = {
    "AGPL-3.0": "affero", "Apache-2.0": "apache", "BSD-3-Clause": "bsd", "CC-BY-4.0": "4.0", "CC-BY-NC-4.0": "nc", "CC-BY-SA-4.0": "sa", "CC0-1.0": "cc0",
    "GPL-2.0": "2", "GPL-3.0": "3", "LGPL-3.0": "lesser 3", "MIT": "mit", "MPL-2.0": "mozilla 2.0",
}
#: Identifiers of SPDX tags, with the licence they name; the tag's terms are all required.
SPDX = {x: x for x in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0", "CC0-1.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "ISC", "Unlicense", "Artistic-1.0")}
SPDX |= {f"{x}{suffix}": x for x in ("AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0") for suffix in ("", "-only", "-or-later")}
SPDX_TAG = r"(?i)SPDX-License-Identifier:[\x20\t(]*[A-Za-z0-9.-]+"

_GNU = (
    "This {0} is free software{5} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{6} either version {2} of the License, or (at your option) any later version.",
    " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details."
    " You should have received a copy of the GNU {1} along with this {0}{3} {4}",
)
_SEE, _WRITE = "If not, see https www.gnu.org licenses", "if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
_APACHE_REST = " You may obtain a copy of the License at http www.apache.org licenses LICENSE 2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_ASF = "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla.org MPL 2.0."
_STYLE = "Use of this source code is governed by {} license that can be found in the LICENSE file"
_CC = "Creative Commons Attribution{} 4.0 International"


def _headers() -> list[tuple[str, str, str]]:
    """(license, text, required terms) of standard headers, whole and by the part that names the licence, and of titles."""
    out = []
    for name, words, version, must in (
        ("AGPL-3.0", "Affero General Public License", "3", "affero 3"), ("GPL-2.0", "General Public License", "2", "general 2"), ("GPL-3.0", "General Public License", "3", "general 3"),
        ("LGPL-2.0", "Library General Public License", "2", "library 2"), ("LGPL-2.1", "Lesser General Public License", "2.1", "lesser 2.1"), ("LGPL-3.0", "Lesser General Public License", "3", "lesser 3"),
    ):
        for what in ("program", "library") if words[0] == "L" else ("program",):
            for end in (_SEE, _WRITE):
                new = end is _SEE
                parts = [x.format(what, words, version, "." if new else ";", end, ":" if new else ";", "," if new else ";") for x in _GNU]
                out += [(name, parts[0] + parts[1], must), (name, parts[0], must)]
        out.append((name, f"This work is licensed under the GNU {words}, version {version}.", must))
        out.append((name, f"Licensed under the GNU {words} v{version}", must.rsplit(" ", 1)[0] + f" v{version}"))
    for name, title in (
        ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("GPL-1.0", "GNU General Public License Version 1, February 1989"),
        ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
        ("LGPL-2.0", "GNU Library General Public License Version 2, June 1991"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
        ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ):
        out.append((name, title, " ".join(dict.fromkeys([title.split()[1], title.split(",")[0].split()[-1]]))))
    out += [("Apache-2.0", x, "apache 2.0") for x in (_APACHE + _APACHE_REST, _APACHE, _ASF + _APACHE_REST, _ASF, "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 http www.apache.org licenses")]
    out += [("MPL-2.0", x, "mozilla 2.0") for x in (_MPL, "Mozilla Public License Version 2.0")]
    for name, style, must in (("BSD-3-Clause", "a BSD-style", "bsd style"), ("BSD-3-Clause", "a BSD 3-Clause", "bsd 3"), ("BSD-2-Clause", "a BSD 2-Clause", "bsd 2"), ("MIT", "an MIT-style", "mit style"), ("MIT", "the MIT", "mit")):
        use = _STYLE.format(style)
        out += [(name, x, must) for x in (use, f"Copyright The Authors. All rights reserved. {use}", use + " in the root of the source tree", use.split(" that ")[0])]
    out += [("BSD-3-Clause", x, "bsd 3") for x in ("BSD 3-Clause License", "Licensed under the BSD 3-Clause License")]
    out += [("BSD-2-Clause", x, "bsd 2") for x in ("BSD 2-Clause License", "Licensed under the BSD 2-Clause License")]
    out += [("MIT", x, "mit") for x in ("MIT License", "The MIT License (MIT)", "Licensed under the MIT License", "Licensed under the MIT license. See LICENSE file in the project root for full license information.", "This project is licensed under the terms of the MIT license")]
    out += [("ISC", x, "isc") for x in ("ISC License", "Licensed under the ISC License")]
    for name, kind in (("CC-BY-4.0", ""), ("CC-BY-SA-4.0", "-ShareAlike"), ("CC-BY-NC-4.0", "-NonCommercial"), ("CC-BY-ND-4.0", "-NoDerivatives"), ("CC-BY-NC-SA-4.0", "-NonCommercial-ShareAlike"), ("CC-BY-NC-ND-4.0", "-NonCommercial-NoDerivatives")):
        must = "attribution 4.0" + kind.lower().replace("-", " ")
        out += [(name, x, must) for x in (_CC.format(kind) + " Public License", f"This work is licensed under a {_CC.format(kind)} License.", f"Attribution{kind} 4.0 International")]
        out.append((name, f"Licensed under {name.replace('-', ' ', 1).removesuffix('-4.0')} 4.0", name.lower().replace("-", " ")))
    out += [("CC0-1.0", x, "cc0 1.0") for x in ("CC0 1.0 Universal", "This work is dedicated to the public domain under CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal")]
    out.append(("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"))
    out.append(("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered"))
    return out


def all_templates() -> list[tuple[str, str, str, str]]:
    """(kind, license, text, required terms) of the built-in templates."""
    out = [("notice", k, v, MUST[k]) for k, v in sorted(TEMPLATES.items())]
    out += [("spdx", k, f"SPDX-License-Identifier: {x}", x.lower().replace("-", " ")) for x, k in SPDX.items()]
    out += [("header", *x) for x in _headers()]
    return out + [("text", f.name.removesuffix(".txt"), f.read_text(), "") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


CUE = r"(?i)licen[cs]e|copyright|public domain|redistribut"
#: Names of licence files, lower case, without extension.
LICENSE_FILES = ("license", "licence", "copying", "notice", "unlicense")


def terms(text: Column) -> Column:
    """Lower-cased runs of letters, digits and dots between them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"), F.lit(0))


def template_weights(spark: SparkSession, templates: dict[str, str] | None) -> DataFrame:
    """(kind, template, license, term, weight, must, n_must): unit-length TF-IDF vectors of the templates; ``idf`` beside, and
    ``unseen``, that of other terms. A term of all templates counts in notices only: whole texts would else be alike by
    their common words."""
    some = all_templates() if templates is None else [("notice", k, v, "") for k, v in sorted(templates.items())]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], "template int, kind string, license string, text string, needs string")
    sizes = F.broadcast(rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("plus", F.when(F.col("kind") == "notice", 1.0).otherwise(0.0)))
    rows = rows.withColumn("needs", F.array_distinct(terms(F.col("needs")))).select("template", "kind", "license", "needs", F.explode(terms(F.col("text"))).alias("term"))
    tf = rows.groupBy("kind", "template", "license", "needs", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "kind")
    idf = idf.select("kind", "term", (F.log((F.lit(1.0) + F.col("n")) / (1 + F.col("df"))) + F.col("plus")).alias("idf"), (F.log(F.lit(1.0) + F.col("n")) + F.col("plus")).alias("unseen"))
    raw = tf.join(idf, ["kind", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = raw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    must = F.array_contains("needs", F.col("term")).cast("int")
    return raw.join(norm, "template").select("kind", "template", "license", "term", (F.col("w") / F.col("norm")).alias("weight"), "idf", "unseen", must.alias("must"), F.size("needs").alias("n_must"))


def best_template(units: DataFrame, keys: list[str], templates: dict[str, str] | None, min_cosine: float) -> DataFrame:
    """Units (``keys``, ``text``) to their best template: keys, ``license``, ``cosine`` (6 decimals; ties: smallest name);
    units under ``min_cosine`` are left out. Equal texts are scored once."""
    spark = units.sparkSession
    weights = land(template_weights(spark, templates), "license-templates")
    units = land(units.select(*keys, "text", F.sha2("text", 256).alias("__unit")), "license-units")
    texts = units.groupBy("__unit").agg(F.min("text").alias("text"))
    tf = texts.select("__unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("__unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    # sides bounded by the templates
    kinds = F.broadcast(weights.groupBy("kind").agg(F.max("unseen").alias("unseen")))
    idf = F.broadcast(weights.groupBy("kind", "term").agg(F.max("idf").alias("idf")))
    vectors = tf.crossJoin(kinds).join(idf, ["kind", "term"], "left").withColumn("w", F.col("tf") * F.coalesce("idf", "unseen"))
    norms = vectors.groupBy("__unit", "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known = vectors.filter(F.col("idf").isNotNull()).select("__unit", "kind", "term", "w")
    hits = known.join(F.broadcast(weights.drop("idf", "unseen")), ["kind", "term"])
    dots = hits.groupBy("__unit", "kind", "template", "license").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"), F.sum("must").alias("must"), F.max("n_must").alias("n_must")).filter("must = n_must")
    scored = dots.join(norms, ["__unit", "kind"]).select("__unit", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = scored.filter(F.col("cosine") >= min_cosine).groupBy("__unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("license"))).alias("b"))
    return units.join(small_side(land(best, "license-best")), "__unit").select(*keys, F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def header_units(text: Column) -> Column:
    """The pieces of a text with a cue word: lines, paragraphs (also between blank comment lines), runs of comment
    lines, pieces between comment delimiters, and SPDX tags. Patterns match line by line, without repeated groups."""
    mark = r"(?://|#|/?\*|--|;|%|!|dnl\b|rem\b|\.\.)"
    runs = F.split(F.regexp_replace(text, rf"(?md)^(?![\x20\t]*{mark})[^\n]*$", "\u0001"), "\u0001", -1)
    inner = F.split(text, r"/\*|\*/|<!--|-->|\x22{3}|'{3}", -1)
    pieces = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[^\p{L}\p{N}\n]*(?=\n)", -1), runs, F.when(F.size(inner) > 1, inner).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(F.filter(pieces, lambda x: x.rlike(CUE)), F.regexp_extract_all(text, F.lit(SPDX_TAG), F.lit(0))))


def directory(path: Column) -> Column:
    """The path up to its last slash, without it; the root is the empty string."""
    return F.regexp_replace(path, r"(?s)/?[^/]*\z", "")


def ancestors(directory_: Column) -> Column:
    """A directory and all above it, the root ("") included, nearest last."""
    parts = F.split(directory_, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), above))


def is_license_file(path: Column) -> Column:
    name = F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), r"\.[^.]*\z", "")
    return name.isin(*LICENSE_FILES)


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: dict[str, str] | None = None, min_cosine: float = 0.6) -> DataFrame:
    """One row per row of ``files`` (its columns but the text): ``license``, ``cosine``, ``license_from``: "header" (a unit of its own, see ``header_units``; the
    best one), "file" (it is a licence file, compared whole and by its units), "directory" (inherited; ``license_path`` is that
    directory), or null with all others null.

    Null text has no licence of its own; a null path has no directory to inherit from. Of several licence files in a
    directory that with the best match counts, ties by name of the licence. Repeated rows stay. Empty table:
    no rows.
    """
    keep = [c for c in files.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = files.select(*keep, text.alias("__text"), F.xxhash64(F.col(path_col), text).alias("__key"), F.sha2(text, 256).alias("__sha"))
    licensed = F.coalesce(is_license_file(F.col(path_col)), F.lit(False))
    units = row.filter(F.col("__text").rlike(CUE)).select("__sha", F.col(path_col).alias("__path"), F.explode(F.array_distinct(F.concat(header_units(F.col("__text")), F.when(licensed, F.array("__text")).otherwise(F.array().cast("array<string>"))))).alias("text"))
    found = best_template(units.select("__sha", "__path", "text"), ["__sha", "__path"], templates, min_cosine)
    own = land(found.groupBy("__sha", "__path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("__own")), "license-own")
    # licence files give their directory its licence
    dirs = own.filter(is_license_file(F.col("__path"))).groupBy(directory(F.col("__path")).alias("__above")).agg(F.min("__own").alias("__given"))
    dirs = land(dirs, "license-dirs")
    all_dirs = row.filter(F.col(path_col).isNotNull()).select(directory(F.col(path_col)).alias("__dir")).distinct()
    paths = all_dirs.select("__dir", F.posexplode(ancestors(F.col("__dir"))).alias("__depth", "__above"))
    nearest = paths.join(small_side(dirs), "__above").groupBy("__dir").agg(F.max(F.struct("__depth", "__above", "__given")).alias("__near"))
    nearest = land(nearest, "license-nearest")
    meta = row.select(*keep, "__sha", F.col(path_col).alias("__path"), licensed.alias("__file"), directory(F.col(path_col)).alias("__dir"))
    mine = own.withColumnRenamed("__sha", "__s").withColumnRenamed("__path", "__p")
    joined = meta.join(small_side(mine), (F.col("__sha") == F.col("__s")) & F.col("__path").eqNullSafe(F.col("__p")), "left").join(small_side(nearest), "__dir", "left")
    by_own, by_dir = F.col("__own").isNotNull(), F.col("__near").isNotNull()
    return joined.select(
        *keep,
        F.when(by_own, F.col("__own.license")).otherwise(F.col("__near.__given.license")).alias("license"),
        F.when(by_own, -F.col("__own.c")).otherwise(-F.col("__near.__given.c")).alias("cosine"),
        F.when(by_own & F.col("__file"), "file").when(by_own, "header").when(by_dir, "directory").alias("license_from"),
        F.when(~by_own & by_dir, F.col("__near.__above")).alias("license_path"),
    )
