"""Licence scans by sparse TF-IDF cosine to templates, with inheritance along directories, in DataFrame functions only.

*Statistics.* Document frequencies of all terms are counted over all whole texts;
templates and passages are weighed by the same ones.
*Passages.* A licence stands in a line, in up to ``RUN_LINES`` lines in a row, or in
a block: lines up to the next empty one or the next change between comment and other
lines. Each of these is compared with the templates: short notices, the standard
headers, and the texts of short licences, whole and by paragraph. Cosine is exact but
only computed where it can reach the threshold: with a template's terms in order of
weight, the last ones whose weights together have a norm below the threshold cannot
lift a passage over it alone, so a passage needs one of the others (its anchors).
Passages without any anchor are out, and those whose terms outside the templates make
them too long for it, each counted with the least weight a term can have; the rest are
split into terms and joined with the templates' terms, of which there are a fixed few.
*Files.* A document's own licence is its best passage's. A document that is mostly
licence passages, or is named like a licence file and has a licence, is a licence
file and speaks for its directory.
*Inheritance.* Documents without a licence of their own take that of the nearest
directory above them that has a licence file: each path is split into its
ancestors, joined by equality, and the deepest wins.

Null and empty texts have no passages; texts of any length are read whole. A null
path lies in no directory. Ties between templates go to the first name. Rows that
repeat a path each get their result. Further columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.common import ROW_KEY, row_key
from parasol.session import materialized

THRESHOLD = 0.7
FILE_SHARE = 0.5  # of a licence file's words that stand in licence passages

# Short notices of common licences.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under CC BY 4.0, the Creative Commons Attribution license.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
}


_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as "
        "published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
_NO_WARRANTY = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details.")
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License.")
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
    "to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.",
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")

# Standard headers, texts of short licences, first lines of long ones; the licence stands before the slash.
TEMPLATES_LONG = {
    "AGPL-3.0/header": _GNU.format("program", "Affero ", 3),
    "AGPL-3.0/title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "AGPL-3.0/warranty": _NO_WARRANTY.format("program", "Affero "),
    "Apache-2.0/header": " ".join(_APACHE),
    "Apache-2.0/header 1": _APACHE[0],
    "Apache-2.0/header 2": _APACHE[1],
    "Apache-2.0/title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "BSD-3-Clause/names": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                          "products derived from this software without specific prior written permission.",
    "GPL-2.0/header": _GNU.format("program", "", 2),
    "GPL-2.0/title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0/header": _GNU.format("program", "", 3),
    "GPL-3.0/title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "ISC/text": " ".join(_ISC),
    "ISC/text 1": _ISC[0],
    "ISC/text 2": _ISC[1],
    "LGPL-3.0/header": _GNU.format("library", "Lesser ", 3),
    "LGPL-3.0/title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0/warranty": _NO_WARRANTY.format("library", "Lesser "),
    "MIT/text": " ".join(_MIT),
    "MIT/text 1": _MIT[0],
    "MIT/text 2": _MIT[1],
    "MIT/text 3": _MIT[2],
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0/title": "Mozilla Public License Version 2.0",
}
ALL_TEMPLATES = TEMPLATES | TEMPLATES_LONG

RUN_LINES = 4
BOUND_SLOTS = 16381
COMMENT = r"^\s*(?:#|//|\*|/\*|--|;|%|!|<!--|(?i:dnl|rem)\s)"
LICENSE_FILE = "^(?i)(?:un)?(?:licen[cs]e|copying)(?:[._-].*)?$"


def terms(text: str) -> list[str]:
    return [t for t in re.split("[^a-z0-9]+", text.lower()) if t]


def _line_terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def document_frequencies(texts: DataFrame) -> DataFrame:
    """(term, n): the number of texts that hold each term. Tasks add up their own texts before terms move."""
    held = F.array_distinct(_line_terms(F.col("text")))
    return texts.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def template_vectors(n: int, frequencies: dict[str, int], threshold: float) -> tuple[dict, dict, set[str]]:
    """Term weights by template (norm 1), inverse document frequencies, and the anchors of all templates."""
    idf = {t: math.log((1 + n) / (1 + frequencies.get(t, 0))) + 1 for text in ALL_TEMPLATES.values() for t in terms(text)}
    vectors, anchors = {}, set()
    for name, text in ALL_TEMPLATES.items():
        tf = {t: terms(text).count(t) * idf[t] for t in terms(text)}
        norm = math.sqrt(sum(w * w for w in tf.values()))
        vectors[name] = {t: w / norm for t, w in tf.items()}
        rest = 0.0
        for t in sorted(vectors[name], key=lambda t: (vectors[name][t], t)):
            rest += vectors[name][t] ** 2
            if math.sqrt(rest) >= threshold:
                anchors.add(t)
    return vectors, idf, anchors


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def may_reach(words: Column, vectors: dict, idf: dict[str, float], threshold: float) -> Column:
    """False only if no template's cosine to ``words`` can reach the threshold.

    The templates' own terms are known with their weights; any other term weighs at least its count. So the norm is at
    least what is computed here, and a product at most that with each term's largest weight in a template.
    """
    known = sorted(idf)
    largest = {t: max(v.get(t, 0.0) for v in vectors.values()) for t in known}
    # Looked up by hash in constant arrays; terms of one slot share the bound that holds for both.
    slot = {t: zlib.crc32(t.encode()) % BOUND_SLOTS for t in known}
    low, high = [0.0] * BOUND_SLOTS, [0.0] * BOUND_SLOTS
    for t in known:
        low[slot[t]] = min(low[slot[t]] or idf[t], idf[t])
        high[slot[t]] = max(high[slot[t]], idf[t] * largest[t])

    def constant(values: list[float]) -> Column:
        return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")

    def at(values: list[float], term: Column) -> Column:
        return F.get(constant(values), (F.crc32(term.cast("binary")) % BOUND_SLOTS).cast("int"))

    def bound(all_terms: Column) -> Column:
        def of(own: Column) -> Column:
            counts = F.transform(F.array_distinct(own), lambda t: F.struct(
                t.alias("t"), F.size(F.filter(own, lambda x: x == t)).cast("double").alias("n")))
            start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("mass"))
            sums = F.aggregate(counts, start, lambda s, c: F.struct(
                (s["dot"] + c["n"] * at(high, c["t"])).alias("dot"),
                (s["mass"] + F.pow(c["n"] * at(low, c["t"]), F.lit(2.0))).alias("mass")))
            others = F.size(all_terms) - F.size(own)
            return _let(sums, lambda s: s["dot"] >= (threshold - 1e-6) * F.sqrt(s["mass"] + others))
        return _let(F.filter(all_terms, lambda t: t.isin(known)), of)
    return _let(_line_terms(words), bound)


def _passages(lines: Column, marks: Column, kinds: Column, wanted) -> Column:
    """The ``wanted`` runs of 1 to RUN_LINES lines and longer blocks that hold a marked line: (kind, first line, lines, words)."""
    n = F.size(lines)

    def passage(kind: str, first: Column, size: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), first.alias("first"), size.alias("size"))

    def runs(first: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(RUN_LINES), n - first))
        return F.transform(sizes, lambda k: F.struct(F.when(k == 1, "line").otherwise("run").alias("kind"), first.alias("first"), k.alias("size")))

    each = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), runs))
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))

    def blocks(at: Column) -> Column:
        return F.transform(at, lambda first, i: passage("block", first, F.coalesce(F.get(at, i + 1), n) - first))

    blocks_of = F.filter(F.get(F.transform(F.array(begins), blocks), F.lit(0)), lambda x: x["size"] > 1)
    marked = F.filter(F.concat(each, blocks_of), lambda x: F.exists(F.slice(marks, x["first"] + 1, x["size"]), lambda m: m))
    spelt = F.transform(marked, lambda x: F.struct(x["kind"].alias("kind"), x["first"].alias("first"), x["size"].alias("size"),
                                                  F.array_join(F.slice(lines, x["first"] + 1, x["size"]), "\n").alias("words")))
    return F.filter(spelt, lambda x: wanted(x["words"]))


def candidate_lines(docs: DataFrame, anchors: set[str], vectors: dict, idf: dict[str, float], threshold: float) -> DataFrame:
    """(row key, path, total terms of the text, line, kind, words) of the passages that may match; repeated rows once."""
    anchor = "(?<![a-z0-9])(?:" + "|".join(sorted(anchors)) + ")(?![a-z0-9])"
    texts = docs.where(F.lower("text").rlike(anchor)).select(
        *ROW_KEY, "path", F.size(_line_terms(F.col("text"))).alias("total"), F.split("text", "\n").alias("lines"))
    kind = lambda x: F.when(~x.rlike("[A-Za-z0-9]"), 0).when(x.rlike(COMMENT), 2).otherwise(1)
    texts = texts.withColumn("marks", F.transform("lines", lambda x: F.lower(x).rlike(anchor))).withColumn("kinds", F.transform("lines", kind))
    found = texts.select(*ROW_KEY, "path", "total", F.posexplode(_passages(
        F.col("lines"), F.col("marks"), F.col("kinds"), lambda words: may_reach(words, vectors, idf, threshold))).alias("line", "found"))
    return found.select(*ROW_KEY, "path", "total", "line", "found.kind", "found.words").distinct()


def matched_lines(lines: DataFrame, vectors: dict, n: int, frequencies: DataFrame, threshold: float) -> DataFrame:
    """(row key, path, total, line, kind, n_terms, license, cosine): the best template of every passage that reaches ``threshold``."""
    line = [*ROW_KEY, "path", "total", "line", "kind"]
    # A fixed few rows, written into the plan.
    table = lines.sparkSession.createDataFrame(
        [(name, t, w) for name, v in vectors.items() for t, w in v.items()], "template string, term string, w double")
    each = lines.select(*line, F.explode(_line_terms(F.col("words"))).alias("term"))
    counted = each.groupBy(*line, "term").agg(F.count("*").alias("tf"))
    # The lines' distinct terms are few beside all texts': their frequencies are found once, not for each line.
    idf = frequencies.join(each.select("term").distinct().hint("merge"), "term").select(
        "term", (F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1).alias("idf"))
    # Both grow with the vocabulary, so neither is sent to all tasks.
    weighted = counted.join(idf.hint("merge"), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(*ROW_KEY, "path", "line").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum("tf").alias("n_terms"))
    dots = weighted.join(table, "term").groupBy(*line, "template").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    scored = dots.alias("d").join(norms.alias("n"), [F.col(f"d.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*ROW_KEY, "path", "line")])
    # Rounded, so that the order in which a sum was formed decides no tie.
    scored = scored.select("d.*", "n_terms", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    licence = F.substring_index("template", "/", 1).alias("license")
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), licence)).alias("best")
    found = scored.groupBy(*line, "n_terms").agg(best)
    return found.select(*line, "n_terms", "best.license", (-F.col("best.minus")).alias("cosine"))


def directories(path: Column) -> Column:
    """All directories above a path, the nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda n: F.array_join(F.slice(parts, 1, F.when(F.size(parts) > 1, n).otherwise(0)), "/"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                 threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """Per document: id, path, own_license, own_cosine, is_license_file, license, inherited_from (a directory, or null)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    vocabulary = sorted({t for text in ALL_TEMPLATES.values() for t in terms(text)})
    n, frequencies = rows.count(), materialized(document_frequencies(rows), "license-terms")
    known = {f["term"]: f["n"] for f in frequencies.where(F.col("term").isin(vocabulary)).collect()}
    vectors, idf, anchors = template_vectors(n, known, threshold)
    candidates = materialized(candidate_lines(rows.drop("id"), anchors, vectors, idf, threshold), "license-candidates")
    lines = matched_lines(candidates, vectors, n, frequencies, threshold)
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")
    covered = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n_terms"))), F.lit(0)) for k in ("line", "block")]  # these do not overlap
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENSE_FILE), F.lit(False))
    own = lines.groupBy(*ROW_KEY, "path", "total").agg(best, F.greatest(*covered, F.max("n_terms")).alias("licensed"))
    own = materialized(own.select(
        *ROW_KEY, F.col("path").alias("own_path"), F.col("best.license").alias("own_license"),
        (-F.col("best.minus")).alias("own_cosine"), (named | (F.col("licensed") >= file_share * F.col("total"))).alias("is_license_file")), "license-own")
    where = F.element_at(directories(F.col("own_path")), -1)
    grants = own.where("is_license_file AND own_path IS NOT NULL").groupBy(where.alias("directory")).agg(
        F.min(F.struct((-F.col("own_cosine")).alias("minus"), "own_license")).alias("best")).select(
        "directory", F.col("best.own_license").alias("granted"))
    narrow = rows.select("id", "path", *ROW_KEY).alias("r").join(
        own.alias("o"), [F.col(f"r.{c}") == F.col(f"o.{c}") for c in ROW_KEY] + [F.col("path").eqNullSafe(F.col("own_path"))], "left")
    narrow = narrow.select("id", "path", "own_license", "own_cosine", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"))
    # Directories are few beside paths: their nearest grants are found once for each directory, not for each document.
    folder = F.when(F.col("path").isNotNull(), F.element_at(directories(F.col("path")), -1))
    narrow = narrow.withColumn("folder", folder)
    folders = rows.select(folder.alias("folder")).where("folder IS NOT NULL").distinct()
    above = folders.select("folder", F.posexplode(directories(F.concat("folder", F.lit("/x")))).alias("depth", "directory"))
    nearest = above.join(grants, "directory").groupBy("folder").agg(F.max(F.struct("depth", "directory", "granted")).alias("near"))
    found = narrow.join(nearest, "folder", "left")
    inherits = F.col("own_license").isNull()
    return found.select(
        F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "own_cosine", "is_license_file",
        F.when(inherits, F.col("near.granted")).otherwise(F.col("own_license")).alias("license"),
        F.when(inherits, F.col("near.directory")).alias("inherited_from"))
