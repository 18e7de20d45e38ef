"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory."""
from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import text_of
from flotsam.session import materialise

# fixed values: one-line headers of common licences
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("reserved", "All rights reserved."),
)
THRESHOLD = 0.7
SEPARATOR = "[^a-z0-9]+"

GNU = "GNU {0}General Public License"
# headings and notices, scored against whole sentences and lines, alone or joined to the next ones
NOTICES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License"), ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "New BSD License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"), ("ISC", "ISC License"), ("MIT", "The MIT License (MIT)"), ("MIT", "MIT License"), ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-1.1", "Mozilla Public License Version 1.1"),
    *((f"{short}-{version}", text) for short, kind, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",)))
      for version in versions for number in [version.removesuffix(".0")] for name in [GNU.format(kind)]
      for text in (f"{name} Version {number}", f"Licensed under the {name}, version {number}", f"This program is licensed under the terms of the {name}, version {number} or later")),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    *((short, text) for short, kind in (("GPL", ""), ("LGPL", "Lesser ")) for text in (
        GNU.format(kind), f"it under the terms of the {GNU.format(kind)} as published by the Free Software Foundation", f"it under the terms of the {GNU.format(kind)} as published by")),
)
APPLY = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
         "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.")
FREE = ("This {1} is free software; you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation; either version {2} of the License, "
        "or (at your option) any later version. This {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details.")
# header blocks, scored against as many words from every line or sentence on
HEADERS = (
    ("Apache-2.0", APPLY), ("GPL-2.0", FREE.format(GNU.format(""), "program", 2)), ("GPL-3.0", FREE.format(GNU.format(""), "program", 3)),
    ("LGPL-2.1", FREE.format(GNU.format("Lesser "), "library", 2.1)), ("LGPL-3.0", FREE.format(GNU.format("Lesser "), "library", 3)),
    ("AGPL-3.0", FREE.format(GNU.format("Affero "), "program", 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                "You can obtain one at http://mozilla.org/MPL/2.0/."),
)
TEXTS = Path(__file__).with_name("licence_texts")
BLOCK_WORDS = 400       # texts up to this length also stand in the headers of source files
#: licences named without a version, and the bare reservation, count only where nothing more telling is found
WEAK = {"reserved": 0, "GPL": 1, "LGPL": 1}
SPDX = r"(?i)SPDX-License-Identifier[ \t]*:([^\r\n]*)"


def template_words(templates=TEMPLATES) -> dict[str, Counter]:
    return {name: Counter(w for w in re.split(SEPARATOR, text.lower()) if w) for name, text in templates}


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), SEPARATOR), lambda w: w != "")


def term_weights(files: DataFrame, terms: list[str], text_col: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequency of the template terms over all files, and of a word no file holds.

    The result is one count per template term, whatever the number of files.
    """
    vocabulary = F.split(F.lit(" ".join(terms)), " ")
    found = files.select(F.explode(F.array_intersect(vocabulary, F.split(F.lower(text_of(text_col)), SEPARATOR))).alias("term"))
    df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = files.count()
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in terms}, math.log(1 + n) + 1


def telling_terms(words: dict[str, Counter], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold with any template.

    Of each template the heaviest terms are taken until the rest alone, by the Cauchy-Schwarz inequality, cannot reach it.
    """
    out = set()
    for counts in words.values():
        weight = {t: (n * idf[t]) ** 2 for t, n in counts.items()}
        left = total = sum(weight.values())
        for t in sorted(weight, key=lambda t: (-weight[t], t)):
            if left < threshold ** 2 * total * 0.999999:
                break
            out.add(t)
            left -= weight[t]
    return sorted(out)


def match(files: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, weighed=None) -> Column:
    """Struct ``score, licence`` of the best line of a text, null where no line reaches the threshold.

    Every line of the whole text is a candidate; the cosine is taken over all its words, with the largest weight for
    words that occur in no template. ``weighed`` is the result of ``term_weights`` where known. Scores are rounded to six places; ties go to the licence named first. Null and
    empty texts match nothing.
    """
    words = template_words(templates)
    terms = sorted({t for c in words.values() for t in c})
    idf, unseen = weighed or term_weights(files, terms, text_col)
    telling = F.array(*[F.lit(t) for t in telling_terms(words, idf, threshold)])
    weights = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(idf[t]))])

    def best(line: Column) -> Column:
        times = lambda t: F.size(F.filter(line, lambda w: w == t)).cast("double")      # noqa: E731
        norm = F.sqrt(F.aggregate(F.array_distinct(line), F.lit(0.0), lambda acc, w: acc + F.pow(times(w) * F.coalesce(weights[w], F.lit(unseen)), 2.0)))
        scored = []
        for i, (name, counts) in enumerate(words.items()):
            own = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
            dot = reduce(lambda a, b: a + b, [times(F.lit(t)) * F.lit(n * idf[t] ** 2) for t, n in counts.items()])
            scored.append(F.struct(F.round(dot / (norm * F.lit(own)), 6).alias("score"), F.lit(-i).alias("o"), F.lit(name).alias("licence")))
        return F.array_max(F.array(*scored))

    lines = F.filter(F.transform(F.split(text_of(text_col), "\n"), _words), lambda w: F.arrays_overlap(w, telling))
    top = F.array_max(F.transform(lines, best))
    return F.when(top["score"] >= threshold, F.struct(top["score"].alias("score"), top["licence"].alias("licence")))


def all_templates() -> list[tuple[str, str, str]]:
    """``licence, kind, text``: notices, header blocks and the full texts; short texts are header blocks too."""
    texts = [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return ([(n, "notice", t) for n, t in NOTICES] + [(n, "block", t) for n, t in HEADERS] + [(n, "text", t) for n, t in texts]
            + [(n, "block", t) for n, t in texts if len(t.split()) <= BLOCK_WORDS])


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    """Rows known to the driver, made without Python workers."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("_r")).select("_r.*")


def _tokens(c: Column) -> Column:
    """Words in order, with a line feed wherever a line or a sentence ends."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(c), r"[.!?;:]\s+", "\n"), r"\s*\n\s*", " \n ")
    return F.filter(F.split(parts, "[^a-z0-9\n]+"), lambda w: w != "")


def match_parts(files: DataFrame, idf: dict[str, float], unseen: float, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``text_md5, score, licence`` of every different text and template with a part that may reach the threshold.

    Parts are: for notices runs of whole sentences and lines with at most twice the words of the notice; for header
    blocks as many words as the block has, from every line or sentence on; for full texts the whole file. So notices
    may be wrapped, inline or behind comment signs. A notice or block must hold
    the numbers of its template, so that a version is never guessed. The cosine is taken over the sets of words. A part that reaches it
    needs threshold**2 of the template's squared weight in common (Cauchy-Schwarz), so only pairs of text and template
    which have that in the whole text are scored; equal texts are scored once.
    """
    spark = files.sparkSession
    tpl, where, telling = [], {}, set()
    for i, (name, kind, text) in enumerate(all_templates()):
        words = [w for w in re.split(SEPARATOR, text.lower()) if w]
        own = sorted(set(words))
        tells = telling_terms({name: Counter(own)}, idf, threshold)
        telling.update(tells)
        tpl.append({"no": i, "licence": name, "kind": kind, "m": len(words), "norm": math.sqrt(sum(idf[t] ** 2 for t in own)), "tells": tells, "terms": own,
                    "numbers": [t for t in own if t.isdigit()]})
        for t in own:
            where.setdefault(t, []).append(i)
    templates = _table(spark, tpl, "no int, licence string, kind string, m int, norm double, tells array<string>, terms array<string>, numbers array<string>")
    vocabulary = _table(spark, [{"term": t, "w2": idf[t] ** 2, "nos": nos} for t, nos in where.items()], "term string, w2 double, nos array<int>")
    text = text_of(text_col)
    held = F.split(F.lower(text), SEPARATOR)
    some = files.select(text.alias("text")).where(F.arrays_overlap(F.split(F.lit(" ".join(sorted(telling))), " "), held))
    texts = materialise(some.groupBy(F.md5("text").alias("text_md5")).agg(F.first("text").alias("text")))
    distinct = F.array_distinct(F.filter(F.split(F.lower("text"), SEPARATOR), lambda w: w != ""))
    hits = (texts.select("text_md5", distinct.alias("_d")).select("text_md5", F.size("_d").alias("n"), F.explode("_d").alias("term"))
            .join(F.broadcast(vocabulary), "term").groupBy("text_md5").agg(F.first("n").alias("n"), F.collect_list(F.struct("term", "w2", "nos")).alias("hits")))
    hits = materialise(hits)
    common = hits.select("text_md5", F.explode("hits").alias("h")).select("text_md5", "h.w2", F.explode("h.nos").alias("no")).groupBy("text_md5", "no").agg(F.sum("w2").alias("dot"))
    common = common.join(F.broadcast(templates), "no").where(F.col("dot") >= threshold ** 2 * 0.999999 * F.col("norm") * F.col("norm"))
    weights = hits.select("text_md5", F.map_from_entries(F.transform("hits", lambda h: F.struct(h["term"], h["w2"]))).alias("weights"),
                          (F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["w2"]) + (F.col("n") - F.size("hits")) * F.lit(unseen ** 2)).alias("norm2"))
    tokens = _tokens(F.col("text"))
    ends = F.filter(F.transform("tokens", lambda w, i: F.when(w == "\n", i + 1)), lambda x: x.isNotNull())
    prepared = texts.select("text_md5", tokens.alias("tokens")).select("text_md5", "tokens", F.concat(F.array(F.lit(0)), ends, F.array(F.size("tokens") + 1)).alias("bounds"))
    pairs = common.join(weights, "text_md5").join(prepared, "text_md5")
    m = F.col("m")

    def cosine(part: Column) -> Column:
        words = F.array_distinct(F.filter(part, lambda w: w != "\n"))
        norm = F.sqrt(F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.col("weights")[w], F.lit(unseen ** 2))))
        dot = F.aggregate(F.array_intersect("terms", words), F.lit(0.0), lambda acc, w: acc + F.col("weights")[w])
        return F.when(F.forall("numbers", lambda x: F.array_contains(words, x)), F.try_divide(dot, norm * F.col("norm")))

    def notice(s: Column, i: Column) -> Column:
        upto = F.filter(F.slice("bounds", i + 2, m), lambda e: e - s <= 2 * m + 1)
        return F.array_max(F.transform(upto, lambda e: cosine(F.slice("tokens", s + 1, e - s - 1))))

    def block(s: Column, i: Column) -> Column:
        return cosine(F.slice(F.filter(F.slice("tokens", s + 1, 2 * m), lambda w: w != "\n"), 1, m))

    def best(part) -> Column:
        return F.array_max(F.transform("bounds", lambda s, i: F.when(F.arrays_overlap(F.slice("tokens", s + 1, 2 * m), F.col("tells")), part(s, i))))

    score = F.when(F.col("kind") == "text", F.try_divide(F.col("dot"), F.sqrt("norm2") * F.col("norm"))).when(F.col("kind") == "block", best(block)).otherwise(best(notice))
    return pairs.select("text_md5", F.round(score, 6).alias("score"), "licence")


def spdx(text: Column, names: list[str]) -> Column:
    """The first known licence among the SPDX identifiers of a text, with score 1; of an expression the first known."""
    known = {n.lower() + end: n for n in names if n not in WEAK for end in ("", "+", "-only", "-or-later")}
    ids = F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(SPDX), 1), " ")), "[^a-z0-9.+-]+")
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.filter(F.transform(ids, lambda x: table[x]), lambda x: x.isNotNull())
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier")) & (F.size(found) > 0), F.struct(F.lit(1.0).alias("score"), F.get(found, F.lit(0)).alias("licence")))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``file`` (the row of ``files``), ``own_licence, own_score, licence, origin, from_dir``.

    A file has the licence of its own header or text (``origin`` header): the best of its single lines, SPDX
    identifiers, and parts (``match_parts``), where licences without a version and bare reservations come last. Else
    it has that of the nearest directory above it which
    holds a licence file (inherited), else none. Licence files are those named LICENSE, LICENCE or COPYING, with any
    extension; of several in one directory the best score counts, then the licence named first. Directories meet their ancestors as
    (directory, ancestor) rows, of which there are as many as different directories times their depth; the files join
    only their own directory. A null path has no directory and inherits nothing; repeated rows get equal results; no
    rows give no rows; extra columns of any name travel inside ``file``.
    """
    names = list(dict.fromkeys([n for n, _ in templates] + [n for n, _, _ in all_templates()]))
    first = {name: -i for i, name in enumerate(names)}
    terms = {t for c in template_words(templates).values() for t in c} | {t for _, _, text in all_templates() for t in re.split(SEPARATOR, text.lower()) if t}
    weighed = term_weights(files, sorted(terms), text_col)
    force = F.create_map(*[F.lit(x) for n in names for x in (n, WEAK.get(n, 2))])
    order = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])

    def ranked(score: str, name: str) -> Column:
        return F.when(F.col(score) >= threshold, F.struct(force[F.col(name)].alias("f"), F.col(score).alias("score"), order[F.col(name)].alias("o"), F.col(name).alias("licence")))

    parts = match_parts(files, *weighed, text_col, threshold).groupBy("text_md5").agg(F.max(ranked("score", "licence")).alias("_part"))
    d = files.select(F.struct(*files.columns).alias("file"), F.col(path_col).alias("_path"), F.md5(text_of(text_col)).alias("text_md5"),
                     match(files, text_col, templates, threshold, weighed).alias("_line"), spdx(text_of(text_col), names).alias("_spdx"))
    d = d.join(materialise(parts.where("_part is not null")), "text_md5", "left")
    d = d.withColumn("_own", F.greatest(ranked("_line.score", "_line.licence"), ranked("_spdx.score", "_spdx.licence"), "_part"))
    d = d.select("file", "_path", F.when(F.col("_own").isNotNull(), F.struct("_own.score", "_own.licence")).alias("_own"))
    d = d.withColumn("_dir", F.coalesce(F.regexp_extract("_path", "^(.*)/[^/]*$", 1), F.lit("")))
    thin = materialise(d.select("_path", "_dir", "_own").distinct())
    named = thin.where(F.col("_own").isNotNull() & F.col("_path").rlike(r"(?i)(^|/)(licen[cs]e|copying)(\.[^/]*)?$"))
    granted = materialise(named.groupBy(F.col("_dir").alias("from_dir")).agg(
        F.max(F.struct(F.col("_own.score").alias("s"), order[F.col("_own.licence")].alias("o"), F.col("_own.licence").alias("licence"))).alias("_g")).select("from_dir", "_g.licence"))
    steps = F.split("_dir", "/")
    above = (thin.where(F.col("_path").isNotNull()).select("_dir").distinct()
             .select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))).alias("from_dir")).distinct())
    nearest = above.join(granted, "from_dir").groupBy("_dir").agg(F.max(F.struct(F.length("from_dir").alias("l"), "from_dir", "licence")).alias("_n"))
    nearest = materialise(nearest.select(F.col("_dir").alias("_at"), F.col("_n.from_dir").alias("from_dir"), F.col("_n.licence").alias("_inherited")))
    out = d.join(nearest, (F.col("_dir") == F.col("_at")) & F.col("_path").isNotNull(), "left")
    own = F.col("_own").isNotNull()
    return out.select("file", F.col("_own.licence").alias("own_licence"), F.col("_own.score").alias("own_score"),
                      F.when(own, F.col("_own.licence")).otherwise(F.col("_inherited")).alias("licence"),
                      F.when(own, "header").when(F.col("_inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
                      F.when(~own, F.col("from_dir")).alias("from_dir"))
