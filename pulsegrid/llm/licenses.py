"""Licence scans: sparse TF-IDF cosine of passages to templates, and inheritance from the nearest directory above.

Short notices are compared with lines, runs of up to four adjacent lines and sentences; headers of several lines and
licence texts with sentences and runs of up to eight paragraphs; both with the whole text of a licence file. Words of passages
and templates are weighted by term frequency and the inverse share of files that hold the term, counted over all files.
A template's *anchors* are terms, so many that the others alone can't reach the least similarity; a passage without an anchor of
any template therefore can't match and is not looked at further. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.llm.common import spread_join
from pulsegrid.session import cut_lineage

#: Short notices by licence.
NOTICES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-2-Clause": "Use of this source code is governed by the BSD 2-Clause License",
    "BSD-3-Clause": "Use of this source code is governed by the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Released under the ISC License",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This source code form is subject to the terms of the Mozilla Public License, version 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
#: Notices that files carry at their top, by licence.
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the "
        "Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
HEADERS = {
    "AGPL-3.0": _GNU.format("program", "Affero General Public License", "3"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                   "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    "GPL-2.0": _GNU.format("program", "General Public License", "2"),
    "GPL-3.0": _GNU.format("program", "General Public License", "3"),
    "LGPL-2.1": _GNU.format("library", "Lesser General Public License", "2.1"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
}
TEXTS = Path(__file__).with_name("licence_texts")
#: What AGPL-3.0 has in place of GPL-3.0's leave to combine the two.
REMOTE = ("if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer "
          "network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a "
          "network server at no charge, through some standard or customary means of facilitating copying of software.")
LEAST = 0.8
#: Adjacent lines and paragraphs that make a passage, and the characters up to which several paragraphs do.
LINES, PARAGRAPHS, BLOCK = 4, 8, 4000
#: Between paragraphs: a line without words.
BREAK = r"\n(?:[^A-Za-z0-9\n]*\n)+"
#: Share of a file's characters from which on a matching line makes it a licence file.
STANDALONE = 0.25


def long_templates() -> dict[str, str]:
    """Headers and licence texts; the licence is the part of the name before the blank."""
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted(TEXTS.glob("*.txt"))}
    texts["AGPL-3.0"] = texts["GPL-3.0"].replace("GNU General", "GNU Affero General").replace("GNU GENERAL", "GNU AFFERO GENERAL") + REMOTE
    texts["BSD-2-Clause"] = re.sub(r"3\. Neither.*?permission\.\n", "", texts["BSD-3-Clause"], flags=re.S)
    return {f"{k} header": t for k, t in HEADERS.items()} | {f"{k} text": t for k, t in texts.items()}


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, an empty word where the text begins or ends otherwise."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def vocabulary(notices: dict[str, str]) -> dict[str, dict[str, int]]:
    """Term counts by licence."""
    out = {}
    for name, text in notices.items():
        terms = re.findall("[a-z0-9]+", text.lower())
        out[name] = {t: terms.count(t) for t in sorted(set(terms))}
    return out


def weigh(counts: dict[str, dict[str, int]], idf: dict[str, float]) -> dict[str, dict[str, float]]:
    """Unit vectors by licence."""
    out = {}
    for name, terms in counts.items():
        w = {t: n * idf[t] for t, n in terms.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[name] = {t: x / length for t, x in w.items()}
    return out


def anchors(vectors: dict[str, dict[str, float]], least: float, shares: dict[str, int] | None = None) -> list[str]:
    """Terms of which a passage must hold one to reach ``least`` with any template: the heaviest, or first those that the
    fewest files hold by ``shares``."""
    found, held = set(), shares or {}
    for w in vectors.values():
        rest = 1.0
        for t, x in sorted(w.items(), key=lambda i: (held.get(i[0], 0), -i[1], i[0])):
            if rest < (least * 0.999) ** 2:
                break
            found.add(t)
            rest -= x * x
    return sorted(found)


def adjacent(parts: Column, least: int, most: int) -> Column:
    """Every ``least`` to ``most`` adjacent strings of an array as one, with line ends between."""
    starts = lambda k: F.sequence(F.lit(1), F.size(parts) - k + 1)
    runs = [F.when(F.size(parts) >= k, F.transform(starts(k), lambda i, k=k: F.array_join(F.slice(parts, i, F.lit(k)), "\n")))
            .otherwise(F.array().cast("array<string>")) for k in range(least, most + 1)]
    return F.concat(*runs)


def _scored(rows: DataFrame, anchored: Callable[[Column], Column], vectors: dict[str, dict[str, float]], idf: dict[str, float],
            rarest: float, least: float) -> DataFrame:
    """``(path, license, similarity, chars, line)`` of passages ``(path, line, passage)`` that reach ``least`` with a template."""
    spark = rows.sparkSession
    passages = (rows.where(anchored(F.col("passage"))).select("path", "line", F.md5(F.col("passage").cast("binary")).alias("id"), "passage")
                .groupBy("path", "id").agg(F.max("line").alias("line"), F.any_value("passage").alias("passage")))
    weights = F.broadcast(spark.createDataFrame([(t, w) for t, w in idf.items()], "term string, idf double"))
    templates = F.broadcast(spark.createDataFrame([(t, k.split(" ")[0], k, x) for k, w in vectors.items() for t, x in w.items()],
                                                  "term string, license string, template string, share double"))
    spread = passages.select("path", "id", "line", F.length("passage").alias("chars"), F.explode(words(F.col("passage"))).alias("term")).where("term <> ''")
    tf = (spread.groupBy("path", "id", "line", "chars", "term").count().join(weights, "term", "left")
          .withColumn("w", F.col("count") * F.coalesce("idf", F.lit(rarest))))
    length = tf.groupBy("path", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = (tf.join(templates, "term").groupBy("path", "id", "line", "chars", "license", "template")
            .agg(F.sum(F.col("w") * F.col("share")).alias("dot")))
    return (dots.join(length, dots["path"].eqNullSafe(length["path"]) & (dots["id"] == length["id"]))
            .select(dots["path"], "license", F.round(F.col("dot") / F.col("length"), 6).alias("similarity"), "chars", "line")
            .where(F.col("similarity") >= least))


def notices_of(files: DataFrame, path: str = "path", text: str = "text", whole: Column | None = None,
               notices: dict[str, str] = NOTICES, least: float = LEAST, texts: dict[str, str] | None = None) -> DataFrame:
    """``(path, license, similarity, chars)``: the best matching passage of each file that has one.

    Of equal similarity the first licence by name counts, then a line, then the longer passage. ``whole`` marks files whose whole text is a
    passage too. ``texts`` are templates of several lines, by default ``long_templates``. Terms that no template of the kind has
    weigh as much as one that no file has. Null texts have no passage; rows with one path are one file; empty tables give empty ones.
    """
    texts = long_templates() if texts is None else texts
    short, long = vocabulary(notices), vocabulary(texts)
    terms = sorted({t for c in (*short.values(), *long.values()) for t in c})
    listed = lambda t: F.split(F.lit(" ".join(t)), " ")
    held = files.select(F.explode(F.array_intersect(words(F.col(text)), listed(terms))).alias("term"))
    shares = {r[0]: r[1] for r in held.groupBy("term").count().collect()}  # at most one row a template term
    n = files.count()
    rarest = math.log(n + 1) + 1
    idf = {t: math.log((n + 1) / (shares.get(t, 0) + 1)) + 1 for t in terms}
    weights = [{t: idf[t] for c in counts.values() for t in c} for counts in (short, long)]
    vectors = [weigh(counts, w) for counts, w in zip((short, long), weights, strict=True)]
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(anchors(vectors[0], least)) + r")(?![a-z0-9])"
    rare = listed(anchors(vectors[1], least, shares))
    short_anchor, long_anchor = (lambda c: c.rlike(pattern)), (lambda c: F.arrays_overlap(words(c), rare))
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text"), (F.lit(False) if whole is None else whole).alias("whole"))
    none = F.array().cast("array<string>")
    complete = F.when(F.col("whole"), F.array("text")).otherwise(none)
    sentences = F.split("text", r"(?<=[.!?])\s+|" + BREAK)
    lines = F.split("text", "\n")
    listing = lambda c, line: F.transform(F.array_distinct(c), lambda p: F.struct(F.lit(line).alias("line"), p.alias("passage")))
    blocks = F.filter(F.concat(adjacent(lines, 2, LINES), sentences, complete), short_anchor)
    near = rows.where(short_anchor(F.col("text")))
    found = _scored(near.select("path", F.explode(F.concat(listing(F.filter(lines, short_anchor), True), listing(blocks, False))).alias("p")).select("path", "p.*"),
                    short_anchor, vectors[0], weights[0], rarest, least)
    if texts:
        paragraphs = F.split("text", BREAK)
        parts = F.concat(sentences, F.filter(adjacent(paragraphs, 1, PARAGRAPHS), lambda p: F.length(p) <= BLOCK), complete)
        found = found.union(_scored(rows.where(long_anchor(F.col("text"))).select("path", F.explode(listing(parts, False)).alias("p")).select("path", "p.*"),
                                    long_anchor, vectors[1], weights[1], rarest, least))
    best = F.max_by(F.struct("license", "similarity", "chars"), F.struct("similarity", "rank", "line", "chars"))
    names = sorted({k.split(" ")[0] for k in (*notices, *texts)}, reverse=True)
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    return found.withColumn("rank", ranks[F.col("license")]).groupBy("path").agg(best.alias("b")).select("path", "b.*")


def above(path: Column) -> Column:
    """The directory of a path; the empty string is the root."""
    return F.coalesce(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def scan(files: DataFrame, path: str = "path", text: str = "text", whole: Column | None = None, is_licence_file: Column | None = None,
         notices: dict[str, str] = NOTICES, least: float = LEAST) -> DataFrame:
    """``(path, license, similarity, declared_in)`` for every distinct path.

    A file's own notice comes first. Without one it takes the licence of the nearest directory at or above its own that holds
    a licence file with a notice (the most similar, then the first path); without that the columns are null.
    ``is_licence_file`` is a condition over the columns of ``files`` and of ``notices_of``; by default the file's name
    says so. A null path is a file at the root.

    Inheritance is worked out by directory, by joins of its ancestors with the directories of licence files; files
    join their directory's result, hot directories on several tasks.
    """
    spark = files.sparkSession
    named = F.lower(F.col(path)).rlike(r"(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$")
    own = cut_lineage(notices_of(files, path, text, named if whole is None else whole, notices, least), "notices")
    clear = files.drop(*{"license", "similarity", "chars", "__path"} - {path, text})  # the notices' own columns count
    sizes = clear.join(own.withColumnRenamed("path", "__path"), F.col(path).eqNullSafe(F.col("__path")))
    declared = (sizes.where(named if is_licence_file is None else is_licence_file)
                .select(F.coalesce(path, F.lit("")).alias("path"), "license", "similarity").distinct())
    of_directory = cut_lineage(declared.groupBy(above(F.col("path")).alias("directory")).agg(
        F.min_by(F.struct("license", "similarity", F.col("path").alias("declared_in")), F.struct(-F.col("similarity"), "path")).alias("d")
    ).select("directory", "d.*"), "licence-directories")
    every = cut_lineage(files.select(F.col(path).alias("path"), above(F.col(path)).alias("directory")).distinct(), "paths")
    parts = F.split("directory", "/")
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(parts))
    ancestors = every.select("directory").distinct().select("directory", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).withColumn(
        "ancestor", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = (spread_join(ancestors, of_directory.withColumnRenamed("directory", "ancestor"), "ancestor", F.col("directory"))
               .groupBy("directory").agg(F.max_by(F.struct("license", "similarity", "declared_in"), "depth").alias("inherited")))
    joined = spread_join(every, nearest, "directory", F.col("path"), "left").join(
        own.select(F.col("path").alias("__path"), F.struct("license", "similarity", F.col("path").alias("declared_in")).alias("own")),
        F.col("path").eqNullSafe(F.col("__path")), "left")
    return joined.select("path", F.coalesce("own", "inherited").alias("f")).select("path", "f.*")
