"""Licence scan: TF-IDF cosine of headers and licence files to templates, and inheritance along directories.

Every line of a file is a possible header, and so is its leading comment block: as a whole, its paragraphs that sound like
a licence, and each paragraph. A file whose whole text is like a template is a licence file, which holds
for all files below its directory that have no header of their own. Terms are weighted by their rarity over all
files. A vector that is like a template must contain one of the template's heaviest terms (what is left of
the template is too short to reach the threshold), so only files with such a term are taken apart.

Lines and texts are compared with the notices by plain counts. Blocks, and texts with whole licences, are compared by
damped counts (1 + ln n): a licence is then a matter of its many terms and not of "the" and "of". A text that is like a
licence must hold terms that make up ``threshold ** 2`` of the licence's squared length; only such texts are taken apart.
"""

from __future__ import annotations

import math
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, functions as F

from .frames import stored

HEADER = 0.8
LICENCE_FILE = 0.5

# Licence notices, as (licence, notice).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# Further notices as they stand in comment blocks, where they are joined.
BLOCKS = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    """The licence texts beside this file, as (licence, text)."""
    found = [f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    return tuple(sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in found))


TEXTS = whole_texts()

# What may stand before the first comment, a line that is a comment, and comments over several lines.
PREAMBLE = r"\A\x{FEFF}?\s*+(?:#![^\n]*+)?\s*+(?:<\?(?:xml|php)[^\n]*+)?\s*+"
COMMENT_LINE = r"^\s*+(?:#(?!(?:include|define|undef|pragma|import|if|ifdef|ifndef|endif)\b)|//|--|;|%|!|(?i:dnl|rem)\b|/\*.*\*/\s*$|$)"
COMMENTS = r"""(?s)\A(?:\s*+(?:/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'{3}.*?'{3}|\(\*.*?\*\)|\{-.*?-\})){1,3}"""
COMMENTED = PREAMBLE + r"""(?:#|//|--|;|%|!|(?i:dnl|rem)\b|/\*|<!--|\"\"\"|'{3}|\(\*|\{-)"""
HOLDER_LINE = r"(?im)^[^\p{L}\p{N}\n]*(?:copyright\s+(?:\(c\)|©|\d|by\b)|©|\(c\)\s|all rights reserved|spdx-)[^\n]*$"
SPDX = r"(?m)^\W*SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*(?: (?:AND|OR|WITH) [A-Za-z0-9][A-Za-z0-9.+-]*)*)"


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def template_counts(notices: tuple[tuple[str, str], ...]) -> dict[int, dict[str, int]]:
    """Term counts per notice; notices are short and few."""
    out: dict[int, dict[str, int]] = {}
    for number, (_, text) in enumerate(notices):
        counts = out.setdefault(number, {})
        for term in re.findall(r"[^\W_]+", text.lower()):
            counts[term] = counts.get(term, 0) + 1
    return out


def damped(counts: dict[int, dict[str, int]]) -> dict[int, dict[str, float]]:
    return {k: {t: 1 + math.log(n) for t, n in c.items()} for k, c in counts.items()}


def unit_vectors(counts: dict[int, dict[str, float]], idf: dict[str, float]) -> list[tuple[int, str, float]]:
    """Rows (template, term, unit) of length one per template."""
    rows = []
    for number, terms in counts.items():
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        rows += [(number, t, n * idf[t] / length) for t, n in sorted(terms.items())]
    return rows


def word_pattern(terms: list[str]) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(terms)})(?![\p{{L}}\p{{N}}])"


def leading_comments(text: Column) -> tuple[Column, Column]:
    """The comments that a text begins with (empty if it begins otherwise), and the text behind them."""

    def lines(rest: Column) -> Column:
        parts = F.split(rest, "\n", -1)
        end = F.array_position(F.transform(parts, lambda p: p.rlike(COMMENT_LINE)), False)
        return F.array_join(F.when(end > 0, F.slice(parts, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(parts), "\n")

    def behind(rest: Column, part: Column) -> Column:
        return F.substring(rest, F.length(part) + 1, F.length(rest))

    body = F.regexp_replace(text, PREAMBLE, "")
    first = lines(body)
    second = F.regexp_extract(behind(body, first), COMMENTS, 0)
    third = lines(behind(body, F.concat(first, second)))
    block = F.concat_ws("\n", first, second, third)
    begins = text.rlike(COMMENTED)
    # Lines are joined without the break behind them, which is left to the rest.
    return F.when(begins, block).otherwise(""), F.when(begins, behind(body, F.concat(first, second, third))).otherwise(text)


def paragraphs(block: Column) -> Column:
    """Paragraphs of a comment block without the lines that name its holders; lines without a letter or digit part them."""
    bare = F.regexp_replace(F.regexp_replace(block, "\r", ""), HOLDER_LINE, "")
    bare = F.regexp_replace(bare, r"(?im)^([^\p{L}\p{N}\n]*)(?:dnl|rem)\b", "$1")
    return F.filter(F.split(bare, r"\n[^\p{L}\p{N}\n]*+(?=\n|\z)", -1), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def declared(text: Column) -> Column:
    """The licence of the first SPDX line, without the ending that says whether later versions hold too."""
    found = F.regexp_replace(F.regexp_extract(text, SPDX, 1), r"(?:-only|-or-later|\+)(?= |$)", "")
    return F.when(text.contains("SPDX-License-Identifier:") & (found != ""), found)


def rarity(files: int, holding: int) -> float:
    return math.log((1 + files) / (1 + holding)) + 1


def heavy_terms(counts: dict[str, int], idf: dict[str, float], least: float) -> list[str]:
    """The heaviest terms without which the rest of a template is shorter than ``least`` of its length."""
    weights = sorted(((n * idf[t]) ** 2, t) for t, n in counts.items())
    rest, limit, heavy = 0.0, least**2 * sum(w for w, _ in weights), []
    for weight, term in weights:
        rest += weight
        if rest >= limit * (1 - 1e-9):
            heavy.append(term)
    return heavy


def cosines(vectors: DataFrame, keys: list[str], idf: DataFrame, unseen: float, templates: DataFrame) -> DataFrame:
    """``keys, template, cosine`` of term counts ``keys, term, tf`` with all templates that share a term."""
    weighted = vectors.join(idf, "term", "left").withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = weighted.join(templates, "term").groupBy(*keys, "template").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"))
    return dots.join(norms, keys).withColumn("cosine", F.col("dot") / F.col("norm"))


def best(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The licence of the most similar template, rounded cosines and the first template deciding."""
    score = F.round("cosine", 9)
    return matches.groupBy(*keys).agg(F.min_by(F.struct("licence", score.alias("cosine")), F.struct(-score, F.col("template"))).alias("m"))


def nearest_licences(directories: DataFrame, holders: DataFrame) -> DataFrame:
    """``directory, licence``: of each directory the licence of the nearest one at or above it that has a licence file."""
    levels = F.sequence(F.lit(0), F.size(F.split("directory", "/")))
    up = directories.select("directory", F.explode(levels).alias("depth"))
    up = up.withColumn("holder", F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.col("depth")), "/"))
    up = up.filter((F.col("directory") != "") | (F.col("depth") == 0))
    met = up.join(holders.select(F.col("directory").alias("holder"), "licence"), "holder")
    return met.groupBy("directory").agg(F.max_by("licence", "depth").alias("inherited"))


def known_words(terms: list[str]) -> Column:
    return F.split(F.lit(" ".join(terms)), " ")


def held_counts(rows: DataFrame, terms: list[str]) -> dict[str, int]:
    """Rows that hold each of the terms."""
    holding = rows.select(F.explode(F.array_intersect(known_words(terms), terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)))
    return {r[0]: r[1] for r in holding.collect()}  # a row per template term at most


def near_texts(rows: DataFrame, units: list[tuple[int, str, float]], least: float) -> DataFrame:
    """``path`` of the texts whose terms make up ``least ** 2`` of a template's squared length: no other text reaches ``least``."""
    numbers = sorted({u[0] for u in units})
    shares: dict[str, dict[int, float]] = {}
    for number, term, unit in units:
        shares.setdefault(term, {})[number] = unit * unit
    table = [(t, *[by.get(n, 0.0) for n in numbers]) for t, by in sorted(shares.items())]
    names = [f"share{n}" for n in numbers]
    weights = rows.sparkSession.createDataFrame(table, ", ".join(["term string", *[f"{n} double" for n in names]]))
    held = rows.select("path", F.explode(F.array_intersect(known_words(sorted(shares)), terms_of(F.col("text")))).alias("term"))
    sums = held.join(F.broadcast(weights), "term").groupBy("path").agg(*[F.sum(n).alias(n) for n in names])
    # Rows of one path may count a term twice, which only lets more through.
    return sums.filter(F.greatest(F.lit(0.0), *names) >= least**2 * (1 - 1e-9)).select("path")


def block_matches(rows: DataFrame, counts: dict[int, dict[str, float]], idf: dict[str, float], unseen: float, templates: DataFrame, header: float) -> DataFrame:
    """``path, template, cosine, part`` for leading comment blocks (``path, text``, ``block``) that reach ``header``; ``part`` is true for single paragraphs."""
    anchors = word_pattern(sorted({t for c in counts.values() for t in heavy_terms(c, idf, header)}))
    split = rows.filter(F.lower("block").rlike(anchors)).select("path", F.xxhash64("text").alias("row"), paragraphs(F.col("block")).alias("all"))
    near = split.withColumn("near", F.filter("all", lambda p: F.lower(p).rlike(anchors)))
    joined = F.array(F.array_join("all", "\n"), F.array_join("near", "\n"))
    pieces = near.select("path", "row", F.posexplode(F.concat(joined, "near")).alias("piece", "content"))
    terms = pieces.select("path", "row", "piece", F.explode(terms_of(F.col("content"))).alias("term"))
    terms = stored(terms.groupBy("path", "row", "piece", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf")), "licence-blocks")
    idf_table = rows.sparkSession.createDataFrame(sorted(idf.items()), "term string, idf double")
    found = cosines(terms, ["path", "row", "piece"], idf_table, unseen, templates)
    return found.filter(F.col("cosine") >= header - 1e-9).select("path", "template", "cosine", (F.col("piece") > 1).alias("part"))


def license_scan(
    files: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, header: float = HEADER, licence_file: float = LICENCE_FILE,
    blocks: tuple[tuple[str, str], ...] = BLOCKS, texts: tuple[tuple[str, str], ...] = TEXTS,
) -> DataFrame:
    """``(path, licence, cosine, found)`` per distinct path of ``files`` (``path, text``).

    ``found`` is ``header`` (an SPDX line; or a leading comment block, a paragraph of it, or a line whose cosine to a template is at
    least ``header``), ``file`` (the whole text reaches ``licence_file`` for a notice, or what follows the leading comments
    does for a whole licence), ``inherited`` (from the nearest directory upwards with such a file) or null. ``cosine`` is null for
    inherited licences. An SPDX line decides (with cosine 1), then the block as a whole, then the best paragraph or line. Of several licence files in a directory the most similar one counts, then the first licence by name. Paths are parted by ``/``;
    a file without one lies in the root. Null and empty texts hold no licence but inherit. Rows with a null path are left out, rows of one path
    are one file (the best line of any, texts counted together). An empty table gives an empty one; further columns are ignored.
    """
    spark = files.sparkSession
    rows = files.select("path", "text").filter("path IS NOT NULL")
    total = rows.filter("text IS NOT NULL").count()
    unseen = rarity(total, 0)
    counts = template_counts(notices)
    # Whole licences and blocks have idf of their own, so that they don't change the weights of lines.
    wide_names = [*notices, *blocks, *texts]
    wide = damped(template_counts(tuple(wide_names)))
    vocabulary = sorted({t for c in counts.values() for t in c})
    held = held_counts(rows, sorted({t for c in wide.values() for t in c}))
    wide_idf = {t: rarity(total, held.get(t, 0)) for c in wide.values() for t in c}
    idf = {t: wide_idf[t] for t in vocabulary}
    idf_table = spark.createDataFrame(sorted(idf.items()), "term string, idf double")
    units = "template int, term string, unit double"
    templates = spark.createDataFrame(unit_vectors(counts, idf), units)
    wide_units = unit_vectors(wide, wide_idf)
    whole_units = [u for u in wide_units if u[0] >= len(notices) + len(blocks)]
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(wide_names)], "template int, licence string")

    anchors = sorted({t for c in counts.values() for t in heavy_terms(c, idf, min(header, licence_file))})
    pattern = word_pattern(anchors)
    candidates = rows.filter(F.lower("text").rlike(pattern)).select("path", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    candidates = candidates.withColumn("anchored", F.lower("content").rlike(pattern))
    terms = candidates.select("path", "line", "anchored", F.explode(terms_of(F.col("content"))).alias("term"))
    terms = stored(terms.groupBy("path", "line", "anchored", "term").agg(F.count(F.lit(1)).alias("tf")), "licence-terms")
    lines = cosines(terms.filter("anchored").drop("anchored"), ["path", "line"], idf_table, unseen, templates)
    notice_terms = terms.groupBy("path", "term").agg(F.sum("tf").alias("tf"))
    like_notices = cosines(notice_terms, ["path"], idf_table, unseen, templates)

    block, rest = leading_comments(F.col("text"))
    commented = rows.filter(F.col("text").rlike(COMMENTED)).withColumn("block", block)
    in_blocks = block_matches(commented, wide, wide_idf, unseen, spark.createDataFrame(wide_units, units), header)
    spdx = rows.select("path", declared(F.col("text")).alias("spdx")).filter("spdx IS NOT NULL").groupBy("path").agg(F.min("spdx").alias("spdx"))

    behind = rows.select("path", rest.alias("text"))
    near = stored(near_texts(behind, whole_units, licence_file), "licence-near") if whole_units else rows.select("path").limit(0)
    words = behind.join(F.broadcast(near), "path", "left_semi").select("path", F.explode(terms_of(F.col("text"))).alias("term"))
    words = stored(words.groupBy("path", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf")), "licence-texts")
    wide_table = spark.createDataFrame(sorted(wide_idf.items()), "term string, idf double")
    like_texts = cosines(words, ["path"], wide_table, unseen, spark.createDataFrame(whole_units, units))

    own = lines.filter(F.col("cosine") >= header - 1e-9).select("path", "template", "cosine", F.lit(True).alias("part")).unionByName(in_blocks)
    # A block as a whole goes before its paragraphs and before lines.
    whole = own.groupBy("path").agg(F.min("part").alias("part"))
    own = best(own.join(whole, ["path", "part"]).join(names, "template"), ["path"]).select("path", F.col("m").alias("h"))
    full = like_notices.select("path", "template", "cosine").unionByName(like_texts.select("path", "template", "cosine"))
    full = best(full.filter(F.col("cosine") >= licence_file - 1e-9).join(names, "template"), ["path"]).select("path", F.col("m").alias("f"))
    stated = F.when(F.col("spdx").isNotNull(), F.struct(F.col("spdx").alias("licence"), F.lit(1.0).alias("cosine")))
    marks = own.join(spdx, "path", "full").select("path", F.coalesce(stated, "h").alias("h"))
    marks = stored(marks.join(full, "path", "full"), "licence-marks")

    def folder(path: Column) -> Column:
        return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)

    ranked = marks.filter("f IS NOT NULL").select(folder(F.col("path")).alias("directory"), "f.*")
    holders = ranked.groupBy("directory").agg(F.min_by("licence", F.struct(-F.col("cosine"), F.col("licence"))).alias("licence"))
    paths = stored(rows.select("path").distinct().withColumn("directory", folder(F.col("path"))), "licence-paths")
    inherited = nearest_licences(paths.select("directory").distinct(), holders)
    out = paths.join(marks, "path", "left").join(inherited, "directory", "left")
    found = F.when(F.col("h").isNotNull(), "header").when(F.col("f").isNotNull(), "file").when(F.col("inherited").isNotNull(), "inherited")
    return out.select("path", F.coalesce("h.licence", "f.licence", "inherited").alias("licence"), F.coalesce("h.cosine", "f.cosine").alias("cosine"), found.alias("found"))
