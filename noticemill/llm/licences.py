"""Licence scans: TF-IDF cosine of notices and licence files to templates, then the nearest ancestor directory's licence.

DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.llm.tables import stage

# Notices as projects state them, several for a licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license. See the LICENSE file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    # Headers of several lines and the opening or own clauses of the licences' texts.
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
# Any line or passage a licence could be stated in has one of these.
HINT = (r"(?i)licen[cs]|copyright|spdx|creative\W+commons|redistribut|free\W+of\W+charge|public\W+domain|mozilla\W+public|source\W+code\W+form|"
        r"general\W+public|free\W+software|cc[\W_]+by\b|\bcc0\b|bsd[\W_]+style|endorse\W+or\W+promote")
# Marks of comments at the ends of a line.
MARKS = r"(?i)^\s*(?:(?://+|/\*+|\*+/?|#+|;+|--+|<!--|%+|>+|(?:dnl|rem)\b)\s*)+|\s*(?:\*+/|-->)\s*$"
SENTENCE = r"(?<=[.!?:;])\s+(?=[A-Z\"'(])"
# Neighbouring lines put together.
RUN = 6
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"
COSINE = 0.7


def terms(text: Column) -> Column:
    """Lower-cased words of letters, digits and inner dots."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.+(?=[^a-z0-9]|$)"), lambda t: t != "")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(n, licence, text) for n, (licence, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template int, licence string, notice string")


def _passages(lines: Column, words: Column) -> Column:
    """Passages around the hints of a text: runs of up to RUN lines, sentences over line ends and pairs of them, and, wherever
    a template's first word stands, as many words as the template has."""
    hinted = lambda parts: F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda p: F.get(parts, p).rlike(HINT))
    joined = lambda parts, a, n: F.array_join(F.slice(parts, a + 1, n), " ")
    runs = F.transform(hinted(lines), lambda p: F.flatten(F.transform(
        F.sequence(F.greatest(p - (RUN - 1), F.lit(0)), p),
        lambda a: F.transform(F.sequence(F.greatest(F.lit(2), p - a + 1), F.lit(RUN)), lambda n: joined(lines, a, n)))))
    sentences = F.split(F.array_join(lines, " "), SENTENCE)
    around = F.transform(hinted(sentences), lambda p: F.array(
        F.get(sentences, p), joined(sentences, p, F.lit(2)), joined(sentences, F.greatest(p - 1, F.lit(0)), F.lit(2))))
    lengths: dict[str, set[int]] = {}
    for _, text in TEMPLATES:
        own = template_terms(text)
        lengths.setdefault(own[0], set()).add(len(own))
    begins = F.create_map(*[x for first in sorted(lengths) for x in (F.lit(first), F.array(*map(F.lit, sorted(lengths[first]))))])
    anchors = F.filter(F.sequence(F.lit(0), F.size(words)), lambda p: F.get(words, p).isin(sorted(lengths)))
    windows = F.transform(anchors, lambda p: F.filter(
        F.transform(F.element_at(begins, F.get(words, p)), lambda n: joined(words, p, n)), lambda x: x.rlike(HINT)))
    return F.flatten(F.concat(runs, around, windows))


def template_terms(text: str) -> list[str]:
    """terms() of a fixed text."""
    return [t for t in re.split(r"[^a-z0-9.]+|\.+(?=[^a-z0-9]|$)", text.lower()) if t]


def _counted(units: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of short texts, each counted within its own row."""
    own = units.select(key, F.explode(terms(F.col(text))).alias("term"))
    return own.groupBy(key, "term").agg(F.count("*").alias("tf"))


def match_notices(notices: DataFrame) -> DataFrame:
    """Best template of each distinct notice: id, licence, cosine. notices: id, notice, n (times it stands in the corpus).

    Only ids travel with the terms; a notice may be a whole licence file.
    Document frequencies count every notice of the corpus, as often as it stands there, and every template once.
    """
    templates = _templates(notices.sparkSession)
    mine = _counted(notices, "id", "notice")
    theirs = _counted(templates, "template", "notice")
    seen = mine.join(notices.select("id", "n"), "id").groupBy("term").agg(F.sum("n").alias("n"))
    seen = seen.unionByName(theirs.groupBy("term").agg(F.count("*").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    all_ = notices.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    idf = seen.crossJoin(F.broadcast(all_)).select(  # one row
        "term", (F.log((F.col("n") + len(TEMPLATES) + 1.0) / (F.col("df") + 0.5)) + 0.1).alias("idf"))
    weigh = lambda rows: rows.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # At most the terms of the fixed templates above.
    w = F.broadcast(weigh(theirs).select("template", "term", F.col("w").alias("tw")))
    t_norm = weigh(theirs).groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    own = weigh(mine)
    norm = own.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = own.join(w, "term").groupBy("id", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dot.join(F.broadcast(t_norm.join(templates.select("template", "licence"), "template")), "template").join(norm, "id")
    scored = scored.withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6))
    best = scored.groupBy("id").agg(F.max(F.struct("cosine", (-F.col("template")).alias("first"), "licence")).alias("best"))
    return best.select("id", "best.licence", "best.cosine")


def scan_licences(files: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Licence of every file. files: file_id, path (with /), text; other columns are left behind.

    Every line of the whole text that could state a licence is compared with the templates, and so are the passages around
    it (see _passages), without marks of comments; of a licence file (by its name) the whole text is compared too. A line's licence is that of its best template, ties by their order; a file's
    own licence is that of its best line at the threshold or above, ties by the last name. A file without one takes that of the nearest directory above it, its own included, that
    has a licence file with a licence; of several in one directory the best counts, ties by the last path.
    Returns file_id, path, licence, cosine, origin (own, inherited or none) and declared_by (path of the file that states it).
    Null texts state nothing; a null path has no directory and inherits nothing; repeated rows are all returned.
    """
    rows = files.select("file_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(HINT))
    whole = F.when(name.rlike(LICENCE_FILE) & F.col("text").rlike(HINT), F.array("text")).otherwise(F.expr("cast(array() as array<string>)"))
    # Only texts with a hint are taken apart any further.
    hinted = F.when(F.col("text").rlike(HINT), F.col("text")).otherwise("")
    cut = rows.select("file_id", "path", F.concat(lines, whole).alias("notices"), hinted.alias("hinted"))
    cut = cut.select("file_id", "path", "notices", F.transform(F.split("hinted", "\r?\n"), lambda x: F.regexp_replace(x, MARKS, "")).alias("lines"),
                     terms(F.col("hinted")).alias("words"))
    # Texts stay behind here: only ids, paths and the few notices go on.
    found, _ = stage(cut.select("file_id", "path", F.array_distinct(F.concat("notices", _passages(F.col("lines"), F.col("words")))).alias("notices")), "notices")
    each = found.select("file_id", "path", F.explode("notices").alias("notice")).withColumn("id", F.md5("notice"))
    distinct = each.groupBy("id").agg(F.first("notice").alias("notice"), F.count("*").alias("n"))
    matched, _ = stage(match_notices(distinct).where(F.col("cosine") >= threshold), "matched")
    own = each.select("file_id", "path", "id").join(matched, "id").groupBy("file_id", "path").agg(
        F.max(F.struct("cosine", "licence")).alias("best"))
    own = own.select(F.col("file_id").alias("own_id"), F.col("path").alias("own_path"), "best.licence", "best.cosine")
    folder = lambda path: F.regexp_replace(path, "/[^/]*$", "")
    declared = own.where(F.element_at(F.split("own_path", "/"), -1).rlike(LICENCE_FILE)).groupBy(
        folder(F.col("own_path")).alias("above")).agg(F.max_by(F.struct("licence", "cosine", "own_path"), F.struct("cosine", F.col("own_path"))).alias("d"))
    # Ancestors are worked out once per directory, not per file.
    folders = found.where("path is not null").select(folder(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = folders.select("folder", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "above"))
    nearest = above.join(declared, "above").groupBy("folder").agg(F.max_by("d", "depth").alias("d"))
    placed = found.select("file_id", "path", folder(F.col("path")).alias("folder"))
    joined = placed.join(own, F.col("file_id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    joined = joined.join(nearest, "folder", "left")
    mine = F.col("licence").isNotNull()
    return joined.select(
        "file_id", "path", F.coalesce("licence", "d.licence").alias("licence"), F.coalesce("cosine", "d.cosine").alias("cosine"),
        F.when(mine, "own").when(F.col("d").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("d.own_path")).alias("declared_by"))
