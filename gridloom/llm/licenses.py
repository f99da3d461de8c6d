"""Operator 4: licence scans, in DataFrame functions only.

Windows of 1, 4 and 16 lines (headers that wrap, whole licence files) are compared with templates by the cosine of sparse
TF-IDF vectors over the templates' terms, the inverse frequencies being those of all documents. Only windows with a heavy
term can reach the least cosine, so that others are never exploded. A file's licence is its best window's. Files without one
inherit from the licence file of their nearest ancestor directory, found by joining every directory above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import dropped, stored

LEAST = 0.6
#: Lines of a window; each starts half a window after the one before.
SPANS = (1, 4, 16)
#: A text of so many lines at most that makes a statement is a licence file.
FILE_LINES = 3
_SHORT = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0", "Unlicense"]
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version."
#: Statements by which licences are named, their notices and the openings of their texts.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released to the public domain under CC0 1.0"),
    ("proprietary", "Copyright. All rights reserved"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", _GNU.format(what="program", name="General Public License", n=3)),
    ("GPL-2.0", _GNU.format(what="program", name="General Public License", n=2)),
    ("LGPL-3.0", _GNU.format(what="library", name="Lesser General Public License", n=3)),
    ("AGPL-3.0", _GNU.format(what="program", name="Affero General Public License", n=3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    *((x, f"SPDX-License-Identifier: {x}") for x in _SHORT),
]


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def _weight(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def template_weights(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(term, idf), and (template, license, term, weight) with unit vectors: as many rows as the templates have terms. The
    inverse frequencies count the files that have a term."""
    spark: SparkSession = files.sparkSession
    t = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(templates)], "template int, license string, text string")
    tf = t.select("template", "license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    words = sorted({r[0] for r in tf.select("term").distinct().collect()})
    # One pass: which of the templates' terms a file has, counted before anything is shuffled.
    own = F.array_intersect(_terms(F.col("text")), F.array(*map(F.lit, words)))
    seen = files.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    seen = stored(seen)
    n = seen.filter("term = ''").select(F.col("df").alias("n"))
    every = spark.createDataFrame([(w,) for w in words], "term string").join(F.broadcast(seen), "term", "left")
    idf = stored(every.join(F.broadcast(n), how="cross").select("term", _weight(F.coalesce("df", F.lit(0)), F.col("n")).alias("idf")))
    w = tf.join(F.broadcast(idf), "term").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    out = stored(w.join(F.broadcast(norm), "template").select("template", "license", "term", (F.col("weight") / F.col("norm")).alias("weight")))
    dropped(seen)
    return idf, out


def heavy_terms(weights: DataFrame, least: float) -> list[str]:
    """Terms of which a window must have one to reach `least`: each template's heaviest, until the rest of its vector is too short."""
    by: dict[int, list] = {}
    for r in weights.select("template", "weight", "term").collect():  # the templates' terms
        by.setdefault(r[0], []).append((r[1], r[2]))
    out = set()
    for terms in by.values():
        rest = 1.0
        for w, term in sorted(terms, reverse=True):
            if rest < least**2 * 0.999:
                break
            out.add(term)
            rest -= w * w
    return sorted(out)


def _windows(lines: Column) -> Column:
    """Structs (line, text) of the windows over an array of lines; only the shortest span that holds all lines is the last."""
    n, out = F.size(lines), []
    for k, span in enumerate(SPANS):
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(max(1, span // 2)))
        made = F.transform(starts, lambda i: F.struct(i.alias("line"), F.array_join(F.slice(lines, i + 1, F.lit(span)), " ").alias("text")))  # noqa: B023
        out.append(made if k == 0 else F.when(n > SPANS[k - 1], made).otherwise(F.slice(made, 1, 0)))
    return F.concat(*out)


def scanned(files: DataFrame, least: float = LEAST, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, license, similarity, line), a stored table: the best match of each file (doc_id, text) that has one of `least`
    or more; ties go to the first line, then the first template. Null and empty texts match nothing."""
    files = files.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    idf, weights = template_weights(files, templates)
    heavy = heavy_terms(weights, least)
    gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(heavy) + r")(?![a-z0-9])"
    # In a row, lines without a heavy term go before windows are built only where no window could need them: whole texts are gated.
    windows = files.filter(F.col("text").rlike(gate)).select("doc_id", F.explode(F.filter(_windows(F.split("text", "\n", -1)), lambda w: w["text"].rlike(gate))).alias("w"))
    windows = stored(windows.select("doc_id", "w.line", F.col("w.text").alias("s")))
    # Equal windows are compared once, however many files have them.
    said = windows.groupBy("s").agg(F.count("*").alias("n"))
    tf = said.select("s", F.explode(_terms(F.col("s"))).alias("term")).join(F.broadcast(idf), "term").groupBy("s", "term", "idf").agg(F.count("*").alias("tf"))
    vec = tf.withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = vec.groupBy("s").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    dots = vec.join(F.broadcast(weights), "term").groupBy("s", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    best = dots.join(norm, "s").select("s", "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).filter(F.col("similarity") >= least)
    best = stored(best.groupBy("s").agg(F.max(F.struct("similarity", (-F.col("template")).alias("t"), "license")).alias("b")).select("s", "b.similarity", "b.license", (-F.col("b.t")).alias("template")))
    hits = windows.join(best, "s").groupBy("doc_id").agg(F.max(F.struct("similarity", (-F.col("line")).alias("l"), (-F.col("template")).alias("t"), "license")).alias("b"))
    out = stored(hits.select("doc_id", "b.license", "b.similarity", (-F.col("b.l")).alias("line")))
    dropped(idf, weights, windows, best)
    return out


def inherited(files: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, path, license, similarity, origin) for every file: origin is `header`, `inherited` or null.

    files has doc_id, path and is_license; a directory's licence is that of its most similar licence file, the least path on
    ties. A file inherits from the nearest directory above it. Null paths have no directory; repeated rows repeat."""
    known = files.select("doc_id", "path", "is_license").join(own.select("doc_id", "license", "similarity"), "doc_id", "left")
    steps = F.split("path", "/")
    folder = F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/")
    named = known.filter("is_license and license is not null and path is not null")
    dirs = named.groupBy(folder.alias("dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("x")).select("dir", F.col("x.license").alias("dir_license"))
    # One lookup a directory, not a file: folders with very many files do not weigh on the join.
    here = known.filter("license is null and path is not null").select(folder.alias("folder")).distinct()
    above = here.select("folder", F.explode(F.sequence(F.lit(0), F.size(F.split("folder", "/")))).alias("depth")).select("folder", "depth", F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    # Stored, so that the planner knows the size: few directories are broadcast, more are joined with skewed keys split.
    nearest = stored(above.join(dirs, "dir").groupBy("folder").agg(F.max_by("dir_license", "depth").alias("dir_license")))
    out = known.withColumn("folder", folder).join(nearest, "folder", "left")
    return out.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), "similarity", F.when(F.col("license").isNotNull(), "header").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; texts of at most FILE_LINES lines may be licence files. Other columns are not read."""
    text = F.coalesce("text", F.lit(""))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), (F.size(F.split(text, "\n", -1)) <= FILE_LINES).alias("is_license"))


def license_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, path, license, similarity, origin) for every document, whole texts, however long; null texts are empty, a
    repeated doc_id repeats (its texts count as one file's), an empty table gives no rows."""
    files = document_files(docs)
    return inherited(files, scanned(files))


def _oracle() -> str:
    rows = ", ".join(f"({k}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')" for k, (a, b) in enumerate(TEMPLATES))
    terms = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    spans = " UNION ALL ".join(
        f"SELECT doc_id, i AS line, array_to_string(lines[i + 1:i + {span}], ' ') AS s FROM (SELECT doc_id, lines, unnest(range(0, len(lines), {max(1, span // 2)})) AS i FROM d" + (f" WHERE len(lines) > {SPANS[k - 1]})" if k else ")")
        for k, span in enumerate(SPANS)
    )
    return f"""
WITH t(template, license, text) AS (VALUES {rows}),
tt AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({terms('text')}) AS term FROM t) GROUP BY ALL),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({terms("coalesce(text, '')")})) AS term FROM documents) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN f USING (term)),
tw AS (SELECT template, license, term, (1 + ln(tf)) * idf AS w FROM tt JOIN idf USING (term)),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
win AS ({spans}),
said AS (SELECT s, row_number() OVER () AS k FROM (SELECT DISTINCT s FROM win)),
v AS (SELECT k, term, (1 + ln(count(*))) * any_value(idf) AS w FROM (SELECT k, unnest({terms('s')}) AS term FROM said) JOIN idf USING (term) GROUP BY k, term),
vn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM v GROUP BY k),
c AS (SELECT k, template, license, round(sum(v.w * tw.w / tn.norm) / any_value(vn.norm), 6) AS similarity FROM v JOIN tw USING (term) JOIN tn USING (template) JOIN vn USING (k) GROUP BY k, template, license),
b AS (SELECT s, template, license, similarity FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY similarity DESC, template) AS r FROM c WHERE similarity >= {LEAST}) JOIN said USING (k) WHERE r = 1),
own AS (SELECT doc_id, license, similarity FROM (SELECT doc_id, license, similarity, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, line, template) AS r FROM win JOIN b USING (s)) WHERE r = 1),
p AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') AS folder, coalesce(source, 'none') AS top, len(string_split(coalesce(text, ''), chr(10))) <= {FILE_LINES} AS is_license FROM documents),
k AS (SELECT p.*, folder || '/' || doc_id || '.txt' AS path, license, similarity FROM p LEFT JOIN own USING (doc_id)),
dirs AS (SELECT folder, license FROM (SELECT folder, license, row_number() OVER (PARTITION BY folder ORDER BY similarity DESC, path) AS r FROM k WHERE is_license AND license IS NOT NULL) WHERE r = 1)
SELECT doc_id, path, coalesce(k.license, dirs.license) AS license, similarity, CASE WHEN k.license IS NOT NULL THEN 'header' WHEN dirs.license IS NOT NULL THEN 'inherited' END AS origin
FROM k LEFT JOIN dirs USING (folder)"""


ORACLE_OP4 = _oracle()
