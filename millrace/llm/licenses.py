"""Licences by TF-IDF cosine to templates, inherited from the nearest directory above.

What a file says about its licence, its lines on licence or copyright, is a sparse TF-IDF vector that
is compared with those of known notices.  A file that speaks of a licence near none of them is of an
unknown one.  A file that speaks of none takes that of the licence file in its directory, or else in
the nearest directory above that has one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, plain, written

THRESHOLD = 0.5
#: Notices as their licences word them.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.",),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain."),
    "EPL-2.0": ("Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Proprietary": ("All rights reserved.", "Copyright. All rights reserved. Confidential and proprietary."),
}
#: The Creative Commons family, in long and short form.
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES |= {f"CC-{short}-{version}": (
    f"Licensed under the Creative Commons {long} {version} {scope} License.",
    f"This work is licensed under a Creative Commons {long} {version} {scope} License.",
    f"Licensed under CC {short} {version}.", f"Licensed under CC-{short}-{version}.")
    for short, long in COMMONS.items() for version, scope in (("4.0", "International"), ("3.0", "Unported"))}
#: What a file has that speaks of a licence near no template.
UNKNOWN = "unknown"
TELLING = r"(?i)licen[sc]|copyright|all rights reserved|spdx|permission is hereby|redistribut|public domain|creative commons|\bcc0\b|\bcc[ -]by\b|permission to use"
FILE_NAMES = r"(?i)^(licen[sc]e|copying|notice)([.].*)?$"
#: A run of letters, digits, dots and hyphens between two letters or digits; a flat class, as long runs overflow a group's stack.
TERM = r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?"


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _templates() -> list[tuple[str, dict[str, int]]]:
    return [(name, {t: w.count(t) for t in w}) for name, notices in TEMPLATES.items() for n in notices for w in [_terms(n)]]


def score_headers(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, license, cosine`` of every file that speaks of a licence: the nearest template's, or unknown.

    Document frequencies of the templates' terms are counted over all files that speak of a licence;
    other terms weigh as much as the rarest.  Ties go to the name that sorts first.  Null texts and
    texts without telling lines have no row; a path that occurs twice is judged as one file.
    """
    lines = F.filter(F.split(blank(F.col("text")), "\n"), lambda x: x.rlike(TELLING))
    said = plain(files, path=path, text=text).select("path", F.array_join(lines, "\n").alias("said")).filter("said <> ''")
    words = written(said.select("path", F.explode(F.regexp_extract_all(F.lower("said"), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
                    .groupBy("path", "term").agg(F.count(F.lit(1)).alias("tf")))
    templates = _templates()
    known = sorted({t for _, w in templates for t in w})
    total = words.select("path").distinct().count()
    seen = {r["term"]: r["n"] for r in words.filter(F.col("term").isin(known)).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    idf = lambda n: math.log((total + len(templates) + 1) / (n + 1)) + 1
    weight = {t: idf(seen.get(t, 0) + sum(t in w for _, w in templates)) for t in known}
    norms = [math.sqrt(sum((tf * weight[t]) ** 2 for t, tf in w.items())) for _, w in templates]
    spark = files.sparkSession
    rows = [(t, weight[t], [w.get(t, 0) * weight[t] / n for (_, w), n in zip(templates, norms)]) for t in known]
    vectors = F.broadcast(spark.createDataFrame(rows, "term string, idf double, unit array<double>"))  # the templates' terms
    value = F.col("tf") * F.coalesce("idf", F.lit(idf(0)))
    scored = words.join(vectors, "term", "left").groupBy("path").agg(
        F.sqrt(F.sum(value * value)).alias("norm"), F.collect_list(F.struct(value.alias("value"), "unit")).alias("terms"))
    dot = lambda i: F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["value"] * F.coalesce(F.get(t["unit"], i), F.lit(0.0)))
    names = F.array(*[F.lit(name) for name, _ in templates])
    orders = F.array(*[F.lit(-sorted(TEMPLATES).index(name)) for name, _ in templates])
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(templates) - 1)), lambda i: F.struct(
        F.round(dot(i) / F.col("norm"), 9).alias("cosine"), F.get(orders, i).alias("order"), F.get(names, i).alias("license"))))
    return scored.select("path", best.alias("b")).select(
        "path", F.when(F.col("b.cosine") >= THRESHOLD, F.col("b.license")).otherwise(UNKNOWN).alias("license"), "b.cosine")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, license, cosine, origin`` for every file: its own header, or the directory that it inherits from.

    ``origin`` is ``header``, the directory of the licence file, or null where there is neither.
    A header or licence file near no template is ``unknown`` and not overridden from above.  Null paths have no directory.  Directories are looked up once each, not once per file, and of
    several licence files in one directory the nearest to a template counts.
    """
    own = written(score_headers(files, path, text))
    paths = plain(files, path=path)
    named = own.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(FILE_NAMES))
    granted = named.groupBy(_parent(F.col("path")).alias("above")).agg(
        F.max_by("license", F.struct("cosine", "license")).alias("above_license"), F.max("cosine").alias("above_cosine"))
    folders = paths.filter("path IS NOT NULL").select(_parent(F.col("path")).alias("folder")).distinct()
    parts = F.split("folder", "/")
    up = folders.select("folder", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))).alias("u"))
    nearest = up.select("folder", "u.*").join(granted, "above").groupBy("folder").agg(
        F.max_by(F.struct("above_license", "above_cosine", "above"), "depth").alias("n"))
    return (
        paths.withColumn("folder", _parent(F.col("path"))).join(own, "path", "left").join(nearest, "folder", "left")
        .select(
            "path", F.coalesce("license", "n.above_license").alias("license"), F.coalesce("cosine", "n.above_cosine").alias("cosine"),
            F.when(F.col("license").isNotNull(), "header").otherwise(F.col("n.above")).alias("origin")))
