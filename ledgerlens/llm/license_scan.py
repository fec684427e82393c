"""Licence of every file: its own notice, else that of the nearest directory above.

Licence files are compared with whole licence texts (:mod:`license_texts`), notices
with notice templates, both by the cosine of sparse TF-IDF vectors whose inverse
document frequencies come from the templates; a word in no template weighs most, so
a text that merely mentions a licence stays below the threshold. Notices are sought
in windows of as many words as the template has, slid over the words of the
text, so one that is wrapped over several (comment) lines or stands inside a longer
line is found. Whole texts win over notices, notices over single lines, and every
licence over a mere "All rights reserved". A file is a licence file by its name or
where its whole text is like a template; it declares its licence for its directory
and all below that have no nearer one.

Text is read once, in the scan; only the texts of the few files that speak of a
licence or are named like one go through the cosine (Arrow batches).
Inheritance is a join on paths: the distinct directories are
expanded to their ancestors and joined with the declaring ones, then files take
their directory's answer, so a directory with a third of all files is one row
until the last join, which adaptive execution splits.

Behaviour on awkward input: null text is empty and has no notice; a null path is a
file in the top directory; repeated rows are judged each; of several
licence files in a directory the most similar one counts, ties by name of the
licence and path; texts are read whole; an empty table gives an empty
result; only the id, path and text columns are read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.license_texts import TEXTS
from ledgerlens.llm.tables import stored, text_or_empty

#: Least cosine for a notice line, and for a whole file that is like a notice.
LINE_FROM, FILE_FROM = 0.6, 0.6
#: Least cosine for a whole file that is like a licence text, and for a window of words.
TEXT_FROM, WINDOW_FROM = 0.85, 0.8
#: Licence texts of up to so many words are also sought inside files.
SHORT_TEXT = 400
NOTICE = r"(?i)licen[cs]e|copyright|spdx-|public domain|all rights reserved|permission is (?:hereby )?granted|redistribution and use"
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:[.\-][^/]*)?$"
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: Comment marks that are words, at the start of a line.
MARK = re.compile(r"(?m)^[ \t]*(?:rem|dnl)\b")
#: Words of which a window must hold one.
TELLING = re.compile(r"licen[cs]e|copyright|spdx-|domain$|rights$|permission$|redistribution$")

# Notices in use and opening words of the licences' published texts.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. CC0 1.0 public domain dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Proprietary", "All rights reserved."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
#: The licence that any other one goes before.
LEAST = "Proprietary"


def words(text: str) -> list[str]:
    return WORD.findall(MARK.sub("", text.lower()))


class Matcher:
    def __init__(self, templates: list[tuple[str, str]]):
        bags = [Counter(words(text)) for _, text in templates]
        n, seen = len(bags), Counter(w for bag in bags for w in bag)
        self.names = [name for name, _ in templates]
        self.sizes = [bag.total() for bag in bags]
        self.idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
        self.other = math.log(1 + n) + 1
        self.holding: dict[str, list[tuple[int, float]]] = {}
        for i, bag in enumerate(bags):
            norm = math.sqrt(sum((tf * self.idf[w]) ** 2 for w, tf in bag.items()))
            for w, tf in bag.items():
                self.holding.setdefault(w, []).append((i, tf * self.idf[w] / norm))

    def cosines(self, found: list[str]) -> dict[int, float]:
        """Cosine of the words with every template that shares one."""
        bag = Counter(found)
        norm = math.sqrt(sum((tf * self.idf.get(w, self.other)) ** 2 for w, tf in bag.items()))
        dots: dict[int, float] = {}
        for w, tf in bag.items():
            for i, weight in self.holding.get(w, ()):
                dots[i] = dots.get(i, 0.0) + tf * self.idf[w] * weight
        return {i: round(dot / norm, 9) for i, dot in dots.items()}

    def best(self, found: list[str]) -> tuple[float, str | None]:
        """(cosine, licence) of the most similar template; ties by the licence's name."""
        cosine, name = min(((-c, self.names[i]) for i, c in self.cosines(found).items()), default=(0.0, None))
        return -cosine, name

    def windows(self, found: list[str], least: float) -> list[tuple[float, str]]:
        """(cosine, licence) of each template that some window of its size is like by ``least`` or more."""
        idf = np.array([self.idf.get(w, self.other) for w in found])
        squares = np.concatenate([[0.0], np.cumsum(idf ** 2)])
        telling = np.concatenate([[0], np.cumsum([TELLING.match(w) is not None for w in found])])
        at: dict[int, list[tuple[int, float]]] = {}
        for k, w in enumerate(found):
            for i, weight in self.holding.get(w, ()):
                at.setdefault(i, []).append((k, idf[k] * weight))
        out = []
        for i, places in at.items():
            size = min(self.sizes[i], len(found))
            weights = np.zeros(len(found))
            weights[[k for k, _ in places]] = [x for _, x in places]
            dots = np.concatenate([[0.0], np.cumsum(weights)])
            dots = dots[size:] - dots[:-size]
            # A window's norm is that of its words as if all differed, or more.
            most = dots / np.sqrt(squares[size:] - squares[:-size])
            most[telling[size:] == telling[:-size]] = 0
            top = 0.0
            for k in np.argsort(-most, kind="stable").tolist():
                if most[k] < max(top, least) - 1e-9:
                    break
                top = max(top, self.cosines(found[k:k + size]).get(i, 0.0))
            if top >= least:
                out.append((top, self.names[i]))
        return out


@functools.cache
def _matchers() -> tuple[Matcher, Matcher, Matcher]:
    """Of notices, of whole texts, and of those of them that are sought inside files."""
    return (Matcher(TEMPLATES), Matcher(TEXTS),
            Matcher([(name, text) for name, text in TEXTS if len(words(text)) <= SHORT_TEXT]))


def find(text: str) -> tuple[str | None, float | None, bool]:
    """(licence, cosine, whether the whole text is like a template) of a file's text."""
    notices, texts, short = _matchers()
    all_words = words(text)
    if not all_words:
        return None, None, False
    score, name = texts.best(all_words)
    if score >= TEXT_FROM:
        return name, score, True
    if len(all_words) <= 2 * max(notices.sizes):
        score, name = notices.best(all_words)
        if score >= FILE_FROM:
            return name, score, True
    lines = [notices.best(words(line)) for line in text.split("\n") if re.search(NOTICE, line)]
    steps = (lambda: short.windows(all_words, TEXT_FROM), lambda: notices.windows(all_words, WINDOW_FROM),
             lambda: [x for x in lines if x[0] >= LINE_FROM])
    last: list[tuple[float, str]] = []
    for step in steps:
        found = step()
        if named := [x for x in found if x[1] != LEAST]:
            score, name = min(named, key=lambda x: (-x[0], x[1]))
            return name, score, False
        last += found
    score, name = max(last, default=(None, None))
    return name, score, False


_FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("whole", T.BooleanType())])


@F.pandas_udf(_FOUND)
def _find(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find(t) if t else (None, None, False) for t in texts], columns=["license", "score", "whole"])


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``doc_id, path, dir, license, score, declares``: what each file says itself."""
    path = F.coalesce(files[f"`{path_col}`"], F.lit(""))
    rows = files.select(files[f"`{id_col}`"].alias("doc_id"), path.alias("path"), text_or_empty(files[f"`{text_col}`"]).alias("text"))
    rows = rows.select("doc_id", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.rlike("path", F.lit(FILE_NAME)).alias("named"), "text")
    told = F.rlike("text", F.lit(NOTICE)) | F.col("named")
    own = F.col("own")
    return rows.withColumn("own", _find(F.when(told, F.col("text")))).select(
        "doc_id", "path", "dir", own["license"].alias("license"), own["score"].alias("score"),
        (own["license"].isNotNull() & (F.col("named") | own["whole"])).alias("declares"))


def licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``doc_id, path, license, score, via, from_path``: ``via`` is "own", "inherited" or null."""
    found = stored(scan(files, id_col, path_col, text_col), "licenses")
    declared = found.where("declares").groupBy(F.col("dir").alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("low"), "license", "path")).alias("best"))
    parts = F.split("dir", "/")
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    above = found.select("dir").distinct().select("dir", F.explode(depths).alias("depth")).withColumn(
        "above", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = (above.hint("merge").join(declared, "above").groupBy("dir")
               .agg(F.max(F.struct("depth", "best")).alias("at")).select("dir", F.col("at.best").alias("best")))
    own = F.col("license").isNotNull()
    return found.hint("merge").join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("license", "best.license").alias("license"),
        F.coalesce("score", -F.col("best.low")).alias("score"),
        F.when(own, "own").when(F.col("best").isNotNull(), "inherited").alias("via"),
        F.when(own, F.col("path")).otherwise(F.col("best.path")).alias("from_path"))
