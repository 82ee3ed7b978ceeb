"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Each text is cut into paragraphs (its lines; long ones into windows of MAX_WORDS words, half overlapping). A paragraph
and a template are sparse TF-IDF vectors over lower-cased words; idf counts all paragraphs of the corpus for the words
of the templates (a bounded vocabulary), and words of no template have the largest idf, log(paragraphs + 1) + 1. A
text's license is the template of largest cosine over its paragraphs, if that reaches the threshold. A file without one inherits from the
licence file in the nearest directory at or above its own, found by joining ancestor paths of directories.

Defined cases: a null text has no license; a null path is in no directory and inherits nothing; several licence files
in one directory: the best cosine, then the smallest path; ties between templates: the first in order; repeated rows
repeat; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import settled

# Usual statements of public licenses.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
LICENSE_NAMES = ("LICENSE", "LICENCE", "COPYING", "NOTICE")
THRESHOLD = 0.7
MAX_WORDS = 80
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def paragraphs(text: str | None, most: int = MAX_WORDS) -> Iterator[list[str]]:
    for line in (text or "").lower().split("\n"):
        words = WORD.findall(line)
        for lo in range(0, max(1, len(words) - most // 2), most // 2) if words else ():
            yield words[lo:lo + most]


def template_words(templates: dict[str, list[str]] = TEMPLATES) -> list[str]:
    return sorted({w for texts in templates.values() for t in texts for words in paragraphs(t) for w in words})


def frequencies(docs: DataFrame, text: str = "text", templates: dict = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Number of paragraphs, and for each word of a template the number that contain it."""
    vocab = set(template_words(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, Counter()
        for b in batches:
            for t in b.column(0):
                for words in paragraphs(t.as_py()):
                    n += 1
                    df.update(vocab.intersection(words))
        yield pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([n, *df.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"]: r["n"] for r in rows}  # at most the words of the templates
    return df.pop("", 0), df


class Matcher:
    """Cosine of a paragraph with every template."""

    def __init__(self, n: int, df: dict[str, int], templates: dict = TEMPLATES):
        self.default = float(np.log(n + 1) + 1)
        self.idf = {w: float(np.log((n + 1) / (df.get(w, 0) + 1)) + 1) for w in template_words(templates)}
        self.names, vectors = [], []
        for name in sorted(templates):
            for t in templates[name]:
                for words in paragraphs(t, 10 ** 6):
                    v = {w: c * self.idf[w] for w, c in Counter(words).items()}
                    norm = sum(x * x for x in v.values()) ** 0.5
                    self.names.append(name)
                    vectors.append({w: x / norm for w, x in v.items()})
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(vectors):
            for w, x in v.items():
                self.postings.setdefault(w, []).append((i, x))

    def best(self, words: list[str]) -> tuple[float, str | None]:
        idf = self.idf
        shared = [w for w in words if w in idf]
        if not shared:
            return 0.0, None
        dots, norm = [0.0] * len(self.names), 0.0
        for w, c in Counter(words).items():
            x = c * idf.get(w, self.default)
            norm += x * x
            for i, y in self.postings.get(w, ()):
                dots[i] += x * y
        top = max(range(len(dots)), key=lambda i: (dots[i], -i))
        return dots[top] / norm ** 0.5, self.names[top]


def match(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD, templates: dict = TEMPLATES) -> DataFrame:
    """``(id, path, own, score)`` per row, written once."""
    n, df = frequencies(files, text, templates)
    id_type = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(n, df, templates)
        for b in batches:
            own, score = [], []
            for t in b.column(2):
                best = max((matcher.best(w) for w in paragraphs(t.as_py())), key=lambda x: x[0], default=(0.0, None))
                score.append(round(min(1.0, best[0]), 9))
                own.append(best[1] if best[0] >= threshold else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.string()), pa.array(score, pa.float64())], ["id", "path", "own", "score"])

    return settled(files.select(F.col(key).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {id_type}, path string, own string, score double"))


def directory(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).when(path.isNotNull(), F.lit(""))


def inherit(found: DataFrame, names: tuple = LICENSE_NAMES) -> DataFrame:
    """Add ``license``, ``origin`` (header, file, inherited, none) and ``license_path`` to the output of ``match``.
    Ancestors are joined once per directory, not per file."""
    is_file = F.upper(F.regexp_extract("path", "([^/.]*)[^/]*$", 1)).isin(*names)
    rows = found.withColumn("dir", directory(F.col("path"))).withColumn("is_file", is_file)
    holders = rows.where("is_file AND own IS NOT NULL").select("dir", F.struct((-F.col("score")).alias("s"), "path", "own").alias("x")).groupBy("dir").agg(F.min("x").alias("x"))
    dirs = rows.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i))))
    up = dirs.select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = up.join(holders.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "x")).alias("x"))
    nearest = settled(nearest.select("dir", F.col("x.x.own").alias("inherited"), F.col("x.x.path").alias("license_path")))
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return rows.join(nearest, "dir", "left").select("id", "path", "own", "score", F.coalesce("own", "inherited").alias("license"), origin.alias("origin"),
                                                   F.when(F.col("own").isNull(), F.col("license_path")).alias("license_path"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    return inherit(match(files, key, path, text, threshold))
