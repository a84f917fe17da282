"""Licence scan: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

Every line and paragraph of a file, and every run of as many terms as a template has, wherever it
stands in the text, is compared with licence templates. Weights are term frequency times the inverse document
frequency that the template words have over all files; a word outside the templates weighs as
much as the rarest, so it only lowers a similarity. A file without a notice of its own takes the
licence of the nearest directory above it that has a licence file. Directories are joined by
path: a directory sends each of its ancestors once, however many files it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainweft.llm.text import sliced
from chainweft.session import materialise

#: Notices as they stand in headers and at the head of licence files.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", "you may not use this file except in compliance with the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License Version 3, 19 November 2007"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
THRESHOLD = 0.75
#: Terms of a text that are held as numbers at once; parts overlap by the longest template.
PART = 1 << 15
#: A file of this name is its directory's licence file.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$"

_TERM = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
_VOCABULARY = frozenset(t for texts in TEMPLATES.values() for text in texts for t in _TERM.findall(text.lower()))


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of a partition, and in how many of them each template word is."""
    files, seen = 0, Counter()
    for batch in sliced(batches):
        files += batch.num_rows
        for text in batch.column("text").to_pylist():
            pieces = set((text or "").lower().split())
            seen.update({t for p in pieces for t in _TERM.findall(p)} & _VOCABULARY)
    yield pa.RecordBatch.from_arrays([pa.array(["", *seen], pa.string()), pa.array([files, *seen.values()], pa.int64())], ["term", "n"])


class Matcher:
    """Cosines of text pieces to the templates under given document frequencies."""

    def __init__(self, files: int, df: dict[str, int], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.idf = {t: math.log((files + 1) / (df.get(t, 0) + 1)) + 1 for t in _VOCABULARY}
        self.top = math.log(files + 1) + 1
        self.templates, self.sizes = [], []
        for name, texts in TEMPLATES.items():
            for text in texts:
                own = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
                self.templates.append((name, own, math.sqrt(sum(v * v for v in own.values()))))
                self.sizes.append(len(terms(text)))
        # number 0 is any term outside the templates
        self.number = {t: k + 1 for k, t in enumerate(sorted(_VOCABULARY))}
        self.squares = np.array([self.top, *(self.idf[t] for t in self.number)]) ** 2
        self.shares = np.array([[0.0, *(self.idf[t] * own.get(t, 0.0) / length for t in self.number)] for _, own, length in self.templates])

    def best(self, found: list[str]) -> tuple[float, str]:
        """The highest cosine of some terms to a template."""
        counts = Counter(found)
        inside = {t: n * self.idf[t] for t, n in counts.items() if t in self.idf}
        outside = sum((n * self.top) ** 2 for t, n in counts.items() if t not in self.idf)
        norm = math.sqrt(sum(v * v for v in inside.values()) + outside)
        if len(inside) < 2:
            return 0.0, ""
        return max(((sum(v * own.get(t, 0.0) for t, v in inside.items()) / norm / length, name) for name, own, length in self.templates), key=lambda x: (x[0], x[1]))

    def runs(self, found: list[str], least: float) -> Iterator[tuple[int, int]]:
        """Start and end of the runs of a template's length whose cosine to it may exceed ``least``.

        A run's product with a template is a difference of running sums; a run with repeated terms
        is longer than the sum of its squares says, so the quotient is never too small.
        """
        longest = max(self.sizes)
        numbers = np.fromiter((self.number.get(t, 0) for t in found), np.int64, len(found))
        for at in range(0, len(numbers), PART):
            own = numbers[at : at + PART + longest]
            squares = np.concatenate([[0.0], np.cumsum(self.squares[own])])
            used = np.flatnonzero(own)
            if len(used) < 2:
                continue
            products = np.concatenate([np.zeros((len(self.sizes), 1)), np.cumsum(self.shares[:, own], axis=1)], axis=1)
            for k, n in enumerate(self.sizes):
                if n <= len(own):
                    high = products[k, n:] - products[k, :-n]
                    for start in np.flatnonzero(high > (least - 1e-6) * np.sqrt(squares[n:] - squares[:-n])).tolist():
                        yield at + start, at + start + n

    def notice(self, text: str | None) -> tuple[float, str, str]:
        """Similarity, licence and piece of the most similar line, paragraph or run of terms of a whole text."""
        text, best = text or "", (0.0, "", "")
        for paragraph in re.split(r"(?:\r?\n){2,}", text):
            lines = [x for x in re.split(r"[\r\n]+", paragraph) if x]
            for piece in lines if len(lines) == 1 else [*lines, paragraph]:
                # half of a line's words outside the templates keep it below the threshold
                words = piece.lower().split()
                if 2 * sum(w.strip(".,;:()") in _VOCABULARY for w in words) >= len(words):
                    score, name = self.best(terms(piece))
                    best = max(best, (score, name, piece[:500]))
        low = text.lower()
        spans = [(m.start(), m.end()) for m in _TERM.finditer(low)]
        found = [low[a:b] for a, b in spans]
        for start, end in self.runs(found, max(best[0], self.threshold)):
            score, name = self.best(found[start:end])
            if score > best[0] + 1e-9:  # a line or paragraph of the same terms stays
                a, b = spans[start][0], spans[end - 1][1]
                best = (score, name, (text if len(text) == len(low) else low)[a:b][:500])
        return best


def notices(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (``path``, ``text``, more) with ``__own__`` (licence, similarity, notice), null below ``threshold``."""
    counts = files.select("text").mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = dict(tuple(r) for r in counts.collect())  # a row for each template word
    matcher = Matcher(df.pop("", 0), df, threshold)

    @F.pandas_udf("licence string, similarity double, notice string")
    def match(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [matcher.notice(t) for t in texts]
        return pd.DataFrame([(n, s, p) if s >= threshold else (None, None, None) for s, n, p in found], columns=["licence", "similarity", "notice"])

    return files.withColumn("__own__", match("text"))


def _folder(path: Column) -> Column:
    """The directory of a path without its last part; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(own: DataFrame) -> DataFrame:
    """``doc_id``, ``path``, ``licence``, ``origin``, ``folder``, ``similarity``, ``notice`` from rows with ``path`` and ``__own__``.

    ``origin`` is ``own`` (a notice in the file), ``inherited`` (of the nearest directory above,
    its own first, with a licence file) or ``none``. A directory with several licence files takes
    the most similar, ties by name and path. A null path has no directory and inherits nothing.
    """
    own = own.withColumn("folder", _folder(F.col("path")))
    is_licence = F.regexp_extract(F.col("path"), r"([^/]*)$", 1).rlike(LICENCE_FILE)
    given = (
        own.where(is_licence & F.col("__own__.licence").isNotNull()).groupBy(F.col("folder").alias("above"))
        .agg(F.max_by("__own__.licence", F.struct("__own__.similarity", "__own__.licence", "path")).alias("given"))
    )
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    folders = own.where("folder IS NOT NULL").select("folder").distinct()
    reach = folders.select("folder", F.explode(above).alias("up")).select("folder", "up.depth", "up.above").join(given, "above")
    nearest = reach.groupBy("folder").agg(F.max_by(F.struct("above", "given"), "depth").alias("near"))
    mine = F.col("__own__.licence").isNotNull()
    return own.join(nearest, "folder", "left").select(
        "doc_id", "path", F.coalesce("__own__.licence", "near.given").alias("licence"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~mine, F.col("near.above")).alias("from_folder"), F.col("__own__.similarity").alias("similarity"), F.col("__own__.notice").alias("notice"),
    )


def scanned(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Licences (see :func:`inherited`) of ``files`` with ``doc_id``, ``path`` and ``text``, in whole texts.

    A null or empty text has no notice. Repeated rows are answered alike. A piece of text needs two
    template words at least, and half of a line's or paragraph's words from the templates, to be a notice. An empty
    table gives none.
    """
    return inherited(materialise(notices(files.select("doc_id", "path", "text"), threshold).drop("text"), "notices"))


def scanned_documents(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Licences of documents as files of a tree: source / thousand / hundred / file.

    Among the documents of a thousand the one with the least id that has a notice is its licence
    file and stands at its top. Texts are read once and not moved.
    """
    own = materialise(notices(documents.select("doc_id", "source", "text"), threshold).drop("text"), "notices")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.floor(F.col("doc_id") / 1000).cast("string"))
    rows = own.withColumn("top", folder)
    first = rows.where("__own__.licence IS NOT NULL").groupBy("top").agg(F.min("doc_id").alias("first"))
    below = F.concat_ws("/", "top", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("doc_id") == F.col("first"), F.concat("top", F.lit("/LICENSE"))).otherwise(below)
    return inherited(rows.join(first, "top", "left").select("doc_id", path.alias("path"), "__own__"))
