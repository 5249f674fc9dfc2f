"""License scans: sparse TF-IDF cosine of headers and license files to templates, then nearest-ancestor inheritance.

Every line of every text, every paragraph (lines up to an empty one, as a header's comment is), and every whole text, is a
sparse TF-IDF vector; its cosine to each template is a sum over
shared terms. Document frequencies of the templates' terms are counted over all rows first; any other term has the weight
of a term seen once. A row's own license is its best line's (or its whole text's) above the threshold. License files give
their directory a license; a row without one takes that of the nearest directory above it, found by equality joins of
directory paths with their ancestors, a row a directory, not a row a document.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .units import text_blocks, word_codes, words

THRESHOLD = 0.6

# License notices and the headers that their texts prescribe, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words are ASCII letters and digits, dots inside version numbers and every byte of other characters.
BREAK = np.ones(256, bool)
BREAK[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False


class Templates:
    """Term codes of the templates and, once frequencies are known, their unit TF-IDF vectors."""

    def __init__(self, templates: Mapping[str, str | tuple[str, ...]]) -> None:
        pairs = [(k, x) for k in sorted(templates) for x in ([templates[k]] if isinstance(templates[k], str) else templates[k])]
        self.names = [k for k, _ in pairs]
        self.terms = []
        for _, _, data, offsets in text_blocks(pa.array([x for _, x in pairs], pa.string())):
            codes, at = terms(data, offsets)
            self.terms += [codes[at[k] : at[k + 1]] for k in range(len(at) - 1)]
        self.vocabulary = np.unique(np.concatenate(self.terms)) if self.terms else np.zeros(0, np.uint64)

    def weigh(self, documents: int, frequency: np.ndarray) -> None:
        self.other = np.log(1 + documents) + 1
        self.idf = np.log((1 + documents) / (1 + frequency)) + 1
        self.matrix = np.zeros((len(self.vocabulary), len(self.names)))
        for k, t in enumerate(self.terms):
            at, n = np.unique(np.searchsorted(self.vocabulary, t), return_counts=True)
            self.matrix[at, k] = n * self.idf[at]
        self.matrix /= np.maximum(1e-12, np.sqrt((self.matrix**2).sum(0)))

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(codes), -1)
        k = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == codes, k, -1)

    def cosines(self, codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """(n, templates) cosines of the vectors whose terms are ``codes`` with owner ``of``."""
        order = np.lexsort((codes, of))
        c, o = codes[order], of[order]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        count, c, o = np.diff(np.append(at, len(c))), c[at], o[at]
        term = self.lookup(c)
        weight = count * np.where(term >= 0, self.idf[term] if len(self.idf) else 0, self.other)
        norm = np.sqrt(np.bincount(o, weight**2, minlength=n))
        dot = np.zeros((n, len(self.names)))
        known = term >= 0
        np.add.at(dot, o[known], weight[known, None] * self.matrix[term[known]])
        return dot / np.maximum(norm, 1e-12)[:, None]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, at = words(data, offsets, BREAK)
    return word_codes(data, starts, ends), at


def is_license_file(text: Column) -> Column:
    """True for a text that is a license and not one that only carries a notice; never null.

    Either its title, the first line that is neither blank nor a copyright line, has at most 12 words with a license word
    among them or begins as the untitled licenses do; or lines with a license word hold at least half of all words. The
    number of lines does not matter.
    """
    lines = F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\r\n]+"), F.trim), lambda x: x.rlike(r"\w"))
    size = lambda x: F.size(F.split(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+"))
    count = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + size(x))
    notice = lambda x: x.rlike(r"\blicen[cs]e")
    title = F.get(F.filter(lines, lambda x: ~x.rlike(r"^\W*(copyright|\(c\)|©|all rights reserved)")), F.lit(0))
    titled = (notice(title) & (size(title) <= 12)) | title.rlike(r"^\W*(permission is hereby granted|permission to use, copy|redistribution and use in source)")
    covered = F.exists(lines, notice) & (2 * count(F.filter(lines, notice)) >= count(lines))
    return F.coalesce(F.when(F.lower(text).rlike("licen[cs]e|permission|redistribution"), F.coalesce(titled, F.lit(False)) | covered), F.lit(False))


def frequencies(rows: DataFrame, t: Templates) -> tuple[int, np.ndarray]:
    """(rows, how many rows hold each template term), over all rows."""
    n = len(t.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(n, np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for _, _, data, offsets in text_blocks(batch.column(0)):
                codes, at = terms(data, offsets)
                k = t.lookup(codes)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[k >= 0]
                total += np.bincount(np.unique(doc * n + k[k >= 0]) % max(1, n), minlength=n) if n else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.concatenate([[seen], total]))], names=["term", "n"])

    out, rows_seen = np.zeros(n, np.int64), 0
    for r in rows.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a template term
        if r.term < 0:
            rows_seen = r.n
        else:
            out[r.term] = r.n
    return rows_seen, out


def scan(spark: SparkSession, files: DataFrame, templates: Mapping[str, str | tuple[str, ...]] | None = None, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """files: path, text and is_license_file. Returns path, the ``carry`` columns, own_license, similarity, line (number of
    the best line, or of the first word of the best paragraph, from 0, -1 for the whole text, null without a license), license, license_from (the row itself: '.', or
    the directory) of every row.

    Ties go to lines before paragraphs before whole texts, the earlier line and the identifier that sorts first. A directory with several license files has that of
    the greatest similarity, then the least path. Null and empty texts have no license of their own; a null path is ''.
    Repeated rows give equal rows; extra columns are ignored.
    """
    t = Templates(templates if templates is not None else TEMPLATES)
    rows = files.select(F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("is_license_file").cast("boolean"), F.lit(False)).alias("is_license_file"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    t.weigh(*frequencies(rows, t))
    extra = ", ".join(f"carry_{c} {files.schema[c].dataType.simpleString()}" for c in carry)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, similarity, line = [], [], []
            for i, j, data, offsets in text_blocks(batch.column(0), 1 << 20):
                codes, at = terms(data, offsets)
                starts = words(LOWER[data], offsets, BREAK)[0]
                known = t.lookup(codes) >= 0
                ends = np.flatnonzero(data == 10) + 1
                begins = [np.unique(np.concatenate([offsets[:-1], e])) for e in (ends, ends[:-1][np.diff(ends) == 1] + 1)]
                lines = begins[0][begins[0] < max(1, len(data))]
                first = np.searchsorted(lines, offsets[:-1], "left")  # each text's first line
                found = [None] * (j - i)  # (cosine, template, line)
                for begin in begins:  # lines, then paragraphs; only those with a template term can come near a template
                    begin = begin[begin < max(1, len(data))]
                    of = np.searchsorted(begin, starts, "right") - 1
                    some = np.bincount(of[known], minlength=len(begin)) > 0
                    use = some[of]
                    c = t.cosines(codes[use], (np.cumsum(some) - 1)[of[use]], int(some.sum()))
                    part = np.flatnonzero(some)
                    best = c.max(1) if c.size else np.zeros(len(part))
                    owner = np.searchsorted(offsets, begin[part], "right") - 1
                    number = np.searchsorted(lines, starts[np.searchsorted(of, part)], "right") - 1 - first[owner]  # of its first word
                    for k in np.flatnonzero(best >= threshold).tolist():
                        d = int(owner[k])
                        if found[d] is None or best[k] > found[d][0] + 1e-12:
                            found[d] = (float(best[k]), int(c[k].argmax()), int(number[k]))
                whole = t.cosines(codes, np.repeat(np.arange(j - i), np.diff(at)), j - i)
                for d in range(j - i):
                    if whole.size and whole[d].max() >= threshold and whole[d].max() > (found[d][0] if found[d] else 0) + 1e-12:
                        found[d] = (float(whole[d].max()), int(whole[d].argmax()), -1)
                own += [f and t.names[f[1]] for f in found]
                similarity += [f and f[0] for f in found]
                line += [f and f[2] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own, pa.string()), pa.array(similarity, pa.float64()), pa.array(line, pa.int32())], names=[*batch.schema.names[1:], "own_license", "similarity", "line"])

    schema = f"path string, is_license_file boolean, {extra + ', ' if extra else ''}own_license string, similarity double, line int"
    own = rows.select("text", "path", "is_license_file", *[f"carry_{c}" for c in carry]).mapInArrow(emit, schema)
    own = own.withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    scratch = Scratch(spark, "licenses")
    own = scratch.put(own, "own")
    # What joins large directories and the ancestors of many is written first, so the joins can split a hot directory.
    given = own.where("is_license_file AND own_license IS NOT NULL").groupBy("directory").agg(F.min_by(F.struct("own_license"), F.struct((-F.col("similarity")).alias("s"), "path")).getField("own_license").alias("d_license"))
    given = scratch.put(given, "given")
    folders = own.select("directory").distinct()
    parts = F.split("directory", "/")
    above = folders.select("directory", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select("directory", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("ancestor"))
    nearest = above.join(given.select(F.col("directory").alias("ancestor"), "d_license"), "ancestor").groupBy("directory").agg(F.max_by(F.struct("d_license", "ancestor"), "depth").alias("near"))
    out = own.join(scratch.put(nearest, "nearest"), "directory", "left")
    return out.select("path", *[F.col(f"carry_{c}").alias(c) for c in carry], "own_license", "similarity", "line", F.coalesce("own_license", "near.d_license").alias("license"), F.when(F.col("own_license").isNotNull(), F.lit(".")).otherwise(F.col("near.ancestor")).alias("license_from"))
