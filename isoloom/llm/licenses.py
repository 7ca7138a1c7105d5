"""Operator 2: licence scan.

A file's segments (its lines, its paragraphs of several lines, and the whole of it) are compared with licence templates
by the cosine of sparse TF-IDF vectors: notices, and the full texts of ``license_texts`` for segments that have at least
half the words of the text. Document frequencies come from all files, for the words of the templates; a word that no
template has weighs as much as the rarest. A file whose best segment reaches LEAST carries that licence. A file that
reaches LEAST as a whole (its licence is then that of the whole), or has half of its words in its licence segment, is a
licence file: it rules its directory and all below, up to the next licence file. A file without a licence of its own takes that of the nearest ancestor directory, found by
joining the distinct directories' ancestor paths with the licence files' directories.

Cases: null or empty text has no licence of its own; equal scores go to the template that comes first by name; several
licence files in a directory: the highest score, then the least path; a null path has no directory and inherits
nothing; equal rows stay; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoloom.llm.common import slices, small_batches, text_buffer, written
from isoloom.llm.words import LOWER, PUNCT, hashes, mix, scan, separators

LEAST = 0.7
#: From this share of its words in the licence segment a file is a licence file.
FILE_SHARE = 0.5
WORD = separators(PUNCT)
_BREAK = separators(b"\n")
#: Notices by which common licences are declared.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "ISC": ["SPDX-License-Identifier: ISC"],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved."],
}


def full_texts() -> dict[str, list[str]]:
    """The licences' whole texts, by name."""
    return {f.name.removesuffix(".txt"): [f.read_text("utf-8")] for f in resources.files("isoloom.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")}


def _hash(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    data = LOWER[data]
    starts, ends, first = scan(data, offsets, WORD)
    return hashes(data, starts, ends), first


class Templates:
    """TF-IDF vectors of the templates over their own vocabulary."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        pairs = [(name, text) for name in sorted(templates) for text in templates[name]]
        self.names = [name for name, _ in pairs]
        h, first = _hash([text for _, text in pairs])
        self.vocabulary, at = np.unique(h, return_inverse=True)
        self.half = np.diff(first) / 2
        self.tf = np.zeros((len(pairs), len(self.vocabulary)), np.float64)
        np.add.at(self.tf, (np.repeat(np.arange(len(pairs)), np.diff(first)), at.reshape(-1)), 1)

    def weigh(self, found: np.ndarray, n: int) -> None:
        self.idf = np.log((1 + n) / (1 + found)) + 1
        self.other = float(np.log(1 + n) + 1)
        self.vectors = self.tf * self.idf
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.columns = np.concatenate([np.zeros((1, len(self.vectors))), self.vectors.T])

    def number(self, h: np.ndarray) -> np.ndarray:
        """1 + the place in the vocabulary, 0 for other words."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def _number(data: np.ndarray, offsets: np.ndarray, t: Templates):
    data = LOWER[data]
    starts, ends, first = scan(data, offsets, WORD)
    return starts, first, t.number(hashes(data, starts, ends))


def document_frequencies(files: DataFrame, t: Templates) -> tuple[np.ndarray, int]:
    """Of the templates' words, over all files; the vocabulary bounds what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(t.vocabulary) + 1, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                _, first, number = _number(*text_buffer(batch.column(0).slice(a, b - a)), t)
                of = np.repeat(np.arange(b - a), np.diff(first))
                pairs = np.unique(of[number > 0] * (len(total) + 1) + number[number > 0])
                total += np.bincount(pairs % (len(total) + 1), minlength=len(total))[: len(total)]
                n += b - a
        total[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "n"])

    rows = files.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(t.vocabulary) + 1, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out[1:], int(out[0])


def _segments(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Segment numbers of the words: by line, and by paragraph (a blank line parts them)."""
    begin, end, first = scan(data, offsets, _BREAK)
    line = np.searchsorted(begin, starts, "right") - 1
    apart = np.ones(len(begin), bool)
    if len(begin) > 1:
        apart[1:] = begin[1:] > end[:-1] + 1
    apart[first[:-1][first[:-1] < len(begin)]] = True
    paragraph = np.cumsum(apart) - 1
    return [(line, len(begin)), (paragraph[line] if len(line) else line, int(apart.sum()))]


#: (segment, word) pairs that are multiplied together.
PAIRS = 50_000


def _cosines(of: np.ndarray, n: int, number: np.ndarray, h: np.ndarray, t: Templates, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments that can match, their best cosine and its template (the first of equals), by sorted (segment, word)
    pairs and one sparse product.

    A segment can match if it has a word of the templates; with ``whole`` also only if it has half a template's words.
    Words that no template has count by what they are, each with the weight of a word that no file has.
    """
    inside = np.bincount(of, number > 0, n) > 0
    size = np.bincount(of, minlength=n)
    if whole:
        inside &= size >= t.half.min()
    live = np.flatnonzero(inside)
    if not len(live):
        return live, np.zeros(0), live
    use = inside[of]
    seg, word, h = of[use], number[use], h[use]
    rest = word == 0
    # (segment, word) of other words as one number
    other, at, count = np.unique(mix(h[rest].astype(np.uint64) + seg[rest].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    square = np.bincount(seg[rest][at], (count * t.other) ** 2.0, n)[live] if len(other) else np.zeros(len(live))
    width = len(t.vocabulary) + 1
    key, count = np.unique(seg[~rest] * width + word[~rest], return_counts=True)
    of_pair, first = np.unique(key // width, return_index=True)
    weight = count * np.concatenate([[0], t.idf])[key % width]
    square = square + np.add.reduceat(weight**2, first)
    bounds, cosine, pick = np.append(first, len(key)), np.zeros(len(live)), np.zeros(len(live), np.int64)
    at = 0
    while at < len(live):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS, "right")) - 1)
        part = np.s_[bounds[at] : bounds[end]]
        dot = np.add.reduceat(weight[part, None] * t.columns[key[part] % width], bounds[at:end] - bounds[at])
        c = dot / np.sqrt(square[at:end])[:, None]
        if whole:
            c = np.where(size[live[at:end]][:, None] >= t.half, c, 0)
        cosine[at:end], pick[at:end] = c.max(1), c.argmax(1)
        at = end
    return live, cosine, pick


def own(files: DataFrame, t: Templates, full: Templates | None = None) -> DataFrame:
    """path, doc_id, licence, score, is_file: what each file declares itself by notices ``t`` or the texts ``full``."""
    shared = files.sparkSession.sparkContext.broadcast((t, full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(x, whole) for x, whole in zip(shared.value, (False, True), strict=True) if x]
        names = np.array(sorted({n for x, _ in kinds for n in x.names}), object)
        place = [np.searchsorted(names, np.array(x.names, object)) for x, _ in kinds]
        for batch in batches:
            for a, b in slices(batch.column(2)):
                data, offsets = text_buffer(batch.column(2).slice(a, b - a))
                lower = LOWER[data]
                starts, ends, first = scan(lower, offsets, WORD)
                h = hashes(lower, starts, ends)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                best, name, words, ruled = np.zeros(b - a), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), np.zeros(b - a, bool)
                numbers = [x.number(h) for x, _ in kinds]
                for of, n, whole in [(doc, b - a, True), *((of, n, False) for of, n in _segments(data, offsets, starts))]:
                    if not n or not len(of):
                        continue
                    size = np.bincount(of, minlength=n)
                    where = np.zeros(n, np.int64)
                    where[of] = doc
                    for (x, long), number, at in zip(kinds, numbers, place, strict=True):
                        live, cosine, pick = _cosines(of, n, number, h, x, long)
                        for k in np.flatnonzero(cosine >= LEAST):
                            d, score, of_name = where[live[k]], cosine[k], at[pick[k]]
                            better = score > best[d] or (score == best[d] and of_name < name[d])
                            if better and (whole or not ruled[d] or of_name == name[d]):
                                best[d], name[d], words[d] = score, of_name, size[live[k]]
                    if whole:
                        ruled = best > 0
                found = best > 0
                licence = names[name]
                licence[~found] = None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(licence, pa.string()), pa.array(np.round(best, 6)), pa.array(ruled | (found & (words >= FILE_SHARE * np.diff(first))))], ["doc_id", "path", "license", "score", "is_file"])

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text").mapInArrow(run, "doc_id long, path string, license string, score double, is_file boolean")


def inherit(rows: DataFrame) -> DataFrame:
    """doc_id, path, license, score, from_path: a file's own licence, or the nearest ancestor's.

    The top of relative paths is the directory "", that of absolute ones "/".
    """
    path, absolute = F.col("path"), F.col("path").startswith("/")
    top = F.when(absolute, "/").otherwise("")
    below = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    rows = rows.withColumn("directory", F.when(path.isNotNull(), F.when(below == "", top).otherwise(below)))
    ruling = rows.where("is_file AND directory IS NOT NULL").groupBy(F.col("directory").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("f")).select("at", F.col("f.license").alias("up"), F.col("f.path").alias("up_path"))
    parts = F.split("directory", "/")
    inner = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda x: x != "")
    steps = F.array_distinct(F.concat(F.array(F.when(F.col("directory").startswith("/"), "/").otherwise("")), inner))
    distinct = rows.where("directory IS NOT NULL").select("directory").distinct()
    ancestors = distinct.select("directory", F.explode(steps).alias("at"))
    nearest = ancestors.join(ruling, "at").groupBy("directory").agg(F.max_by(F.struct("up", "up_path"), F.length("at")).alias("r"))
    near = nearest.select(F.col("directory").alias("of"), "r.up", "r.up_path")
    out = rows.join(near, rows["directory"] == near["of"], "left")
    return out.select("doc_id", "path", F.coalesce("license", "up").alias("license"), "score", F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("up_path")).alias("from_path"))


def scan_licenses(files: DataFrame) -> DataFrame:
    """One row for each file (doc_id, path, text)."""
    small_batches(files)
    texts = full_texts()
    t, full = Templates(), Templates(texts)
    both = Templates({n: [*TEMPLATES.get(n, []), *texts.get(n, [])] for n in {*TEMPLATES, *texts}})
    found, n = document_frequencies(files, both)
    for x in (t, full):
        x.weigh(found[np.searchsorted(both.vocabulary, x.vocabulary)], n)
    return inherit(written(own(files, t, full)))
