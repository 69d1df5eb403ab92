"""Operator 2: licence scan of files, by sparse TF-IDF cosine to templates and inheritance along paths.

A header is a sentence or line anywhere in a text; a licence file is a whole text. Sentences may be wrapped: a line's end alone
does not end them, a line without words does, whatever marks of a comment it has. All become TF-IDF vectors of their
words (letters and digits, without case) and are compared with ``TEMPLATES``, statements, titles and openings of licences; whole
texts also with ``BODIES``, whole short licences. Document frequencies of the template words are counted over all texts; a word that
no template has counts as one that no text has. A text that is nearly a body (``BODY_THRESHOLD``) has that licence. Else a
file's own licence is the nearest template to any of its lines, sentences or the whole, if its cosine reaches ``THRESHOLD``.

A file without its own licence takes that of the nearest directory, from its own upwards, that holds a licence file (a name
that begins with LICENSE, LICENCE or COPYING) with one. Directories are joined to their ancestors by equal paths, each
directory once, so that a directory with any share of the files is a single row there; files then join their directory.

Nothing but counts of template words reaches the driver. The cosine of a unit with a template is at most the root of the template's
squares at the unit's words; units whose words cannot reach the threshold with any template by that bound are not compared.

Defined results: null and empty texts have no licence of their own, but may inherit. Null paths are files of no directory: they
never inherit. Repeated rows give repeated results. Of several licence files in a directory the highest score
counts, then the smallest path. Of equally near templates the first counts, and of equally near places a line, then the
earliest. Texts of any length are scanned whole, the longest alone. An empty table gives no rows. Other columns are kept
out, but for an id that the caller names to be carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.words import Words, words_of

THRESHOLD = 0.7
BODY_THRESHOLD = 0.9

#: How licences are named and how they begin.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *((name, f"This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{mark} either version {number} of the License, or (at your option) any later version.")
      for name, thing, kind, mark, number in [
          ("GPL-2.0", "program", "", ";", "2"), ("GPL-3.0", "program", "", ":", "3"), ("LGPL-2.1", "library", "Lesser ", ";", "2.1"),
          ("LGPL-3.0", "library", "Lesser ", ":", "3"), ("AGPL-3.0", "program", "Affero ", ":", "3")]),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
_NO_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution."""
#: Short licences as a whole.
BODIES = [
    ("MIT", TEMPLATES[20][1] + """ The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"{_CLAUSES} {_NO_WARRANTY}"),
    ("BSD-3-Clause", f"""{_CLAUSES} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. {_NO_WARRANTY}"""),
]

_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LICENCE_FILE = r"^(?i:LICEN[SC]E|COPYING)"
FOUND = "path string, own_license string, own_score double, own_start bigint, own_end bigint"


def _hashes(text: str) -> np.ndarray:
    return next(iter(words_of(pa.array([text]), separators=_SEPARATORS))).hashes() if text else np.empty(0, dtype=np.uint64)


@dataclass
class Model:
    """Template vectors over the template words (columns, by hash), unit length; idf of each word and of any other."""

    names: list[str]
    words: np.ndarray
    idf: np.ndarray
    other: float
    vectors: np.ndarray
    threshold: float
    bodies: list[str]
    body_vectors: np.ndarray


def vocabulary(templates=TEMPLATES + BODIES) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(t) for _, t in templates]))


def model_of(frequencies: dict[int, int], documents: int, templates=TEMPLATES, threshold: float = THRESHOLD, bodies=BODIES) -> Model:
    words = vocabulary([*templates, *bodies])
    idf = np.log((1 + documents) / (1 + np.array([frequencies.get(int(w), 0) for w in words.view(np.int64)]))) + 1
    counts = np.zeros((len(templates) + len(bodies), len(words)))
    for row, (_, text) in enumerate([*templates, *bodies]):
        np.add.at(counts[row], np.searchsorted(words, _hashes(text)), 1)
    vectors = counts * idf
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return Model([n for n, _ in templates], words, idf, float(np.log(1 + documents) + 1), vectors[: len(templates)], threshold,
                 [n for n, _ in bodies], vectors[len(templates):])


def _frequencies(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(words), dtype=np.int64)
        texts = 0
        for batch in batches:
            texts += batch.num_rows
            for chunk in words_of(batch.column(0), separators=_SEPARATORS):
                column, known = _columns(chunk.hashes(), words)
                pairs = np.unique(chunk.text[known] * np.int64(len(words)) + column[known])
                counts += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.record_batch([pa.array(np.r_[words.view(np.int64), 0]), pa.array(np.r_[counts, texts]),
                               pa.array(np.r_[np.zeros(len(words), bool), True])], names=["word", "n", "whole"])
    return run


def _columns(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def fit(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, bodies=BODIES) -> Model:
    """Counts, over all texts, how many have each template word; the result has a row per word."""
    rows = files.select(F.col("text").cast("string")).mapInArrow(
        _frequencies(vocabulary([*templates, *bodies])), "word bigint, n bigint, whole boolean").groupBy("word", "whole").agg(F.sum("n").alias("n")).collect()
    documents = next((r["n"] for r in rows if r["whole"]), 0)
    return model_of({r["word"]: r["n"] for r in rows if not r["whole"]}, documents, templates, threshold, bodies)


def _sentences(chunk: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word's sentence within the chunk, and bounds of sentences as bytes of the chunk.

    A sentence ends at a line's end, at the text's end, and after ``.``, ``!`` or ``?`` before white space.
    """
    data = chunk.data
    stop = np.zeros(len(data) + 1, dtype=bool)
    stop[1:] = data == 0x0A
    mark = (data[:-1] == 0x2E) | (data[:-1] == 0x21) | (data[:-1] == 0x3F)
    stop[1:-1] |= mark & np.isin(data[1:], [0x20, 0x09, 0x0A, 0x0D])
    stop[chunk.offsets] = True
    bounds = np.flatnonzero(stop)
    return np.searchsorted(bounds, chunk.starts, "right") - 1, bounds[:-1], bounds[1:]


def _wrapped(chunk: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word's sentence, and text, first byte and last byte of each: line ends alone do not end a sentence."""
    data, starts, ends = chunk.data, chunk.starts, chunk.ends
    lines = np.r_[0, np.cumsum(data == 0x0A)]
    mark = np.zeros(len(data) + 1, dtype=np.int64)
    mark[1:-1] = ((data[:-1] == 0x2E) | (data[:-1] == 0x21) | (data[:-1] == 0x3F)) & np.isin(data[1:], [0x20, 0x09, 0x0A, 0x0D])
    marks = np.cumsum(mark)
    begins = np.r_[True, (chunk.text[1:] != chunk.text[:-1]) | (lines[starts[1:]] - lines[ends[:-1]] > 1) | (marks[starts[1:]] > marks[ends[:-1]])]
    first = np.flatnonzero(begins)
    return np.cumsum(begins) - 1, chunk.text[first], starts[first], ends[np.r_[first[1:] - 1, len(starts) - 1]]


def _best(model: Model, unit: np.ndarray, hashes: np.ndarray, templates: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the units (sentences or texts) that can reach the threshold: number, nearest of the templates, cosine."""
    column, known = _columns(hashes, model.words)
    reach = np.bincount(unit[known], weights=(templates**2).max(axis=0, initial=0.0)[column[known]])
    some = np.flatnonzero(reach >= threshold**2 - 1e-9)
    if not len(some):
        return some, some, np.empty(0)
    row = np.minimum(np.searchsorted(some, unit), len(some) - 1)
    mine = some[row] == unit
    counts = np.zeros((len(some), len(model.words)))
    np.add.at(counts, (row[mine & known], column[mine & known]), 1)
    # words outside the templates: each different one has a length of its own
    outside = mine & ~known
    different, times = np.unique(np.stack([row[outside].astype(np.uint64), hashes[outside]]), axis=1, return_counts=True)
    extra = np.bincount(different[0].astype(np.int64), weights=(times * model.other) ** 2, minlength=len(some))
    weighted = counts * model.idf
    cosine = weighted @ templates.T / np.sqrt(np.maximum((weighted**2).sum(axis=1) + extra, 1e-300))[:, None]
    nearest = cosine.argmax(axis=1)
    return some, nearest, cosine[np.arange(len(some)), nearest]


def _scanner(broadcast, carry: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        names = np.array([*model.names, *model.bodies], dtype=object)
        for batch in batches:
            for chunk in words_of(batch.column(1), separators=_SEPARATORS):
                hashes = chunk.hashes()
                n = chunk.n_texts
                score, name = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
                start, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

                def offer(text: np.ndarray, nearest: np.ndarray, cosine: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
                    for t, k, c, i, j in zip(text, nearest, cosine, begins - chunk.offsets[text], ends - chunk.offsets[text]):
                        if c > score[t] + 1e-12:
                            score[t], name[t], start[t], end[t] = c, k, i, j

                if len(hashes):
                    sentence, begins, ends = _sentences(chunk)
                    some, nearest, cosine = _best(model, sentence, hashes, model.vectors, model.threshold)
                    offer(np.searchsorted(chunk.offsets, begins[some], "right") - 1, nearest, cosine, begins[some], ends[some])
                    sentence, text, begins, ends = _wrapped(chunk)
                    some, nearest, cosine = _best(model, sentence, hashes, model.vectors, model.threshold)
                    offer(text[some], nearest, cosine, begins[some], ends[some])
                    some, nearest, cosine = _best(model, chunk.text, hashes, model.vectors, model.threshold)
                    offer(some, nearest, cosine, chunk.offsets[some], chunk.offsets[some + 1])
                    if len(model.bodies):
                        some, nearest, cosine = _best(model, chunk.text, hashes, model.body_vectors, BODY_THRESHOLD)
                        near = cosine >= BODY_THRESHOLD
                        score[some[near]] = -1.0  # a body decides before sentences do
                        offer(some[near], nearest[near] + len(model.names), cosine[near], chunk.offsets[some[near]], chunk.offsets[some[near] + 1])
                own = score >= model.threshold - 1e-12
                columns = [batch.column(0).slice(chunk.first, n), pa.array([names[k] if o else None for k, o in zip(name, own)], pa.string()),
                           pa.array(np.maximum(score, 0.0)), pa.array(start, mask=~own), pa.array(end, mask=~own)]
                labels = ["path", "own_license", "own_score", "own_start", "own_end"]
                if carry:
                    columns, labels = [batch.column(2).slice(chunk.first, n), *columns], [carry, *labels]
                yield pa.record_batch(columns, names=labels)
    return run


def scan(files: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """path, own_license, own_score, own_start, own_end (bytes of the deciding sentence or text) of every file; a score without licence is 0 or below the threshold.

    ``carry`` names a bigint column of the files that comes first in the result. ``inherit`` reads the result several times: settle it.
    """
    shared = files.sparkSession.sparkContext.broadcast(model)  # a few hundred words, whatever the input
    extra = [F.col(carry).cast("bigint").alias(carry)] if carry else []
    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"), *extra).mapInArrow(
        _scanner(shared, carry), (f"{carry} bigint, " if carry else "") + FOUND)


def inherit(scanned: DataFrame, carry: str | None = None) -> DataFrame:
    """Adds license (own, else of the nearest directory upwards with a licence file) and license_path (where it is from)."""
    directory = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    placed = scanned.withColumn("dir", F.when(F.col("path").isNotNull(), directory))
    granted = placed.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(_LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("rank"), "path", "own_license")).alias("grant"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    directories = placed.select("dir").filter("dir is not null").distinct()
    nearest = directories.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above").join(
        granted.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by("grant", "depth").alias("grant"))
    return placed.join(nearest, "dir", "left").select(
        *([carry] if carry else []), "path", "own_license", "own_score", "own_start", "own_end", F.coalesce("own_license", "grant.own_license").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col("grant.path")).alias("license_path"))
