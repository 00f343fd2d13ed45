"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text is compared in pieces: its sentences, its lines, its paragraphs (headers are such, whether a
comment's marks begin their lines or not), windows of ``WINDOWS`` words half over each other, so that a licence
that wraps over lines or stands in a long line is compared whole, and the whole text of a licence file. Of the
templates to which a piece has a cosine of ``THRESHOLD`` or more, a text has the licence of that whose cosine
times its coverage is largest. The coverage is the sum of idf squared over the template's words that stand in the
piece's paragraph, each once: a line that wraps before the version is as near to every version, its paragraph is not.

Words are weighted by tf * idf. Document frequencies are counted over all texts of the corpus, for the
templates' words only, so what the driver reads is bounded by the templates; every other word has the
frequency of an unseen one.

Most pieces are not compared, by a bound: if the words that a piece shares with a template carry less than
THRESHOLD squared of the template's squared length, the cosine is below THRESHOLD. A piece that could pass
thus holds one of the template's heaviest words (its anchors), and pieces without any anchor are passed over.

Files without a licence of their own take that of the nearest directory above them that has a licence
file, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bound_batches, map_rows, materialize

THRESHOLD = 0.5
WINDOWS = (16, 64, 256)
#: Files that speak for their directory.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"

# The texts that stand for each licence.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", _MIT),
    ("ISC", "Licensed under the ISC license"),
    ("ISC", _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", 2.1)),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD + _ENDORSE),
    ("MPL-2.0", _MPL),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", _UNLICENSE),
]
# Identifiers of SPDX tags, each a template of one term.
SPDX = ["MIT", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "Unlicense"]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]

_WORD = re.compile(r"spdx-license-identifier:\s*[\w.+-]+|[a-z0-9]+(?:[.-][a-z0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_MARKS = " \t\r\f\v/*#;%!<>-"


def terms(text: str) -> list[str]:
    """Words; an SPDX tag with its identifier is one, without the suffixes -only and -or-later."""
    lowered = text.lower()
    found = _WORD.findall(lowered)
    if "spdx-license-identifier:" in lowered:
        return [re.sub(r"(-only|-or-later|\+|\.)$", "", re.sub(r":\s*", ":", t)) if t.startswith("spdx-license-identifier:") else t for t in found]
    return found


def pieces(text: str, whole: bool, anchors: frozenset[str]):
    """Term lists of a text's sentences, lines, paragraphs and windows that hold an anchor, each with its paragraph's; with ``whole`` the text itself."""
    if whole:
        yield (flat := terms(text)), flat
    for paragraph in re.split(r"\n[\s/*#;%!<>-]*\n", text):
        lines = [line.strip(_MARKS) for line in paragraph.split("\n")]
        found = [terms(line) for line in lines]
        flat = [t for line in found for t in line]
        if anchors.isdisjoint(flat):
            continue
        parts = [*found, *(terms(s) for s in _SENTENCE.split(" ".join(lines)))]
        if len(flat) <= WINDOWS[-1]:
            parts.append(flat)
        at = [i for i, t in enumerate(flat) if t in anchors]
        for size in WINDOWS:
            step = size // 2
            parts += (flat[k * step : k * step + size] for k in sorted({k for i in at for k in (i // step, i // step - 1) if k >= 0}))
        seen = set()
        for part in parts:
            if not anchors.isdisjoint(part) and (key := tuple(part)) not in seen:
                seen.add(key)
                yield part, flat


class Matcher:
    """The templates' vectors under given document frequencies."""

    def __init__(self, frequencies: dict[str, int], documents: int, templates=None, threshold: float = THRESHOLD) -> None:
        self.templates, self.threshold = templates or TEMPLATES, threshold
        bags = [Counter(terms(text)) for _, text in self.templates]
        n = documents + len(bags)
        own = Counter(t for bag in bags for t in bag)
        self.idf = {t: math.log((1 + n) / (1 + own[t] + frequencies.get(t, 0))) + 1 for t in own}
        self.unseen = math.log(1 + n) + 1
        self.vectors, anchors = [], set()
        self.holders: dict[str, list[tuple[int, float]]] = {}
        for number, bag in enumerate(bags):
            vector = {t: k * self.idf[t] for t, k in bag.items()}
            size = math.sqrt(sum(w * w for w in vector.values()))
            self.vectors.append((vector, size))
            left = size * size
            for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                self.holders.setdefault(t, []).append((number, w / size))
                if left >= (threshold * size) ** 2 * (1 - 1e-9):
                    anchors.add(t)
                left -= w * w
        self.anchors = frozenset(anchors)

    def cosines(self, part: list[str]) -> list[float]:
        """The cosine of one piece to every template."""
        out, squares = [0.0] * len(self.templates), 0.0
        for t, k in Counter(part).items():
            w = k * self.idf.get(t, self.unseen)
            squares += w * w
            for number, share in self.holders.get(t, ()):
                out[number] += w * share
        norm = math.sqrt(squares)
        return [x / norm for x in out] if norm else out

    def coverage(self, paragraph: list[str]) -> list[float]:
        """For each template, the sum of idf squared over its words that the paragraph holds."""
        out = [0.0] * len(self.templates)
        for t in set(paragraph):
            for number, _ in self.holders.get(t, ()):
                out[number] += self.idf[t] ** 2
        return out

    def best(self, text: str, whole: bool = False) -> tuple[str | None, float]:
        """The licence of the largest cosine times coverage, and its cosine; ties: the first template."""
        top, name, similarity, at, covered = 0.0, None, 0.0, None, []
        for part, paragraph in pieces(text, whole, self.anchors):
            cosines = self.cosines(part)
            if max(cosines, default=0.0) < self.threshold:
                continue
            if paragraph is not at:
                at, covered = paragraph, self.coverage(paragraph)
            for number, cosine in enumerate(cosines):
                if cosine >= self.threshold and cosine * covered[number] > top + 1e-12:
                    top, name, similarity = cosine * covered[number], self.templates[number][0], cosine
        return name, similarity


def frequencies(texts: DataFrame, templates=None) -> tuple[dict[str, int], int]:
    """In how many texts each of the templates' words stands, and the number of texts."""
    bound_batches(texts.sparkSession)
    words = frozenset(t for _, text in (templates or TEMPLATES) for t in terms(text))

    def count(batches):
        counter: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counter.update(words.intersection(terms(text or "")))
                counter[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array(counter.values(), pa.int64())], names=["t", "n"])

    found = {r["t"]: r["n"] for r in texts.mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # at most the templates' words
    return found, found.pop("", 0)


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", license_file: Column | None = None, threshold: float = THRESHOLD, templates=None) -> DataFrame:
    """One row per file: ``id_col``, license, similarity, origin ("own", "inherited" or null), from_dir.

    ``license_file``: whether the row's licence speaks for its directory (default: by the file's name). Where
    licence files of one directory differ, the most frequent counts, ties by name. similarity is 0 where none
    reaches the threshold. A null or empty text has no licence of its own; a null path has no directory.
    Repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    flag = license_file if license_file is not None else F.col(path_col).rlike(LICENSE_FILE)
    text = F.col(text_col).cast("string")
    shared = files.sparkSession.sparkContext.broadcast((*frequencies(files.select(text), templates), templates, threshold))
    directory = F.coalesce(F.regexp_extract(F.col(path_col).cast("string"), r"(?s)^(.*)/[^/]*$", 1), F.lit(""))
    rows = files.select(F.col(id_col).alias("id"), directory.alias("dir"), F.coalesce(flag, F.lit(False)).alias("flag"), text.alias("text"))
    key_type = dict(rows.dtypes)["id"]

    def factory():
        matcher = Matcher(*shared.value)

        def one(key, directory, flag, text):
            return (key, directory, flag, *matcher.best(text or "", flag))

        return one

    own = materialize(map_rows(rows, factory, f"id {key_type}, dir string, flag boolean, license string, similarity double"))
    votes = own.where("flag and license is not null and dir <> ''").groupBy("dir", "license").count()
    spoken = votes.groupBy("dir").agg(F.min_by("license", F.struct(-F.col("count"), "license")).alias("dir_license"))
    # Ancestors are taken of directories, of which there are far fewer than files.
    dirs = own.where("license is null and dir <> ''").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")))
    above = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", F.col("u.ancestor").alias("ancestor"))
    nearest = above.join(spoken.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max_by(F.struct("ancestor", "dir_license"), "depth").alias("near"))
    out = own.join(nearest, "dir", "left")
    inherits = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select(
        F.col("id").alias(id_col), F.coalesce("license", "near.dir_license").alias("license"), F.round("similarity", 9).alias("similarity"),
        F.when(inherits, F.lit("inherited")).when(F.col("license").isNotNull(), F.lit("own")).alias("origin"), F.when(inherits, F.col("near.ancestor")).alias("from_dir"),
    )
