"""License scans: TF-IDF cosine to templates, and inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketmill.llm.common import cut, slices

#: How licences are named in notices, and the verbs that notices begin with.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0"], "MIT": ["the MIT License"], "BSD-2-Clause": ["the BSD 2-Clause License"], "BSD-3-Clause": ["the BSD 3-Clause License"],
    "ISC": ["the ISC License"], "MPL-2.0": ["the Mozilla Public License, version 2.0"], "GPL-2.0": ["the GNU General Public License, version 2"], "GPL-3.0": ["the GNU General Public License, version 3"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1"], "LGPL-3.0": ["the GNU Lesser General Public License, version 3"], "AGPL-3.0": ["the GNU Affero General Public License, version 3"], "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"], "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0"], "Unlicense": ["the Unlicense"],
}
VERBS = ["Licensed under", "Released under", "Distributed under the terms of", "This work is licensed under", "Content under"]
#: Paragraphs of licence texts and of the notices that they ask for.
PARAGRAPHS = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "GPL-2.0": ["free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "GPL-3.0": ["free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "LGPL-2.1": ["free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "AGPL-3.0": ["free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Licences whose paragraphs are all of another's, too, which has more: a paragraph of the first counts for the other
#: where the text also holds what only the other has, or names it.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}
#: What texts are compared with.
TEMPLATES = {k: [*(f"{verb} {name}" for name in names for verb in VERBS), f"SPDX-License-Identifier: {k}", *PARAGRAPHS.get(k, [])] for k, names in NAMES.items()}
#: Names of licence files, without their ending and in lower case.
LICENCE_FILES = ["license", "licence", "copying", "unlicense", "notice"]
TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")
#: Where a line, a sentence and a paragraph end.
ENDS = {"line": re.compile(r"\n"), "sentence": re.compile(r"[.!?](?=\s)|\n[^\S\n]*\n"), "paragraph": re.compile(r"\n[^\S\n]*\n")}
#: Least cosine, and the share of a file's words that licence text must make up to make it a licence file.
COSINE, FILE_SHARE = 0.7, 0.5
#: Scores that are remembered within a text.
SCORES_KEPT = 20_000
FOUND = "array<struct<license: string, score: double, start: bigint, end: bigint, words: bigint>>"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


VOCABULARY = frozenset(t for notices in TEMPLATES.values() for n in notices for t in terms(n))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted: Counter = Counter()
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            counted.update(VOCABULARY.intersection(terms(text)) if text else ())
            counted[""] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["term", "n"])


def weights(texts: DataFrame) -> dict[str, float]:
    """Inverse document frequencies of the templates' terms over all texts, and of any other term under ''."""
    rows = texts.mapInArrow(_frequencies, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {r.term: r.n for r in rows}
    total = n.get("", 0)
    idf = lambda k: math.log((total + 1) / (k + 1)) + 1
    return {t: idf(n.get(t, 0)) for t in VOCABULARY} | {"": idf(0)}


class Detector:
    """Cosines of the parts of a text to templates, as sparse vectors over terms.

    Parts are lines, sentences, paragraphs, the whole text, and every stretch of as many terms as the template has, so
    that a notice is found wherever it stands and however the text around it is set. A bound that needs only running
    sums rules nearly all parts out without loss: the cosine is at most the dot product over the norms, and a part's
    squared norm is at least the sum of its terms' squared weights, each counted for itself.
    """

    def __init__(self, idf: dict[str, float], least: float = COSINE):
        self.idf, self.least = idf, least
        self.templates = [(name, self.vector(found), len(found)) for name, notices in TEMPLATES.items() for n in notices if (found := terms(n))]
        self.shared = {k for k, (name, n) in enumerate((name, n) for name, notices in TEMPLATES.items() for n in notices if terms(n)) if name in WITHIN and n in PARAGRAPHS[name]}
        self.at = {t: i + 1 for i, t in enumerate(sorted(VOCABULARY))}  # 0: any other term
        self.squares = np.array([idf[""] ** 2, *(idf.get(t, idf[""]) ** 2 for t in self.at)])
        self.mass = np.zeros((len(self.templates), len(self.at) + 1))  # share of a template's squared norm by term
        self.dots = np.zeros_like(self.mass)
        for k, (_, v, _) in enumerate(self.templates):
            for t, x in v.items():
                self.mass[k, self.at[t]], self.dots[k, self.at[t]] = x * x, x * idf.get(t, idf[""])

    def vector(self, found: list[str]) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.idf[""]) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def cosine(self, template: int, found: list[str]) -> float:
        v = self.vector(found)
        return sum(x * v.get(t, 0.0) for t, x in self.templates[template][1].items())

    def best(self, unit: str) -> tuple[float, str]:
        return max((self.cosine(k, terms(unit)), self.templates[k][0]) for k in range(len(self.templates)))

    def parts(self, low: str, begins: np.ndarray) -> np.ndarray:
        """(first term, term after the last) of each line, sentence and paragraph, and of the whole text."""
        found = {(0, len(begins))}
        for pattern in ENDS.values():
            cuts = np.searchsorted(begins, [m.end() for m in pattern.finditer(low)])
            edges = np.unique(np.concatenate([[0], cuts, [len(begins)]]))
            found.update(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return np.array(sorted(found), np.int64)

    def __call__(self, text: str | None) -> list[dict]:
        """The parts of a text that are like a template. Of parts that overlap, the one with the highest cosine stays;
        of equals the longest, then the first, then the least name."""
        low = text.lower() if text else ""
        if len(low) != len(text or ""):  # a character whose lower case is longer keeps its place
            low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        there = VOCABULARY.intersection(TERM.findall(low))
        # A part's terms in common with a template hold at least the squared cosine of the template's squared norm.
        able = np.flatnonzero(self.mass[:, [self.at[t] for t in there]].sum(axis=1) >= self.least**2 - 1e-9) if there else ()
        if not len(able):
            return []
        found = list(TERM.finditer(low))
        names, begins, n = [m[0] for m in found], np.fromiter((m.start() for m in found), np.int64, len(found)), len(found)
        get = self.at.get
        codes = np.fromiter((get(t, 0) for t in names), np.int64, n)
        norms = np.concatenate([[0], np.cumsum(self.squares[codes])])
        parts, scored, known = self.parts(low, begins), [], {}
        for k in able.tolist():
            size = self.templates[k][2]
            sums = np.concatenate([[0], np.cumsum(self.dots[k][codes])])
            starts = np.arange(max(1, n - size + 1))
            for a, b in ((parts[:, 0], parts[:, 1]), (starts, np.minimum(starts + size, n))):
                bound = (sums[b] - sums[a]) / np.sqrt(norms[b] - norms[a])
                for i in np.flatnonzero(bound >= self.least - 1e-9).tolist():
                    place = int(a[i]), int(b[i])
                    words = (k, *names[place[0] : place[1]])
                    if words not in known:  # the same words again and again are scored once
                        known[words] = round(self.cosine(k, list(words[1:])), 9)
                    if known[words] >= self.least:
                        scored.append((-known[words], place[0] - place[1], place[0], self.templates[k][0], place[1], k in self.shared))
                    if len(known) > SCORES_KEPT:
                        known.clear()
        taken: list[tuple[int, int]] = []
        kept = []
        for score, _, a, name, b, shared in sorted(scored):
            i = bisect_left(taken, (a, b))
            if not ((i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b)):
                taken.insert(i, (a, b))
                kept.append((score, a, name, b, shared))
        only, out = {name for *_, name, _, shared in kept if not shared}, []
        for score, a, name, b, shared in kept:
            if shared and WITHIN[name] in only and name not in only:
                name = WITHIN[name]
            s, e = int(begins[a]), found[b - 1].end()
            out.append({"license": name, "score": min(1.0, -score), "start": s, "end": e, "words": len(text[s:e].split())})
        return sorted(out, key=lambda x: x["start"])


def detected(text: Column, idf: dict[str, float], least: float = COSINE) -> Column:
    """The licence notices of a text, as an array of (license, score, start, end, words)."""

    @F.pandas_udf(FOUND)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detector = Detector(idf, least)
        for batch in texts:
            yield pd.Series([detector(t) for t in batch], dtype=object)

    return find(text)


def ancestors(directory: Column) -> Column:
    """A directory and all above it, as an array of paths; the root is the empty path."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i.cast("int")), "/")))


def scan(files: DataFrame, *, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(key, path, license, score, origin, licensed_at) of each row of `files`.

    origin: `header` for the notice most like a template in the file's whole text; `file` where the file is
    named as a licence file or is mostly licence text: it licenses its directory as well; `inherited` from the
    nearest directory at or above the file's that has a licence file, licensed_at; else null. Where a
    directory has several, one named as such wins, then the best score and then the least name. A file's own notice outranks what it
    inherits. Null texts have no notices; a null path lies in the root; repeated rows are kept; an empty table
    gives no rows. Directories are joined, not files: each distinct directory looks up its ancestors once.
    """
    read = files.select(F.col(key).alias("k"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(text).alias("text"))
    idf = weights(read.select("text"))
    named = F.lower(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1)).isin(LICENCE_FILES)
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    noticed = read.select("k", "path", F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("directory"), named.alias("named"), n_words.alias("n_words"), detected(F.col("text"), idf).alias("found"))
    best = F.array_max(F.transform("found", lambda x: F.struct(x["score"].alias("score"), (-x["start"]).alias("at"), x["license"].alias("license"))))
    mostly = F.aggregate("found", F.lit(0).cast("bigint"), lambda s, x: s + x["words"]) >= FILE_SHARE * F.col("n_words")
    own = cut(noticed.select("k", "path", "directory", best.alias("best"), "named", ((F.size("found") > 0) & (F.col("named") | mostly)).alias("is_file")))
    own = own.select("k", "path", "directory", "best.license", "best.score", "named", "is_file")
    directories = own.where("is_file").groupBy("directory").agg(F.min(F.struct((~F.col("named")).alias("text_only"), (-F.col("score")).alias("s"), "license")).alias("best")).select(F.col("directory").alias("ancestor"), F.col("best.license").alias("given"))
    looked_up = own.select("directory").distinct().select("directory", F.explode(F.array_distinct(ancestors(F.col("directory")))).alias("ancestor"))
    nearest = looked_up.join(directories, "ancestor").groupBy("directory").agg(F.max(F.struct(F.length("ancestor").alias("depth"), "ancestor", "given")).alias("n"))
    nearest = nearest.select(F.col("directory").alias("of"), F.col("n.ancestor").alias("licensed_at"), F.col("n.given").alias("given"))
    both = own.join(nearest, own.directory == nearest.of, "left")
    has = F.col("license").isNotNull()
    origin = F.when(F.col("is_file"), "file").when(has, "header").when(F.col("given").isNotNull(), "inherited")
    return both.select(F.col("k").alias(key), "path", F.coalesce("license", "given").alias("license"), "score", origin.alias("origin"), F.when(~has, F.col("licensed_at")).alias("licensed_at"))
