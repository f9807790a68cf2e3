"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, inherited down directories.

Every line of a file, every run of up to three lines, every paragraph and the whole file is a candidate, so headers,
footers and licence files are all covered. Terms are words and word pairs; document frequencies of the
templates' terms are counted over all files, and every other term of a candidate weighs as one that all files hold. Lines are
scored around the words without which no text reaches the threshold, however many files hold them. A
file without a licence of its own takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import as_row, many_to_one
from .scratch import materialise
from .words import hash_words, shingle_hashes, slices, string_buffers

#: The bodies and headers of licences as files and headers carry them.
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either {}, or "
    "(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
)
#: Short notices by which licences are stated, by public licence identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", APACHE_HEADER),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", MIT_TEXT),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU General Public License Version 3, 29 June 2007", GPL_HEADER.format("version 3 of the License")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU General Public License Version 2, June 1991", GPL_HEADER.format("version 2 of the License")),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal public domain dedication",),
    "Proprietary": ("All rights reserved.",),
}
THRESHOLD = 0.6
LINES = 3
#: Weight of a term that no template has: that of one which every file holds.
OTHER_IDF = 1.0
#: Longer candidates are counted by hashes, in bounded memory.
_LONG = 20_000
LICENCE_NAMES = ("LICENSE", "LICENCE", "COPYING", "NOTICE")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOUND = pa.struct([("licence", pa.string()), ("score", pa.float64())])


def terms_of(text: str) -> Counter:
    """Counts of words and of neighbouring pairs."""
    w = _WORD.findall(text.lower())
    return Counter(w) + Counter(map(" ".join, zip(w, w[1:], strict=False)))


class Templates:
    """TF-IDF vectors of the templates for given document frequencies."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], files: int):
        self.frequency, self.files = frequency, files
        self.names, self.vectors = [], []
        counts = [(name, terms_of(t)) for name, texts in sorted(templates.items()) for t in texts]
        self.idf = {t: math.log((files + 1) / (frequency.get(t, 0) + 1)) + 1 for _, c in counts for t in c}
        for name, c in counts:
            v = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.names.append(name)
            self.vectors.append({t: x / norm for t, x in v.items()})
        terms = sorted(self.idf)
        self.column = {t: i for i, t in enumerate(terms)}
        self.weight = np.array([self.idf[t] for t in terms])
        self.matrix = np.zeros((len(self.vectors), len(terms)))
        for i, v in enumerate(self.vectors):
            for t, x in v.items():
                self.matrix[i, self.column[t]] = x
        hashes = np.array([_term_hash(t) for t in terms], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def _cosines(self, columns: np.ndarray, counts: np.ndarray, others: float) -> tuple[str | None, float]:
        if not len(columns):
            return None, 0.0
        x = counts * self.weight[columns]
        cosines = np.round(self.matrix[:, columns] @ x / math.sqrt(float(x @ x) + OTHER_IDF**2 * others), 9)
        i = min(np.flatnonzero(cosines == cosines.max()).tolist(), key=lambda k: (self.names[k], k))
        return (self.names[i], float(cosines[i])) if cosines[i] > 0 else (None, 0.0)

    def best(self, text: str) -> tuple[str | None, float]:
        """The most similar template's licence and the cosine, which all terms of the text take part in; ties to the first name."""
        if len(text) > _LONG:
            return self.best_long(text)
        counts = terms_of(text)
        known = [(self.column[t], n) for t, n in counts.items() if t in self.column]
        others = sum(n * n for t, n in counts.items() if t not in self.column)
        return self._cosines(np.array([k for k, _ in known], np.int64), np.array([n for _, n in known], np.float64), others)

    def best_long(self, text: str) -> tuple[str | None, float]:
        """``best`` over hashes of the terms."""
        words = _hash_of([text])
        terms, counts = np.unique(np.concatenate((words, shingle_hashes(words, 2) if len(words) > 1 else words[:0])), return_counts=True)
        k = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
        known = self.hashes[k] == terms
        return self._cosines(self.order[k[known]], counts[known].astype(np.float64), float((counts[~known].astype(np.float64) ** 2).sum()))

    def marks(self, threshold: float) -> set[str]:
        """Words of which every text that reaches ``threshold`` holds one.

        The least frequent words of each template, until the terms made of its other words alone
        have a norm below the threshold: no text without a marked word can have such a cosine.
        """
        out: set[str] = set()
        for v in self.vectors:
            rest = sorted((t for t in v if " " not in t), key=lambda t: (self.frequency.get(t, 0), t))
            while rest and sum(x * x for t, x in v.items() if all(w in rest for w in t.split(" "))) >= max(threshold - 1e-6, 0.0) ** 2:
                out.add(rest.pop(0))
        return out

    def scan(self, text: str, lines: list[int]) -> tuple[str | None, float]:
        """Best of the candidates that hold one of the numbered lines: runs of one to LINES lines, paragraphs, the file."""
        starts = [0, *[m.end() for m in re.finditer("\n", text)]]
        most = len(starts) - 1
        at = [*starts, len(text) + 1]
        blank = np.array([not text[at[i] : at[i + 1] - 1].strip() for i in range(most + 1)])
        gaps = np.flatnonzero(blank)
        seen = {(0, most)}
        for line in lines:
            for first in range(max(0, line - LINES + 1), line + 1):
                seen.update((first, last) for last in range(line, min(first + LINES, most + 1)))
            k = int(np.searchsorted(gaps, line))  # blank lines before this one; a marked line isn't blank
            seen.add((int(gaps[k - 1]) + 1 if k else 0, int(gaps[k]) - 1 if k < len(gaps) else most))
        found: tuple[str | None, float] = (None, 0.0)
        for first, last in seen:
            name, score = self.best(text[at[first] : at[last + 1] - 1])
            if name is not None and (-score, name) < (-found[1], found[0] or "~"):
                found = (name, score)
        return found


def _hash_of(words: list[str]) -> np.ndarray:
    raw, offsets = string_buffers(pa.array(words, pa.string()))
    return hash_words(raw, offsets)[0]


def _term_hash(term: str) -> int:
    """Of a word or a pair, as in ``best_long``."""
    words = _hash_of([term])
    return int(words[0] if len(words) == 1 else shingle_hashes(words, 2)[0])


def _presence_udf(vocabulary: list[str]):
    """Which template words and pairs a file holds, and -1 for every file."""
    singles = [t for t in vocabulary if " " not in t]
    pairs = [t.split(" ") for t in vocabulary if " " in t]
    number = {t: i for i, t in enumerate(vocabulary)}

    @F.arrow_udf("array<int>")
    def present(text: pa.Array) -> pa.Array:
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        keys = _hash_of(singles)
        order = np.argsort(keys)
        keys = keys[order]
        pair_id = {(singles.index(a), singles.index(b)): number[f"{a} {b}"] for a, b in pairs}
        out = []
        for a, b in slices(text, 2 << 20):
            words, _, _, at = hash_words(*string_buffers(text.slice(a, b - a)))
            k = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            pos = np.flatnonzero(keys[k] == words) if len(keys) else np.zeros(0, np.int64)
            which = order[k[pos]]
            doc = np.searchsorted(at, pos, side="right") - 1
            cuts = np.searchsorted(doc, np.arange(b - a + 1))
            for d in range(b - a):
                w, p = which[cuts[d] : cuts[d + 1]], pos[cuts[d] : cuts[d + 1]]
                got = {number[singles[i]] for i in np.unique(w).tolist()}
                near = np.flatnonzero(np.diff(p) == 1)
                got |= {pair_id[x] for x in set(zip(w[near].tolist(), w[near + 1].tolist(), strict=True)) if x in pair_id}
                out.append([-1, *sorted(got)])
        return pa.array(out, pa.list_(pa.int32()))

    return present


def _scan_udf(model: Templates, threshold: float):
    marked = sorted(model.marks(threshold))

    @F.arrow_udf("struct<licence:string,score:double>")
    def scan(text: pa.Array) -> pa.Array:
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        keys = np.sort(_hash_of(marked))
        out: list[dict | None] = []
        for a, b in slices(text, 2 << 20):
            part = text.slice(a, b - a)
            raw, offsets = string_buffers(part)
            words, starts, _, at = hash_words(raw, offsets)
            k = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
            pos = np.flatnonzero(keys[k] == words) if len(keys) else np.zeros(0, np.int64)
            cuts = np.searchsorted(pos, at)
            for d in range(b - a):
                marks = starts[pos[cuts[d] : cuts[d + 1]]] - offsets[d]
                if not len(marks):
                    out.append(None)
                    continue
                breaks = np.flatnonzero(raw[offsets[d] : offsets[d + 1]] == 10)
                name, score = model.scan(part[d].as_py(), np.unique(np.searchsorted(breaks, marks)).tolist())
                out.append({"licence": name, "score": score} if score >= threshold else None)
        return pa.array(out, _FOUND)

    return scan


def directory_of(path: Column) -> Column:
    """What stands before the last '/'; '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def licence_scan(files: DataFrame, text: str = "text", path: str = "path", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` without the text, with licence, licence_score, licence_from ('own', a directory, or null).

    A file's own licence is the template most similar to any of its notices, if the cosine
    reaches ``threshold`` (ties: first by name). Licence files (LICENSE, LICENCE, COPYING, NOTICE, with
    any extension) with a licence give it to their directory; of several in one directory the best score,
    then the first name, counts. Other files inherit from the nearest directory at or above their own.
    Null or empty texts have no licence of their own; a null path is a file at the top that
    inherits nothing and gives nothing. Repeated rows are judged alike. Columns of these names are
    replaced.
    """
    made = {"licence", "licence_score", "licence_from", text.lower()}
    keep = files.select(*[f"`{c}`" for c in files.columns if c.lower() not in made])
    vocabulary = sorted({t for texts in templates.values() for x in texts for t in terms_of(x)})
    held = {r.k: r["count"] for r in files.select(F.explode(_presence_udf(vocabulary)(F.col(text))).alias("k")).groupBy("k").count().collect()}  # at most one row per template term
    model = Templates(templates, {vocabulary[k]: n for k, n in held.items() if k >= 0}, held.get(-1, 0))

    out = files.select(as_row(keep).alias("row"), F.col(path).alias("path"), directory_of(F.col(path)).alias("dir"), _scan_udf(model, threshold)(F.col(text)).alias("own"))
    out = materialise(out, "licences")
    name = F.upper(F.regexp_extract("path", r"([^/.]*)[^/]*$", 1))
    giving = out.filter(name.isin(*LICENCE_NAMES) & F.col("own.licence").isNotNull())
    best = giving.groupBy("dir").agg(F.min(F.struct((-F.col("own.score")).alias("s"), F.col("own.licence").alias("l"))).alias("b"))
    best = materialise(best.select(F.col("dir").alias("above"), F.col("b.l").alias("licence"), (-F.col("b.s")).alias("score")), "directories")

    # every directory of a bare file once, with all directories at or above it: depth bounds the rows per directory
    bare = F.col("path").isNotNull() & F.col("own").isNull()
    dirs = materialise(out.filter(bare).groupBy("dir").agg(F.count(F.lit(1)).alias("jn_rows")), "bare")
    parts = F.split("dir", "/")
    ups = F.array_union(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit("")))
    chains = dirs.select("dir", F.posexplode(ups).alias("up", "above"))
    wanted = materialise(best.join(chains.groupBy("above").agg(F.count(F.lit(1)).alias("jn_rows")), "above"), "wanted")
    nearest = many_to_one(chains, wanted, ["above"]).groupBy("dir").agg(F.min(F.struct("up", "above", "licence", "score")).alias("near"))
    nearest = materialise(nearest.join(dirs, "dir"), "nearest")
    found = many_to_one(out.filter(bare), nearest, ["dir"], "left")
    columns = [F.col(f"row.`{c}`") for c in keep.columns]
    inherited = found.select(*columns, F.col("near.licence").alias("licence"), F.col("near.score").alias("licence_score"), F.col("near.above").alias("licence_from"))
    rest = out.filter(~bare).select(*columns, F.col("own.licence").alias("licence"), F.col("own.score").alias("licence_score"), F.when(F.col("own").isNotNull(), F.lit("own")).alias("licence_from"))
    return rest.unionByName(inherited)


def paths_of(docs: DataFrame) -> DataFrame:
    """``docs`` laid out as files by id, since they have no paths: 64 to a project, 8 to a folder; the first of each folder is its LICENSE."""
    n = F.coalesce("doc_id", F.lit(0))
    project, folder = F.floor(n / 64).cast("string"), F.floor((n % 64) / 8).cast("string")
    file = F.when(n % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    inner = F.when(n % 64 == 0, F.lit("")).otherwise(F.concat(F.lit("/d"), folder))
    inner_file = F.when((n % 8 == 0) & (n % 64 != 0), F.lit("LICENSE")).otherwise(file)
    return docs.withColumn("path", F.concat(F.lit("p"), project, inner, F.lit("/"), inner_file))


def query(spark, sf_dir: str) -> DataFrame:
    docs = paths_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = licence_scan(docs)
    return out.select("doc_id", "path", "licence", F.round("licence_score", 6).alias("score"), "licence_from")
