"""Licence scans: sparse TF-IDF cosine of text windows to templates, and inheritance by directory.

A licence has short notices, headers and full texts as templates. Any template word can open a passage, however
common it is, and passages run across lines:

* of a notice of at most ``SHORT`` words, all runs of up to twice its words that begin and end at one of its words
  (other words at the ends only lower the cosine);
* of a longer header or text, all runs of its number of words, or the whole file where that is shorter.

Runs are left out only where a bound proves a cosine below ``LEAST``: by Cauchy and Schwarz, the cosine's square is at most the
share of the template's squared norm whose words occur in the run. Both sides are TF-IDF vectors; document
frequencies of the template words are counted over all files, any other word has the frequency one. The best
cosine of at least ``LEAST`` names the file's own licence. A file whose licence passages are at least half of its
words is a licence file and speaks for its directory. A file without an own licence takes that of its nearest
ancestor directory, found by joining all prefixes of its path. Where several licence files stand in a
directory, the best score wins, then the name.

Null and empty texts have no own licence but inherit; a null path inherits nothing; ties between templates go
to the first by name; repeated rows are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import prepare
from .words import PLAIN_WORD, hashes, slices, spans

# fixed values: names and notice lines of well-known licences
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license; redistribution in source and binary forms is permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0, Creative Commons Attribution 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "proprietary": "Copyright, all rights reserved, no part may be reproduced without permission",
}
# notices for the head of a file; full texts are in license_texts (none for CC-BY-4.0 and CC-BY-NC-4.0)
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
        You should have received a copy of the GNU Lesser General Public License along with this library. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
LEAST = 0.6
SHORT = 40
STARTS = 4096  # passages judged side by side


def all_templates() -> dict[str, list[str]]:
    """Notice lines, headers and full texts of each licence."""
    full = {f.stem: f.read_text() for f in (Path(__file__).parent / "license_texts").glob("*.txt")}
    return {n: [t, *(d[n] for d in (HEADERS, full) if n in d)] for n, t in TEMPLATES.items()}


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _hash(words: list[str]) -> np.ndarray:
    data = "\n".join(words).encode()
    buf = np.frombuffer(data, np.uint8)
    starts, ends, _ = spans(buf, np.array([0, len(buf)]), PLAIN_WORD)
    return hashes(buf, starts, ends)


def _frequency(vocabulary: np.ndarray):
    def count(batches):
        total = np.zeros(len(vocabulary), np.int64)
        rows_seen = 0
        for rows, data, offsets in slices(batches):
            starts, ends, of = spans(data, offsets, PLAIN_WORD)
            h = hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            pairs = np.unique(at[hit] * rows.num_rows + of[hit])
            total += np.bincount(pairs // rows.num_rows, minlength=len(vocabulary))
            rows_seen += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(vocabulary)), -1)), pa.array(np.append(total, rows_seen))], names=["word", "n"])

    return count


def _short_runs(term, stop, v, idf2, at, longest):
    """(cosine, end) of the best run from each of the starts ``at``, of at most ``longest`` words; term -1 is any other word."""
    place = at[:, None] + np.arange(longest)
    inside = place < stop[at][:, None]
    t = term[np.minimum(place, len(term) - 1)]
    before = np.zeros(t.shape, np.int32)  # equal words earlier in the run; other words differ from each other
    for j in range(1, longest):
        before[:, j] = (t[:, :j] == t[:, j : j + 1]).sum(1)
    before[t < 0] = 0
    cosine = np.cumsum(v[t] * np.sqrt(idf2[t]), 1) / np.sqrt(np.cumsum(idf2[t] * (2 * before + 1), 1))
    cosine[~inside | (v[t] <= 0)] = 0
    j = cosine.argmax(1)
    return cosine[np.arange(len(at)), j], at + j + 1


def _long_runs(term, v, idf2, length):
    """Cosine of every run of ``length`` words of one document."""
    n = len(term)
    own = np.where(term < 0, len(v) + np.arange(n), term)  # other words differ from each other
    keys = np.sort(own * (n + 1) + np.arange(n))
    count = lambda w, a, b: np.searchsorted(keys, w * (n + 1) + b) - np.searchsorted(keys, w * (n + 1) + a)
    dot = np.concatenate([[0.0], np.cumsum(v[term] * np.sqrt(idf2[term]))])
    first, times = np.unique(own[:length], return_counts=True)
    weight = idf2[np.where(first < len(v) - 1, first, -1)]
    s = np.arange(n - length)
    gone, come = own[: n - length], own[length:]
    step = idf2[term[length:]] * (2 * count(come, s + 1, s + length) + 1) - idf2[term[: n - length]] * (2 * count(gone, s, s + length) - 1)
    norm2 = float(weight @ times**2) + np.concatenate([[0.0], np.cumsum(step)])
    return (dot[length:] - dot[: n - length + 1]) / np.sqrt(norm2)


def _scan(model):
    names, vocabulary, idf2, vectors, lengths = model.value

    def scan(batches):
        for rows, data, offsets in slices(batches):
            starts, ends, of = spans(data, offsets, PLAIN_WORD)
            h = hashes(data, starts, ends)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            term = np.where(vocabulary[at] == h, at, -1)
            bound = np.searchsorted(of, np.arange(rows.num_rows + 1))
            stop = bound[1:][of]
            pairs = np.unique(term[term >= 0] * rows.num_rows + of[term >= 0])
            held, holder = pairs // rows.num_rows, pairs % rows.num_rows
            score, who = np.zeros(rows.num_rows), np.full(rows.num_rows, -1)
            edge = np.zeros(len(starts) + 1, np.int64)

            def take(k, a, b, cosine):
                np.add.at(edge, a, 1)
                np.add.at(edge, b, -1)
                top = np.zeros(rows.num_rows)
                np.maximum.at(top, of[a], cosine)
                better = top > score + 1e-12
                score[better], who[better] = top[better], k

            for k, (v, length) in enumerate(zip(vectors, lengths, strict=True)):
                mass = np.bincount(holder, weights=v[held] ** 2, minlength=rows.num_rows)
                able = mass >= LEAST**2 - 1e-9
                if not able.any():
                    continue
                if length <= SHORT:
                    v2 = v[term] ** 2
                    sums = np.concatenate([[0.0], np.cumsum(v2)])
                    a = np.flatnonzero((v2 > 0) & able[of])
                    a = a[sums[np.minimum(a + 2 * length, stop[a])] - sums[a] >= LEAST**2 - 1e-9]
                    for i in range(0, len(a), STARTS):
                        s = a[i : i + STARTS]
                        cosine, e = _short_runs(term, stop, v, idf2, s, 2 * length)
                        ok = cosine >= LEAST
                        take(k, s[ok], e[ok], cosine[ok])
                    continue
                for d in np.flatnonzero(able):
                    size = int(min(length, bound[d + 1] - bound[d]))
                    cosine = _long_runs(term[bound[d] : bound[d + 1]], v, idf2, size)
                    while cosine.max() >= LEAST:  # runs that don't overlap, best first
                        s = int(cosine.argmax())
                        take(k, np.array([bound[d] + s]), np.array([bound[d] + s + size]), cosine[s : s + 1])
                        cosine[max(0, s - size + 1) : s + size] = 0
            covered = np.cumsum(edge[:-1]) > 0
            share = np.bincount(of, weights=covered, minlength=rows.num_rows) / np.maximum(np.diff(bound), 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("path"), pa.array([names[k] if k >= 0 else None for k in who], pa.string()), pa.array(score), pa.array((share >= 0.5) & (who >= 0))],
                names=["doc_id", "path", "license", "score", "licence_file"],
            )

    return scan


def scan_licenses(files: DataFrame, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """files (doc_id, path, text) with own licence, score, whether it is a licence file, the licence in force and the directory it comes from."""
    spark = files.sparkSession
    prepare(files.sparkSession)
    templates = templates or all_templates()
    texts = [(n, _words(t)) for n in sorted(templates) for t in ([templates[n]] if isinstance(templates[n], str) else templates[n])]
    every = sorted({w for _, t in texts for w in t})
    keys = _hash(every)
    order = np.argsort(keys)
    place = {every[j]: i for i, j in enumerate(order)}
    vocabulary = keys[order]
    counts = {r.word: r.n for r in files.select("text").mapInArrow(_frequency(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = max(1, counts.get(-1, 0))
    weight = lambda n: math.log((1 + total) / (1 + n)) + 1
    idf = np.array([*(weight(counts.get(i, 0)) for i in range(len(vocabulary))), weight(1)])  # the last one is any other word's
    vectors = np.zeros((len(texts), len(vocabulary) + 1))
    for k, (_, t) in enumerate(texts):
        for w in t:
            vectors[k, place[w]] += idf[place[w]]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(([n for n, _ in texts], vocabulary, idf**2, vectors, [len(t) for _, t in texts]))
    seen = files.select("doc_id", "path", "text").mapInArrow(_scan(shared), "doc_id long, path string, license string, score double, licence_file boolean")
    return inherit(seen)


def inherit(seen: DataFrame) -> DataFrame:
    """Adds ``effective_license`` and ``inherited_from`` to files with path, license, score, licence_file."""
    parent = F.regexp_replace("path", r"/?[^/]*$", "")
    place = F.struct((-F.col("score")).alias("s"), F.col("license").alias("license"))
    homes = seen.where("licence_file and path is not null").groupBy(parent.alias("dir")).agg(F.min(place)["license"].alias("dir_license"))
    steps = F.split(parent, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    # directories are few against files: each distinct one is walked once
    dirs = seen.where("path is not null").select(parent.alias("home"), prefixes.alias("up")).distinct()
    up = dirs.select("home", F.posexplode("up").alias("depth", "dir")).join(homes, "dir")
    nearest = up.groupBy("home").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("near"))
    out = seen.withColumn("home", parent).join(nearest, "home", "left")
    return out.select(
        "doc_id", "path", "license", "score", "licence_file",
        F.coalesce("license", "near.dir_license").alias("effective_license"),
        F.when(F.col("license").isNull(), F.col("near.dir")).alias("inherited_from"),
    )
