"""Licence scan: sparse TF-IDF cosine of a file's lines, paragraphs and whole text to licence templates, then inheritance.

A stretch of text is the set of its words (runs of letters, digits and characters beyond ASCII, A-Z lowered), each
weighted by the inverse frequency of the word among the templates; a word that no template has weighs most.  Every
line, every paragraph and the whole of every text is held against every template; a cosine of at least ``least`` is a
match.  Only stretches with two or more telling words (those that are no function words) can match and are worked out.

A licence's evidence is the weight of the words that it shares with the stretches that match it, each word's place in the
text counted once, at the best cosine of a stretch around it.  The licence with the most evidence is the file's; on equal evidence
that of which a larger share of templates has matched, then the one that sorts first.  A reservation of all rights, which most
licences open with, counts only where no licence matches.

A file is a licence file of its directory if its name says so (LICENSE, LICENCE, COPYING, NOTICE, UNLICENSE, with any
ending) or if at least nine tenths of its words are words of templates that match around them.  A file without a licence of its own takes
that of the licence file in the nearest directory above it, its own directory first; of several licence files in
one directory the one with the smallest path counts.  Directories, not files, are joined with their ancestors.

Defined cases: a null or empty text has no licence of its own and inherits; a null path inherits nothing and
passes nothing on; repeated rows, and rows that share an id or have none, give a row each; an empty table gives no row;
very long texts are worked on one at a time, their matching stretches in memory; columns of the input named like a
result give way.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ALNUM, U, Block, checkpointed, map_blocks

_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_NO_LIABILITY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANTED = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_INCLUDED = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)

#: Customary notices and the texts, titles and telling clauses of public licences, by SPDX identifier.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        f"{_GRANTED} {_INCLUDED}",
        _GRANTED,
        _INCLUDED,
        _AS_IS,
        f"MIT License {_GRANTED} {_INCLUDED} {_AS_IS}",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "BSD-3-Clause": [
        "Licensed under the 3-Clause BSD License.",
        f"{_FORMS} {_SOURCE} {_NAMES}",
        _FORMS,
        _SOURCE,
        _BINARY,
        _NAMES,
        _NO_LIABILITY,
        f"{_FORMS} {_SOURCE} {_BINARY} {_NAMES}",
        f"BSD 3-Clause License {_FORMS} {_SOURCE} {_BINARY} {_NAMES} {_NO_LIABILITY}",
    ],
    "BSD-2-Clause": [
        "Licensed under the 2-Clause BSD License.",
        _FORMS,
        _SOURCE,
        _BINARY,
        _NO_LIABILITY,
        f"{_FORMS} {_SOURCE} {_BINARY}",
        f"BSD 2-Clause License {_FORMS} {_SOURCE} {_BINARY} {_NO_LIABILITY}",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}
#: What counts only where nothing else matches.
LAST = "Proprietary"
_FUNCTION = set("a all an and any are as at be by can for from if in is it no not of on one or other shall that the this to under use was with without work you your 0 1 2 3 4".split())
#: A cosine that a notice reaches with a name or year more, and prose does not.
LEAST = 0.7
_FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"


def _words(text: str) -> list[bytes]:
    b = Block(pa.array([text], pa.large_string()), lower=True)
    b.words(ALNUM)
    return [b.buf[i:j].tobytes() for i, j in zip(b.start, b.end, strict=True)]


class Index:
    """The templates' words with weights, and each template's unit vector."""

    def __init__(self, notices: dict[str, list[str]]):
        texts = [(name, set(_words(t))) for name in sorted(notices) for t in notices[name]]
        df = Counter(w for _, own in texts for w in own)
        idf = {w: math.log((1 + len(texts)) / (1 + c)) + 1 for w, c in df.items()}
        self.unknown = math.log(1 + len(texts)) + 1
        self.words = sorted(idf)
        b = Block(pa.array(["\n".join(w.decode() for w in self.words)], pa.large_string()))
        b.words(ALNUM)
        h = b.word_hashes()
        order = np.argsort(h)
        self.keys, self.weight = h[order], np.array([idf[w] for w in self.words])[order]
        self.telling = np.array([w.decode() not in _FUNCTION for w in self.words])[order]
        place = {w: k for k, w in enumerate(np.array(self.words, object)[order])}
        self.names = np.array([name for name, _ in texts])
        self.matrix = np.zeros((len(texts), len(self.keys)))
        for i, (_, own) in enumerate(texts):
            at = [place[w] for w in own]
            self.matrix[i, at] = self.weight[at] / np.sqrt((self.weight[at] ** 2).sum())

    def cosines(self, slots: np.ndarray, unknown: int) -> np.ndarray:
        """To every template, of a set of known words (their slots) and so many others."""
        norm = math.sqrt((self.weight[slots] ** 2).sum() + unknown * self.unknown**2)
        return self.matrix[:, slots] @ self.weight[slots] / norm


_OWN = T.StructType([T.StructField("own", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType())])


def own_licence(docs: DataFrame, text: str, keep: list[str], notices: dict[str, list[str]] = NOTICES, least: float = LEAST) -> DataFrame:
    """``keep`` columns with own (licence or null), its cosine and the share of words that matching templates have."""
    state: list[Index] = []

    def fn(texts: pa.Array) -> list[pa.Array]:
        if not state:
            state.append(Index(notices))
        ix, b = state[0], Block(texts, lower=True)
        b.words(ALNUM)
        h = b.word_hashes()
        names, best, share = [None] * b.rows, np.zeros(b.rows), np.zeros(b.rows)
        if len(h):
            slot = np.minimum(np.searchsorted(ix.keys, h), len(ix.keys) - 1)
            slot = np.where(ix.keys[slot] == h, slot, -1)
            feeds = np.cumsum(b.buf == 10)
            gap = np.diff(feeds[b.start], prepend=feeds[b.start[:1]])
            turn = np.diff(b.row, prepend=-1) > 0
            telling = (slot >= 0) & ix.telling[slot]
            covered = np.zeros(len(h), bool)
            matches: dict[tuple[int, str], list[tuple]] = {}
            for new in (turn | (gap > 0), turn | (gap > 1), turn):  # lines, paragraphs, whole texts
                head = np.flatnonzero(new)
                end = np.append(head[1:], len(h))
                for k in np.flatnonzero(np.add.reduceat(telling, head) >= 2):
                    i, j = head[k], end[k]
                    known = np.unique(slot[i:j][slot[i:j] >= 0])
                    c = ix.cosines(known, len(np.unique(h[i:j][slot[i:j] < 0])))
                    for t in np.flatnonzero(c >= least).tolist():
                        covered[i:j] |= (slot[i:j] >= 0) & (ix.matrix[t][slot[i:j]] > 0)
                        matches.setdefault((int(b.row[i]), str(ix.names[t])), []).append((float(c[t]), i, j, t))
            chosen: dict[int, tuple] = {}
            for (r, name), found in sorted(matches.items()):
                lo, hi = b.first[r], b.first[r + 1]
                at = np.zeros(hi - lo)
                for c, i, j, t in found:
                    own = (slot[i:j] >= 0) & (ix.matrix[t][slot[i:j]] > 0)
                    at[i - lo : j - lo][own] = np.maximum(at[i - lo : j - lo][own], c)
                evidence = float((at * np.where(slot[lo:hi] >= 0, ix.weight[slot[lo:hi]], 0)).sum())
                part = len({t for *_, t in found}) / int((ix.names == name).sum())
                rank = (name != LAST, round(evidence, 9), round(part, 9))
                if r not in chosen or rank > chosen[r][0]:
                    chosen[r] = rank, name, max(found)[0]
            for r, (_, name, c) in chosen.items():
                names[r], best[r] = name, c
            total = np.bincount(b.row, minlength=b.rows)
            share = np.bincount(b.row, covered, b.rows) / np.maximum(total, 1)
        return [pa.array(names, pa.string()), pa.array(best), pa.array(share)]

    return map_blocks(docs, text, keep, _OWN, fn)


def scan(docs: DataFrame, path: Column | str, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """``keep`` columns (all by default) with path, licence, cosine (0 if inherited or none) and how: own, file, inherited or none."""
    new = ["path", "licence", "cosine", "how"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text"), (F.col(path) if isinstance(path, str) else path).alias("path"))
    # three uses follow; the texts are scanned for the first alone
    found = checkpointed(own_licence(rows, "_text", [f"_k{i}" for i in range(len(keep))] + ["path"], **options))
    found = found.withColumns({
        # the directory with its slash; the root is empty
        "dir": F.regexp_extract("path", r"(?s)^(.*/)?[^/]*$", 1),
        "file": F.coalesce(F.col("own").isNotNull() & (F.col("path").rlike(_FILE_NAME) | (F.col("share") >= 0.9)), F.lit(False)),
    })
    given = found.where("file and path is not null").groupBy("dir").agg(F.min_by("own", "path").alias("gives")).withColumnRenamed("dir", "above")
    needy = found.where("own is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = needy.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i), "/"), F.when(i > 0, "/").otherwise("")))).alias("above"))
    nearest = ancestors.join(given, "above").groupBy("dir").agg(F.max_by("gives", F.length("above")).alias("gives"))
    out = found.join(nearest, "dir", "left")
    how = F.when(F.col("file"), "file").when(F.col("own").isNotNull(), "own").when(F.col("gives").isNotNull(), "inherited").otherwise("none")
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "path", F.coalesce("own", "gives").alias("licence"), F.col("cosine"), how.alias("how"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document as a file of its source and language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return scan(docs, path, keep=["doc_id"]).withColumn("cosine", F.round("cosine", 6))
