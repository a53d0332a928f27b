"""Licence scan: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by size.  For templates of up to c shingles a text is read in windows of 2c
shingles that start every c shingles of the text, so every run of c shingles lies whole in some window.  A
window that holds ``share`` of a template's n shingles has a Jaccard similarity with it of at least
``share * n / (2c + (1 - share) * n)``; the number of bands of ROWS hashes is chosen from that bound
so that such a window meets the template in at least one band with probability TARGET.  A text of which a
window is met is verified exactly, in all its windows: distinct template shingles found, over all distinct
template shingles.  So a result depends on the text alone, wherever the text lies.

No rows are exchanged: the templates go to all tasks (their total size is checked) and each text is
read where it lies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import shingles, slabs, word_hashes

ROWS = 1
TARGET = 0.9995
#: Bytes of template text that may be sent to all tasks.
TEMPLATE_BYTES = 16 << 20

# Public licence notices in their usual wording.
LICENSES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


class Templates:
    """Shingle sets and band values of the templates, by size class."""

    def __init__(self, texts: dict[str, str], share: float, words: int) -> None:
        self.share, self.words = share, words
        self.names = list(texts)
        h, off = word_hashes(list(texts.values()))
        self.sets = [np.unique(shingles(h[a:b], words)) for a, b in zip(off[:-1], off[1:])]
        self.length = [max(0, int(b - a) - words + 1) for a, b in zip(off[:-1], off[1:])]
        by: dict[int, list[int]] = {}
        for i, n in enumerate(self.length):
            if n:
                by.setdefault(1 << max(0, n - 1).bit_length(), []).append(i)
        rng = np.random.default_rng(20)
        self.classes = []
        for c, members in sorted(by.items()):
            least = min(share * len(self.sets[i]) / (2 * c + (1 - share) * len(self.sets[i])) for i in members)
            bands = math.ceil(math.log(1 - TARGET) / math.log(1 - least**ROWS))
            mult = rng.integers(1 << 62, 1 << 63, bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            sign = [np.array([(self.sets[i] * m).min() for m in mult]).reshape(bands, ROWS) for i in members]
            self.classes.append((c, members, mult.reshape(bands, ROWS), sign))

    def found(self, texts: list[str | None]):
        """Yield (text number, template number, containment, first word of the window, windows)."""
        k = self.words
        for a, b in slabs(texts):
            h, off = word_hashes(texts[a:b])
            s = shingles(h, k)
            if not len(s):
                continue
            count = np.maximum(np.diff(off) - k + 1, 0)  # shingles of each text
            text = np.repeat(np.arange(b - a), count)
            begin = np.cumsum(count) - count
            own = np.arange(count.sum()) - begin[text]
            s = s[off[:-1][text] + own]
            for c, members, mult, sign in self.classes:
                # texts begin at multiples of c
                cells = -(-count // c)
                start = (np.cumsum(cells) - cells) * c
                place = start[text] + own
                wide = np.zeros(int(cells.sum()) * c, np.uint64)
                wide[place] = s
                blank = np.ones(len(wide), bool)
                blank[place] = False
                blank = np.flatnonzero(blank)
                met = [np.zeros(0, np.int64) for _ in members]
                for band, m in enumerate(mult):
                    equal = [True] * len(members)
                    for row, x in enumerate(m):
                        v = wide * x
                        v[blank] = np.uint64(2**64 - 1)
                        if c > 1:
                            v = v.reshape(-1, c).min(axis=1)
                        low = np.minimum(v, np.append(v[1:], np.uint64(2**64 - 1)))
                        for j in range(len(members)):
                            equal[j] = equal[j] & (low == sign[j][band, row])
                    for j in range(len(members)):
                        met[j] = np.append(met[j], np.flatnonzero(equal[j]))
                for j, t in enumerate(members):
                    need = self.sets[t]
                    for d in np.unique(np.searchsorted(start, met[j] * c, "right") - 1).tolist() if len(met[j]) else ():
                        while not count[d]:  # texts without shingles share their place with the next one
                            d += 1
                        mine = s[begin[d] : begin[d] + count[d]]
                        at = np.flatnonzero(np.isin(mine, need))
                        best, first, n = 0.0, 0, 0
                        for w in np.unique(np.concatenate((at // c, np.maximum(at // c - 1, 0)))).tolist():
                            here = at[np.searchsorted(at, w * c) : np.searchsorted(at, (w + 2) * c)]
                            share = len(np.unique(mine[here])) / len(need)
                            n += share >= self.share
                            if share > best:
                                best, first = share, int(here[0])
                        if best >= self.share:
                            yield a + d, t, best, first, n


_SCHEMA = "doc_id long, license string, containment double, first_word long, n_windows long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8, words: int = 5) -> DataFrame:
    """One row per document and template of which some window holds ``share`` of the shingles.

    containment: the largest over windows; first_word: where the first matching shingle of the earliest such window
    starts; n_windows: overlapping windows that reach the share.  Null and empty texts, and templates with
    fewer words than a shingle, match nothing.  Repeated rows give repeated rows; a null doc_id stays
    null; an empty table gives an empty table.  Other columns are not read.
    """
    texts = LICENSES if templates is None else templates
    if sum(map(len, texts.values())) > TEMPLATE_BYTES:
        raise ValueError("templates are too large to send to all tasks; scan with parts of them and union the results")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(texts)

    def run(batches):
        ready = Templates(sent.value, share, words)
        for b in batches:
            ids, body = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = list(ready.found(body))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([ready.names[r[1]] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["doc_id", "license", "containment", "first_word", "n_windows"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), _SCHEMA)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
