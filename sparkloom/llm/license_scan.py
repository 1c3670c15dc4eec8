"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

Words are in normal form, shingles have five words. A template of s shingles is sought with windows of w shingles, the
largest of WINDOWS with s >= 1.5 w - 1, so that some document window, they overlap by half, lies wholly in any passage
that repeats it. Templates give their windows at every offset, so an unchanged passage has a window of similarity 1, and
one with a fifth of its shingles changed a window of 2/3 or more; with BANDS one-row bands, two such windows share a
band with probability 1 - (1/3)**16 > 0.9999999. Each retrieved template is then verified: the share of its distinct
shingles within the text around the window must reach CONTAINMENT.

A map over rows: templates travel with the tasks (their number is the catalogue's, not the data's).

Defined cases: null text has no words; null and repeated ids are judged row by row; templates under five words are
refused; a template found many times in a text gives one row, with the first place; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import slices, table, texts
from sparkloom.llm.wordhash import Member, WordHash, hashed, shingles

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 16
#: Shingles of a window; each but the first moves on by half.
WINDOWS = (1, 4, 16, 64)
SCHEMA = "doc_id long, license string, containment double, first_word long"

# Public licence notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def window_for(s: int) -> int:
    return max(w for w in WINDOWS if w == 1 or s >= 1.5 * w - 1)


def permuted(values: np.ndarray, band: int) -> np.ndarray:
    """The hash function of a band."""
    x = values ^ np.uint64((band * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) % 2**64)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x


def minima(values: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Least values of windows of two blocks of `half`, and how many windows each text has; a short text has one."""
    n_blocks = -(-counts // half)
    if not len(values):
        return values, n_blocks
    first = np.cumsum(counts) - counts
    block_first = np.cumsum(n_blocks) - n_blocks
    inside = np.arange(int(n_blocks.sum())) - np.repeat(block_first, n_blocks)
    least = np.minimum.reduceat(values, np.repeat(first, n_blocks) + half * inside)
    last = inside == np.repeat(n_blocks, n_blocks) - 1
    out = least.copy()
    out[:-1] = np.where(last[:-1], least[:-1], np.minimum(least[:-1], least[1:]))
    return out, n_blocks


class Catalogue:
    """Band tables of the templates, and the search of a batch of texts."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.known = WordHash()
        self.sets: list[np.ndarray] = []
        self.tables: dict[int, list[dict[int, set[int]]]] = {}
        for k, name in enumerate(self.names):
            words, counts = hashed([templates[name].encode()], self.known)
            rolled, n = shingles(words, counts, SHINGLE)
            if not len(rolled):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.sets.append(np.unique(rolled))
            w = window_for(len(rolled))
            tables = self.tables.setdefault(w, [{} for _ in range(BANDS if w > 1 else 1)])
            for band, found in enumerate(tables):
                values = permuted(rolled, band) if w > 1 else rolled
                for at in range(max(1, len(rolled) - w + 1)):
                    found.setdefault(int(values[at : at + w].min()), set()).add(k)
        self.members = {w: [Member(np.fromiter(t, np.uint64, len(t))) for t in tables] for w, tables in self.tables.items()}

    def candidates(self, rolled: np.ndarray, n: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, template, first shingle of the window) that share a band."""
        first = np.cumsum(n) - n
        found = set()
        for w, tables in self.tables.items():
            half = max(1, w // 2)
            for band, owners in enumerate(tables):
                values, counts = (minima(permuted(rolled, band), n, half)) if w > 1 else (rolled, n)
                hits = self.members[w][band].positions(values)
                start = np.cumsum(counts) - counts
                row = np.searchsorted(start + counts, hits, "right")
                for r, at, value in zip(row.tolist(), (half * (hits - start[row])).tolist(), values[hits].tolist()):
                    found.update((r, k, at) for k in owners[value])
        return found

    def scan(self, batch: list[bytes]) -> list[tuple[int, str, float, int]]:
        """(text, template, containment, first word) of verified templates."""
        words, counts = hashed(batch, self.known)
        rolled, n = shingles(words, counts, SHINGLE)
        first = np.cumsum(n) - n
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for r, k, at in sorted(self.candidates(rolled, n)):
            if (r, k) in found:
                continue
            own = self.sets[k]
            a, b = max(0, at - len(own)), min(int(n[r]), at + 64 + len(own))
            around = rolled[first[r] + a : first[r] + b]
            within = np.isin(around, own)
            share = len(np.unique(around[within])) / len(own)
            if share >= CONTAINMENT:
                found[r, k] = share, a + int(np.argmax(within))
        return [(r, self.names[k], share, at) for (r, k), (share, at) in sorted(found.items())]


def scan_batches(templates: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        catalogue = Catalogue(templates)
        kinds = [("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())]
        for batch in slices(batches, "text"):
            ids = batch.column(0)
            rows = [(ids[r].as_py(), *rest) for r, *rest in catalogue.scan(texts(batch, "text"))]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], schema=pa.schema(kinds))

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, first_word) of every template that a row of (doc_id, text) holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan_batches(TEMPLATES if templates is None else templates), SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
