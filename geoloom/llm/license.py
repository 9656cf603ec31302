"""License scans: MinHash bands over overlapping text windows retrieve
templates; exact shingle containment verifies them.

Shingles are runs of 3 folded tokens. A template of n shingles belongs to the
smallest width W >= n of 8, 16, 32, ..; its windows are 2W shingles long and
start every W, so each run of W shingles, hence each copy of the template, lies
in one window. A window of at most 2W distinct shingles that holds a share c of
the template's n > W/2 has Jaccard of at least
    J = cn / (2W + (1 - c)n) > c / (5 - c),
0.21 for c = 0.9. Each of the BANDS = 64 minima is a band of one row, so the
window meets its template in some band with probability 1 - (1 - J)**64, over
0.999998. Whatever a band brings together is verified: the share of the
template's distinct shingles in the window must reach `containment`.

Windows without any template shingle have containment 0, so a bitmap of the
templates' shingles skips their MinHash; this loses nothing and leaves little
work in texts without licenses.

Result: (doc_id, license, containment), the best window of each document and
template. Defined cases: NULL text is ''; texts of fewer than 3 tokens have no
shingles; rows without a doc_id are left out; rows that repeat a doc_id report
once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD_BREAK_SQL, bitmap_of, member, mix, ranges, slices, spans_hash, tokens, utf8

SHINGLE, BANDS, CONTAINMENT = 3, 64, 0.9

#: Short public notices by which texts state their license.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "licensed under the GNU General Public License, version 2",
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


class Index:
    """Templates by width: their shingles, and their minima in every band."""

    def __init__(self, templates: dict[str, str], containment: float):
        self.names, self.containment = list(templates), containment
        self.salts = np.random.default_rng(10).integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
        h, _, _, doc = tokens(*utf8(pa.array(list(templates.values()), pa.string())), fold=True)
        first = np.flatnonzero(doc[:-2] == doc[2:])
        value, owner = spans_hash(h, first, SHINGLE), doc[first]
        self.sets = [np.unique(value[owner == i]) for i in range(len(self.names))]
        if any(len(x) == 0 for x in self.sets):
            raise ValueError("a template needs at least 3 tokens")
        self.known = np.unique(value)
        self.bitmap = bitmap_of(self.known)
        self.widths: dict[int, tuple[list[int], np.ndarray]] = {}
        for i in range(len(self.names)):
            n = int((owner == i).sum())
            width = 8
            while width < n:
                width *= 2
            self.widths.setdefault(width, ([], None))[0].append(i)
        for width, (own, _) in self.widths.items():
            self.widths[width] = (own, np.stack([self.minima(self.sets[i], np.zeros(1, np.int64))[0] for i in own]))

    def minima(self, values: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(runs, BANDS) least salted hashes of runs of values."""
        return np.stack([np.minimum.reduceat(mix(values * salt), start) for salt in self.salts], 1)

    def scan(self, texts: pa.Array) -> list[tuple[int, int, float]]:
        """(row, template, best containment) of the templates found."""
        h, _, _, doc = tokens(*utf8(texts), fold=True)
        if len(h) < SHINGLE:
            return []
        first = np.flatnonzero(doc[:-2] == doc[2:])
        value, row = spans_hash(h, first, SHINGLE), doc[first]
        hit = np.flatnonzero(member(value, self.known, self.bitmap))
        if not len(hit):
            return []
        n = len(texts)
        base = np.searchsorted(row, np.arange(n + 1))
        best: dict[tuple[int, int], float] = {}
        for width, (own, minima) in self.widths.items():
            block = (hit - base[row[hit]]) // width
            stride = int(block.max()) + 2
            window = np.unique(np.concatenate([row[hit] * stride + block, row[hit] * stride + np.maximum(block - 1, 0)]))
            owner, start = window // stride, (window % stride) * width + base[window // stride]
            length = np.minimum(base[owner + 1] - start, 2 * width)
            mins = self.minima(value[ranges(start, length)], np.cumsum(length) - length)
            for k, i in enumerate(own):
                for w in np.flatnonzero((mins == minima[k]).any(1)).tolist():
                    inside = value[start[w] : start[w] + length[w]]
                    share = float(np.isin(self.sets[i], inside).sum()) / len(self.sets[i])
                    if share >= self.containment:
                        key = (int(owner[w]), i)
                        best[key] = max(best.get(key, 0.0), share)
        return [(r, i, share) for (r, i), share in best.items()]


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for part in slices(whole):
                found = index.scan(part.column("text"))
                ids = part.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64()))
                yield pa.record_batch([ids, pa.array([index.names[i] for _, i, _ in found], pa.string()), pa.array([x for _, _, x in found], pa.float64())], ["doc_id", "license", "containment"])

    return run


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment) of every template found; see the module."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, containment))
    found = docs.mapInArrow(_find(index), "doc_id bigint, license string, containment double")
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def _sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    split = f"list_filter(regexp_split_to_array(lower(%s), '{FOLD_BREAK_SQL}'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT license, {split % "body"} AS w FROM (VALUES {rows}) v(license, body)),
sized AS (SELECT *, CASE WHEN len(w) - 2 <= 8 THEN 8 WHEN len(w) - 2 <= 16 THEN 16 WHEN len(w) - 2 <= 32 THEN 32 ELSE 64 END AS width FROM t),
ts AS (SELECT DISTINCT license, width, array_to_string(w[p + 1 : p + 3], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 2)) AS p FROM sized)),
n AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
d AS (SELECT doc_id, {split % "text"} AS w FROM documents WHERE doc_id IS NOT NULL),
ds AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 3], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) >= 3)),
hits AS (SELECT doc_id, license, g, unnest([p // width, greatest(p // width - 1, 0)]) AS win FROM ds JOIN ts USING (g)),
shares AS (SELECT doc_id, license, win, count(DISTINCT g) AS c FROM hits GROUP BY ALL)
SELECT doc_id, license, max(c / n) AS containment FROM shares JOIN n USING (license) WHERE c / n >= {CONTAINMENT} GROUP BY doc_id, license
"""


SQL = _sql()
