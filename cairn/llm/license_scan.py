"""Operator 9: license scan by MinHash bands over overlapping text windows.

Texts are cut into overlapping windows of 3-word shingles, one series for each
size class c = 2, 4, 8, ... of templates: a window has 2c shingles and the next
one starts c further, so a template of s <= c shingles lies whole in some window.
Each window has ``BANDS`` bands of one minimum each.  A window that holds 0.8 of
a template with s > c / 2 has a Jaccard likeness of at least
0.8 s / (2c + 0.2 s) > 0.19 with it, so one of 48 bands agrees with probability
over 0.9999.  What the bands retrieve is verified
exactly: the share of the template's distinct shingles that the window holds.

Cases: null and empty texts match nothing; texts of any length are scanned
whole; texts shorter than a shingle match only a template of exactly those
words; repeated rows are scanned each; a text that holds 0.8 of several notices (they
may differ in a version only) is reported for each, ``containment`` tells which is
whole.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import text_of, words

SHINGLE, BANDS = 3, 48
#: Bits of a minimum that a table tells at once.
TABLE_BITS = 12

#: License notices; fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    "Zlib-notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


SEEDS = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of three words, from the words' hashes."""
    if len(codes) < SHINGLE:
        return _mix(codes[:1] * np.uint64(3) + codes.sum(dtype=np.uint64) + np.uint64(len(codes))) if len(codes) else codes
    n = len(codes) - SHINGLE + 1
    h = _mix(codes[:n])
    for j in range(1, SHINGLE):
        h = _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + codes[j : j + n])
    return h


def bands(h: np.ndarray) -> np.ndarray:
    """(BANDS, n): each shingle under each permutation."""
    return (h[None, :] * SEEDS[:, None]) >> np.uint64(32)


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names, self.sets, self.size, self.text = [], [], [], []
        for name, text in texts.items():
            w = words(text)
            if w:
                self.names.append(name)
                self.sets.append(np.unique(shingles(np.array([xxhash.xxh3_64_intdigest(x) for x in w], dtype=np.uint64))))
                self.size.append(max(1, len(w) - SHINGLE + 1))
        self.by_class = []  # (class, index of its templates' bands), by doubling up to the largest template
        low, c = 0, 2
        while low < max(self.size, default=0):
            self.by_class.append((c, Index({i: bands(self.sets[i]).min(axis=1) for i, s in enumerate(self.size) if low < s <= c})))
            low, c = c, 2 * c


class Index:
    """Band and minimum -> templates; a small table of the minima's lowest bits passes over what no template has."""

    def __init__(self, least: dict[int, np.ndarray]):
        self.table = np.zeros(BANDS << TABLE_BITS, dtype=bool)
        band = np.arange(BANDS, dtype=np.uint64)
        key = np.concatenate([np.zeros(0, np.uint64), *(band << np.uint64(32) | row for row in least.values())])
        owner = np.repeat(np.fromiter(least, dtype=np.int64, count=len(least)), BANDS)
        for row in least.values():
            self.table[(band << np.uint64(TABLE_BITS) | row & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.owners, self.edges = owner[order], np.concatenate([first, [len(key)]])

    def retrieve(self, window: np.ndarray) -> dict[int, list[int]]:
        """Template -> windows, columns of ``window``, that agree with it in a band."""
        if not len(self.keys):
            return {}
        low = (window & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int32)
        low += (np.arange(BANDS, dtype=np.int32) << TABLE_BITS)[:, None]
        band, at = np.nonzero(self.table[low])
        key = band.astype(np.uint64) << np.uint64(32) | window[band, at]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[place] == key
        found: dict[int, set[int]] = {}
        for p, w in zip(place[same].tolist(), at[same].tolist(), strict=True):
            for i in self.owners[self.edges[p] : self.edges[p + 1]].tolist():
                found.setdefault(i, set()).add(w)
        return {i: sorted(w) for i, w in found.items()}


def _halve(x: np.ndarray) -> np.ndarray:
    """Minima of neighbouring columns; an odd last one stands alone."""
    even, odd = x[:, ::2], x[:, 1::2]
    out = even.copy()
    np.minimum(out[:, : odd.shape[1]], odd, out=out[:, : odd.shape[1]])
    return out


def scan_text(h: np.ndarray, known: Templates, min_containment: float) -> list[tuple]:
    """(template, containment, first shingle of the window) for the best window of each template."""
    best: dict[int, tuple] = {}
    block = bands(h)
    for c, index in known.by_class:
        block = _halve(block)  # minima of c shingles; two neighbours are a window
        window = block.copy()
        np.minimum(window[:, :-1], block[:, 1:], out=window[:, :-1])
        for i, places in index.retrieve(window).items():
            target = known.sets[i]
            for w in places:
                share = float(np.isin(target, h[w * c : w * c + 2 * c]).mean())
                if share >= min_containment and (i not in best or share > best[i][0]):
                    best[i] = (share, w * c)
    return [(known.names[i], s, at) for i, (s, at) in sorted(best.items())]


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, min_containment: float = 0.8) -> DataFrame:
    """(doc_id, license, containment, first_word): the licenses that each document holds."""
    texts = TEMPLATES if templates is None else templates
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64())])

    def run(batches):
        known, code = Templates(texts), {}
        for batch in batches:
            got = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words(text)
                if not w:
                    continue
                if len(code) > 500_000:
                    code.clear()
                for x in w:
                    if x not in code:
                        code[x] = xxhash.xxh3_64_intdigest(x)
                h = shingles(np.fromiter(map(code.__getitem__, w), dtype=np.uint64, count=len(w)))
                # long texts in pieces that overlap by the largest window, so memory stays bounded
                step, over = 50_000, 2 * max((c for c, *_ in known.by_class), default=1)
                found: dict[str, tuple] = {}
                for a in range(0, len(h), step):
                    for name, share, at in scan_text(h[a : a + step + over], known, min_containment):
                        if name not in found or share > found[name][0]:
                            found[name] = (share, a + at)
                got += [(doc, name, share, at) for name, (share, at) in found.items()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, license string, containment double, first_word long")
