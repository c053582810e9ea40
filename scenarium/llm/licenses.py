"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenarium.llm.textarrays import SPACE, Words, ragged, raw_bytes, shingles_of, slices, words_of

#: Words of a shingle, share of a template's shingles that a window must hold, and longest passage for a template.
SHINGLE, CONTAINMENT, STRETCH = 5, 0.8, 1.25
#: Windows begin every BLOCK words. A window that holds a template collides in a band with this probability at least.
BLOCK, COLLISION = 6, 1 - 1e-6
#: Bounds of a table of templates.
MOST_TEMPLATES, TEMPLATE_BYTES = 2000, 32 << 20

# The notices that are looked for.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mit-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-clauses": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "cc0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}


@dataclass
class Template:
    """codes: its distinct shingles; blocks: length of its windows; bands: one MinHash row each; low: its MinHashes."""

    name: str
    codes: np.ndarray
    blocks: int
    bands: int
    low: np.ndarray


_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def tokens_of(data: np.ndarray, off: np.ndarray) -> Words:
    """Runs of letters and digits, so that neither comment marks nor punctuation nor quotes of any style count.

    Signs are those of ASCII, U+0080-00BF and U+2000-2BFF (quotes, dashes, bullets, frames); all else is a letter.
    """
    sign = _SIGN[data]
    if len(data) and data.max() >= 0xC2:
        two = np.flatnonzero(data[:-1] == 0xC2)
        three = np.flatnonzero((data[:-1] == 0xE2) & (data[1:] < 0xB0))
        for at, length in ((two, 2), (three, 3)):
            for k in range(length):
                sign[at + k] = True
    return words_of(data, off, space=sign)


def _in_words(data: np.ndarray, off: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which word between white space, counted in its row, holds each byte ``at``."""
    start = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start[1:] &= SPACE[data[:-1]] | edge[1:-1]
    count = np.concatenate(([0], np.cumsum(start)))
    return count[at + 1] - 1 - count[off[row]]


def bands_for(words: int, blocks: int) -> int:
    """Bands of one row that give COLLISION at the least Jaccard similarity of a template and a window that holds it."""
    own, window = words - SHINGLE + 1, blocks * BLOCK - SHINGLE + 1
    least = CONTAINMENT * own / (max(window, own) + (1 - CONTAINMENT) * own)
    return 1 if least >= 1 else math.ceil(math.log(1 - COLLISION) / math.log(1 - least))


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _hash(codes: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    return ((codes * multiplier) >> np.uint64(33)).astype(np.uint32)


_NONE = np.uint32(2**32 - 1)


def templates_of(texts: dict[str, str]) -> list[Template]:
    """Templates of at least SHINGLE words; shorter ones can't be told from running text and are an error."""
    out = []
    for name, text in texts.items():
        words = tokens_of(*raw_bytes(pa.array([text])))
        n = len(words.code)
        if n < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        codes = np.unique(shingles_of(words, SHINGLE)[0][: n - SHINGLE + 1])
        blocks = -(-(math.ceil(n * STRETCH) + BLOCK - 1) // BLOCK)
        bands = bands_for(n, blocks)
        out.append(Template(name, codes, blocks, bands, np.array([_hash(codes, m).min() for m in _multipliers(bands)], np.uint32)))
    return out


def template_table(table: DataFrame) -> dict[str, str]:
    """Templates ``(license, text)`` from a table of MOST_TEMPLATES rows and TEMPLATE_BYTES at most; more are an error, nulls are left out."""
    rows = table.select(F.col("license").cast("string"), F.col("text").cast("string")).where("license is not null and text is not null")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    if size["n"] > MOST_TEMPLATES or (size["b"] or 0) > TEMPLATE_BYTES:
        raise ValueError(f"{size['n']} templates of {size['b']} bytes: at most {MOST_TEMPLATES} of {TEMPLATE_BYTES} are sent to every task")
    found = rows.distinct().collect()
    if len({r["license"] for r in found}) < len(found):
        raise ValueError("two templates have the same name")
    return {r["license"]: r["text"] for r in found}


def _grid(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as BLOCK rows by blocks, each text beginning a block; each block's text and first word."""
    count = np.diff(words.first)
    blocks = -(-count // BLOCK)
    code, whole = shingles_of(words, SHINGLE)
    row = np.repeat(np.arange(len(count)), blocks)
    begin = words.first[:-1][row] + BLOCK * (np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    at = begin[None, :] + np.arange(BLOCK)[:, None]
    inside = at < words.first[1:][row][None, :]
    at = np.minimum(at, max(0, len(code) - 1))
    return np.where(inside & whole[at], at, -1) if len(code) else np.zeros((BLOCK, 0), np.int64), row, begin


def _matches(words: Words, templates: list[Template]) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first word, word after the last), the best window of each."""
    grid, row, begin = _grid(words)
    if not grid.size:
        return []
    code, _ = shingles_of(words, SHINGLE)
    cells, off = code[np.maximum(grid, 0)], grid < 0
    seen: list[set[int]] = [set() for _ in templates]
    for band, multiplier in enumerate(_multipliers(max(t.bands for t in templates))):
        h = _hash(cells, multiplier)
        h[off] = _NONE
        low = h[0]
        for x in h[1:]:
            low = np.minimum(low, x)
        for size in {t.blocks for t in templates if band < t.bands}:
            window = low
            span = 1
            while span < size:  # the least of `size` blocks from each on, by doubling
                step = min(span, size - span)
                window = np.minimum(window, np.concatenate((window[step:], np.full(min(step, len(window)), _NONE, np.uint32))))
                span += step
            for t, template in enumerate(templates):
                if template.blocks == size and band < template.bands:
                    seen[t].update(np.flatnonzero(window == template.low[band]).tolist())
    out: dict[tuple[int, int], tuple[float, int, int]] = {}
    for t, template in enumerate(templates):
        if not seen[t]:
            continue
        at = np.array(sorted(seen[t]))
        first = begin[at]
        end = np.minimum(first + template.blocks * BLOCK, words.first[1:][row[at]])
        size = np.maximum(end - first - SHINGLE + 1, 0)
        place = np.searchsorted(template.codes, own := code[index := ragged(first, size)])
        hit = template.codes[np.minimum(place, len(template.codes) - 1)] == own
        pair = np.unique(np.stack([np.repeat(np.arange(len(at)), size)[hit], place[hit]]), axis=1)
        share = np.bincount(pair[0], minlength=len(at)) / len(template.codes)
        which, held = np.repeat(np.arange(len(at)), size)[hit], index[hit]  # windows in order, and words within them
        low, high = (np.searchsorted(which, np.arange(len(at)), side) for side in ("left", "right"))
        for i in np.flatnonzero(share >= CONTAINMENT).tolist():
            found = (float(share[i]), int(held[low[i]]), int(held[high[i] - 1]) + SHINGLE)
            key = (int(row[at[i]]), t)
            if key not in out or (found[0], -found[1]) > (out[key][0], -out[key][1]):
                out[key] = found
    return [(r, t, *out[r, t]) for r, t in sorted(out)]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """``(doc_id, license, containment, first_word, last_word)``: the notices that each whole text holds.

    ``texts`` are templates by name, or a table ``(license, text)`` of bounded size; else TEMPLATES. A notice is
    found where a window holds at least CONTAINMENT of its distinct 5-word shingles; a text gives one row for each
    notice, of several windows the one that holds most, then the first. Shingles are of letters and digits in lower case, without
    comment marks and punctuation; positions count words between white space. A null or empty text
    has none; repeated rows give their rows again; rows without doc_id keep the null; an empty table gives
    an empty result. There is no shuffle: the templates go to the texts.
    """
    chosen = templates_of(template_table(texts) if isinstance(texts, DataFrame) else TEMPLATES if texts is None else texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = raw_bytes(batch.column("text"))
            words = tokens_of(data, off)
            found = _matches(words, chosen) if chosen else []
            row = np.array([r for r, *_ in found], np.int64)
            first, last = (_in_words(data, off, row, words.start[[at(f) for f in found]]) if found else row for at in (lambda f: f[3], lambda f: f[4] - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array([chosen[t].name for _, t, *_ in found], pa.string()), pa.array([c for _, _, c, _, _ in found], pa.float64()), pa.array(first), pa.array(last + 1)],
                ["doc_id", "license", "containment", "first_word", "last_word"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, containment double, first_word long, last_word long")
