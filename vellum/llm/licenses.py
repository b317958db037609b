"""Licence scans: passages of a text against licence templates by the Dice coefficient of their word bigrams.

Passages are compared at three grains: paragraphs (parted by empty lines), lines, and sentences (parted by a `.`, `!` or `?`
with a blank behind it, or by a line break). So that notices wrapped over several lines are whole with any line ends and comment marks, there are
two grains more: paragraphs parted by lines without a word (lines then end at LF, CRLF or CR), and the sentences of these across line
breaks. A passage of these two counts unless one that it shares words with gives the same licence with a coefficient as high. Normalised, a passage is its lower-case words. For the sets A and B of bigrams
of a passage and a template, Dice is 2|A and B| / (|A| + |B|). A passage belongs to the licence of the template
with the highest coefficient, if that is THRESHOLD or more; of equal ones to the first by name.

Size bounds prune: a coefficient of t needs |A| between t / (2 - t) and (2 - t) / t times |B|, and at least t / 2 (|A| + |B|)
common bigrams. Passages that have too few bigrams of any template, counted with repeats, are dropped by two cumulative sums over the
whole slice; the few that are left get their sets, and of the templates only those within the bounds.

Defined results: null and empty texts, and passages of fewer than two words, hold no licence; rows with a null doc_id are not reported;
rows that share a doc_id count as one document; a passage that is repeated in a document, or is the same at several grains,
counts once; other columns are ignored. Not found: a short wrapped notice that stands in one sentence with as many other words, such as a title line right before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import IS_WORD, buffer, mix, run_hashes, sliced, text_of, words

THRESHOLD = 0.75
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True

#: (licence, normalised template). Notices by which works are put under a licence, and the paragraphs that name its grant.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]


def normal(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())


def bigrams(text: list[str]) -> set[tuple[str, str]]:
    return set(zip(text, text[1:]))


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    begin, end, doc = words(raw, offsets)
    h = run_hashes(raw, begin, end)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    return begin, end, doc, pair


@lru_cache(maxsize=4)
def _templates(rows: tuple[tuple[str, str], ...]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    names, sets = [], []
    for name, text in sorted(set(rows)):
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        grams = np.unique(_hashes(raw, np.array([0, len(raw)]))[3])
        if len(grams):
            names.append(name)
            sets.append(grams)
    return names, sets, np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)


def passages(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each grain, where its passages begin, with an end."""
    line = raw == 10
    breaks = np.flatnonzero(line) + 1
    empty = breaks[1:][breaks[1:] - breaks[:-1] == 1] if len(breaks) > 1 else breaks[:0]
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    sentence = np.flatnonzero(stop[:-1] & (raw[1:] == 32)) + 1 if len(raw) else breaks
    return [np.unique(np.concatenate([offsets, x])) for x in (empty, breaks, np.concatenate([breaks, sentence]))]


def wrapped(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The same for the two grains whose passages run across line breaks."""
    line = (raw == 10) | (raw == 13) & (np.append(raw[1:], 0) != 10)
    starts = np.unique(np.concatenate([offsets, np.flatnonzero(line) + 1]))
    upto = np.concatenate([[0], np.cumsum(IS_WORD[raw])])
    paragraph = np.unique(np.concatenate([offsets, starts[:-1][upto[starts[1:]] == upto[starts[:-1]]]]))
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    return [paragraph, np.unique(np.concatenate([paragraph, np.flatnonzero(stop[:-1] & _SPACE[raw[1:]]) + 1]))]


def find(raw: np.ndarray, offsets: np.ndarray, rows: tuple[tuple[str, str], ...], least: float) -> list[tuple[int, str, float, bytes]]:
    """(document, licence, Dice, passage) of a buffer of lower-case texts."""
    names, sets, every = _templates(rows)
    begin, end, doc, pair = _hashes(raw, offsets)
    if len(begin) < 2 or not names:
        return []
    smallest = min(map(len, sets))
    # bigrams that some template has, up to each word
    known = np.minimum(np.searchsorted(every, pair), len(every) - 1)
    some = np.concatenate([[0], np.cumsum(every[known] == pair)])
    seen: set[tuple[int, int, int]] = set()
    held: list[tuple[int, int, int, str, float]] = []
    across: list[tuple[int, int, int, str, float]] = []
    plain = passages(raw, offsets)
    for grain, cuts in enumerate([*plain, *wrapped(raw, offsets)]):
        first = np.searchsorted(begin, cuts)
        low, high = first[:-1], first[1:] - 1  # bigrams of words low..high
        on = high - low >= np.ceil(least / (2 - least) * smallest - 1e-9)
        low, high = low[on], high[on]
        # t / 2 (|A| + |B|) with the smallest |A| that the bounds admit is t / (2 - t) |B|
        on = some[high] - some[low] >= least / (2 - least) * smallest - 1e-9
        for a, b in zip(low[on].tolist(), high[on].tolist()):
            if (d := int(doc[a]), a, b) in seen:
                continue
            seen.add((d, a, b))
            grams = np.unique(pair[a:b])
            best = None
            for name, template in zip(names, sets):
                n, m = len(grams), len(template)
                if not least / (2 - least) * m - 1e-9 <= n <= (2 - least) / least * m + 1e-9:
                    continue
                dice = 2 * len(np.intersect1d(grams, template, assume_unique=True)) / (n + m)
                if dice >= least - 1e-12 and (best is None or dice > best[0] or dice == best[0] and name < best[1]):
                    best = dice, name
            if best:
                (held if grain < len(plain) else across).append((d, a, b, best[1], best[0]))
    places: dict[tuple[int, str], list[tuple[int, int, float]]] = {}
    for d, a, b, name, dice in held:
        places.setdefault((d, name), []).append((a, b, dice))
    for d, a, b, name, dice in sorted(across, key=lambda x: (-x[4], x[:4])):
        near = places.setdefault((d, name), [])
        if not any(x <= b and a <= y and other >= dice for x, y, other in near):
            near.append((a, b, dice))
            held.append((d, a, b, name, dice))
    return [(d, name, dice, b" ".join(raw[begin[k] : end[k]].tobytes() for k in range(a, b + 1))) for d, a, b, name, dice in held]


def licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, license, dice, n_passages): the highest coefficient, and the number of distinct passages."""
    rows = tuple(templates)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column(0).to_pylist()
            found = find(*buffer(batch.column(1)), rows, threshold)
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, *_ in found], pa.int64()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.float64()), pa.array([x[3].decode() for x in found], pa.string())], ["doc_id", "license", "dice", "passage"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_of()).alias("text"))
    found = source.mapInArrow(search, "doc_id long, license string, dice double, passage string")
    # only what was found is shuffled
    return found.groupBy("doc_id", "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.count_distinct("passage").alias("n_passages"))
