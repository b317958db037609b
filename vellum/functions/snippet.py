"""Extracts of at most so many tokens around the hits of a query, by the rule of FTS5's snippet().

A window is worth 1000 for each leaf of the query that hits within it and 1 for each further hit. Tried are, for each hit in turn, the window whose hits stand in its middle, and the one that
begins with the hit's sentence, which is worth 100 more, or 120 at the head of the text; the first of the best ones is taken.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analyze import _TABLE

WIDTH = 16
Leaf = tuple[tuple[str, ...], bool]


def snippet(text: str, leaves: list[Leaf], start: str, end: str, ellipsis: str, width: int = WIDTH) -> str:
    """The best window with its hits marked; the head of the text where nothing hits."""
    places = [m.span() for m in regex.finditer(r"[\p{L}\p{N}\p{Co}\p{M}]+", text)]
    words = [regex.sub(rf"[^\p{{L}}\p{{N}}\p{{Co}}]", "", text[a:b].lower().translate(_TABLE)) for a, b in places]
    size = len(words)
    hits: list[tuple[int, int, int]] = []  # first token, leaf, tokens
    for number, (tokens, prefix) in enumerate(leaves):
        n = len(tokens)
        for k in range(size - n + 1 if n else 0):
            if words[k : k + n - 1] == list(tokens[:-1]) and (words[k + n - 1].startswith(tokens[-1]) if prefix else words[k + n - 1] == tokens[-1]):
                hits.append((k, number, n))
    hits.sort()
    sentences = [k for k, (a, _) in enumerate(places) if not k or text[:a].rstrip(" \t\n\r").endswith((".", ":"))]

    def worth(at: int) -> tuple[int, int]:
        """Of a window, and where it stands with its hits in the middle."""
        inside = [h for h in hits if at <= h[0] < at + width]
        leaves_hit = len({h[1] for h in inside})
        middle = inside[0][0] - int((width - (inside[-1][0] + inside[-1][2] - inside[0][0])) / 2)
        return 999 * leaves_hit + len(inside), max(0, min(middle, size - width))

    at, best = 0, 0
    for k, _, _ in hits:
        value, middle = worth(k)
        if value > best:
            at, best = middle, value
        head = sentences[max(0, bisect_right(sentences, k) - 1)]
        if size > width and head < k and (value := worth(head)[0] if any(head <= h[0] < head + width for h in hits) else 0) + (100 if head else 120) > best:
            at, best = head, value + (100 if head else 120)
    if not words:
        return text
    stop = min(size, at + width)
    merged: list[list[int]] = []
    for k, _, n in hits:
        if merged and k < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], k + n)
        else:
            merged.append([k, k + n])
    left = 0 if at == 0 else places[at][0]
    out, here = [], left
    for a, b in merged:
        if a >= at and a < stop:
            to = places[min(b, stop) - 1][1]
            out += [text[here : places[a][0]], start, text[places[a][0] : to], end]
            here = to
    if stop < size:
        return ("" if at == 0 else ellipsis) + "".join(out) + text[here : max(here, places[stop - 1][1])] + ellipsis
    return ("" if at == 0 else ellipsis) + "".join(out) + text[here:]


def snippet_column(text: Column, leaves: list[Leaf], start: str, end: str, ellipsis: str) -> Column:
    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: snippet(t, leaves, start, end, ellipsis) if t else None)

    return work(text)
