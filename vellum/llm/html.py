"""Main text of HTML pages by line-block distribution.

Markup is stripped: comments, scripts, styles and the like go with their content, tags that end a block become line breaks, tags that part
sections (`nav`, `article`, `footer`, ...) become as many line breaks as a window has lines, other tags vanish, and character references are resolved.

Of the lines that are left, a window's length is the number of characters, blanks not counted, in WINDOW successive lines. A surge is the line at
which windows rise from nothing to more than SURGE before they are empty again; the dive that belongs to it is the next line from which
the window is empty. The text between is kept. Where no window is longer than SURGE, the longest stretch between empty windows is kept.

Defined results: null and empty pages, and pages without text, give an empty text and 0 blocks; each row is extracted, repeated
ones and ones with a null page_id too; unclosed scripts, styles and comments reach to the end, an unclosed head to the first text or tag that cannot stand in it, and of other
unclosed elements only the tag goes; a tag without its `>` is text; other columns are ignored. The time is linear in the length of a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import sliced

WINDOW = 3
SURGE = 130
_TOKEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z]\w*))")
_RAW = frozenset("script style".split())
_ELEMENTS = frozenset("noscript template svg select iframe textarea".split())
_SECTION = frozenset("nav header footer aside article main section form menu dialog body html".split())
_BLOCK = frozenset(
    """p div li ul ol dl dt dd h1 h2 h3 h4 h5 h6 br hr tr td th table thead tbody tfoot caption blockquote pre figure figcaption address fieldset legend details
    summary option title""".split()
)
_IN_HEAD = frozenset("meta link base".split())
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


class _Reader:
    """Steps through a page once. What a search from some place found, or that it found nothing, holds for all places from there to what it found, so no
    part is searched again and again and the time follows the length of the page, whatever is unclosed in it."""

    def __init__(self, html: str):
        self.html, self.known, self.no_head, self.no_end = html, {}, 0, len(html) + 1

    def _next(self, what: str, at: int, search) -> tuple[int, int]:
        """Begin and end of what is next; twice the length of the page where there is none."""
        low, span = self.known.get(what, (0, (-1, -1)))
        if not low <= at <= span[0]:
            span = search(at) or (2 * len(self.html) + 2,) * 2
            self.known[what] = at, span
        return span

    def end(self, at: int) -> int:
        """Behind the end of a tag; 0 where it has none."""
        found = self.html.find(">", at) + 1 if at < self.no_end else 0
        if not found:
            self.no_end = min(self.no_end, at)
        return found

    def close(self, name: str, at: int) -> int | None:
        """Behind the next end tag of that name."""

        def search(at: int) -> tuple[int, int] | None:
            found = re.compile(rf"</{name}\s*>", re.I).search(self.html, at)
            return found.span() if found else None

        end = self._next(name, at, search)[1]
        return end if end <= len(self.html) else None

    def dropped(self, m: re.Match, end: int, head: bool = False) -> int | None:
        """Where what goes with its content ends, if such a thing begins here with a tag that ends at `end`."""
        if m[0] == "<!--":
            found = self.html.find("-->", m.end())
            return found + 3 if found >= 0 else len(self.html)
        if not end or m[1]:
            return None
        if not m[2]:
            return end
        name = m[2].lower()
        if name in _RAW:
            return self.close(name, end) or len(self.html)
        if name == "svg" and self.html[end - 2] == "/":
            return end
        if name in _ELEMENTS or head and name == "title":
            return self.close(name, end)
        return None

    def head(self, at: int) -> int:
        """Where a head ends whose tag ends here: behind its end tag, if that comes before <body>, else at what cannot stand in a head."""
        begin, html = at, self.html
        while begin >= self.no_head and (m := _TOKEN.search(html, at)):
            if (end := self.dropped(m, self.end(m.end()), True)) is not None and m[0][1] != "?" and (m[0] == "<!--" or m[0][1] != "!"):
                at = end
                continue
            name = (m[2] or "").lower()
            if name == "head" and m[1]:
                at = m.end()
                while at < len(html) and html[at].isspace():
                    at += 1
                if at < len(html) and html[at] == ">":
                    return at + 1
                break
            if name == "body" and not m[1]:
                break
            at = m.end()
        else:
            m = None
        self.no_head = max(self.no_head, m.start() if m else len(html))
        at = begin
        while True:
            while at < len(html) and html[at].isspace():
                at += 1
            if not (m := _TOKEN.match(html, at)):
                return at
            end = self.end(m.end())
            found = self.dropped(m, end, True)
            if found is None and (m[1] or not end or (m[2] or "").lower() not in _IN_HEAD):
                return at
            at = end if found is None else found


def lines_of(html: str, window: int = WINDOW) -> list[str]:
    html = html.replace("\0", "")
    reader, out, run, at, begin, after = _Reader(html), [], [], 0, 0, False

    def flush(strip: bool = False) -> bool:
        """Ends a text that no tag parts; blanks next to a tag that ends a block are part of that."""
        text = "".join(run)
        text = text.lstrip() if after else text
        text = text.rstrip() if strip else text
        run.clear()
        out.append(text)
        return bool(text)

    while m := _TOKEN.search(html, at):
        end = reader.end(m.end())
        name = (m[2] or "").lower()
        if (found := reader.dropped(m, end)) is not None:
            run += [html[begin : m.start()], "\n"]
            end = found
        elif not name or not end:
            at = m.end()
            continue
        elif name == "head" and not m[1]:
            end = reader.head(end)
            run += [html[begin : m.start()], "\n"]
        else:
            run.append(html[begin : m.start()])
            if name in _BLOCK:
                if flush(True) or not after:
                    out.append("\n")
                after = True
            else:
                flush()
                out.append("\n" * (window + 1) if name in _SECTION else "")
                after = False
        at = begin = end
    run.append(html[begin:])
    flush()
    return [_BLANKS.sub(" ", line).strip() for line in unescape("".join(out)).split("\n")]


def stretches(length: np.ndarray, window: int, surge: int) -> list[tuple[int, int]]:
    """Lines (from, to) of the texts between a surge and its dive."""
    n = len(length)
    total = np.concatenate([[0], np.cumsum(length)])
    block = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    # maximal runs of windows that are not empty; the dive is the line from which the window is empty
    on = np.concatenate([[False], block > 0, [False]])
    begin, end = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    found = []
    for a, b in zip(begin.tolist(), end.tolist()):
        if block[a:b].max() > surge:
            found.append((a, b))
    if not found and len(begin):
        size = total[end] - total[begin]
        k = int(np.argmax(size))
        found.append((int(begin[k]), int(end[k])))
    return found


def extract(html: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[str, int, int]:
    """Text, number of stretches, characters of the lines that were left out."""
    lines = lines_of(html or "", window)
    length = np.array([len(x.replace(" ", "")) for x in lines], np.int64)
    found = stretches(length, window, surge)
    kept = [lines[k] for a, b in found for k in range(a, b) if lines[k]]
    return "\n".join(kept), len(found), int(length.sum() - sum(length[a:b].sum() for a, b in found))


def extracted(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Rows (page_id, text, n_blocks, n_dropped)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            rows = [extract(x, window, surge) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["page_id", "text", "n_blocks", "n_dropped"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(work, "page_id long, text string, n_blocks int, n_dropped long")
