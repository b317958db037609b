"""Benchmark decontamination by Wu-Manber multi-pattern search.

An item leaks into a document if the document holds a run of `span` consecutive words of the item, or the whole
item where it is shorter. Words are compared in lower case and without what stands between them.

The patterns are the distinct word runs of all items. A table of shifts, indexed by a hash of the last BLOCK bytes of
the current window, tells how far the search may jump without missing an occurrence; where it says 0, the bucket
of patterns with that suffix hash is tested by direct comparison. Many places of a text are searched in lock step, so
that a jump is one vector operation for all of them. No jump is longer than the shortest pattern, so patterns have a table for each class of lengths, and
one short item does not slow the search for the long ones; below CLASSES[-1] bytes, where jumps are short anyway, a window is tried where a word begins.

The pattern tables are broadcast in groups of at most GROUP_BYTES of pattern text; larger benchmarks take more passes.

Defined results: null and empty texts hold nothing and no item leaks into them; items that are null or without words
never leak; rows with a null doc_id are not reported; rows that share a doc_id count as one document, whose distinct
runs are counted together; items with the same text or item_id are each reported once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import IS_WORD, buffer, ranges, sliced, small_side, strings, text_of, written

SPAN = 13
BLOCK = 8
TABLE_BITS = 20
#: Least lengths of the classes of patterns.
CLASSES = (1, 8, 16, 32)
GROUP_BYTES = 4 << 20
_LANE = 1024
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalized(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one space between words, and where each document starts in them. A newline stands before each
    document and at the end, so that nothing reaches across; text is expected in lower case."""
    n, docs = len(raw), len(offsets) - 1
    wide = np.full(n + docs + 1, 10, np.uint8)
    owner = np.repeat(np.arange(docs), np.diff(offsets))
    wide[np.arange(n) + owner + 1] = raw
    breaks = offsets + np.arange(docs + 1)
    word = IS_WORD[wide]
    keep = word.copy()
    keep[1:] |= word[:-1]
    out = np.where(word, wide, np.uint8(32))
    keep[breaks] = True
    out[breaks] = 10
    place = np.cumsum(keep) - 1
    return out[keep], place[breaks]


class Tables:
    """Patterns by classes of length."""

    def __init__(self, patterns: list[bytes]):
        kind = np.searchsorted(CLASSES, [len(p) for p in patterns], "right")
        self.classes = [(np.flatnonzero(kind == k), Patterns([patterns[i] for i in np.flatnonzero(kind == k)])) for k in np.unique(kind)]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers of all occurrences in normalised text that begin and end with a word."""
        found = [(at, number[which]) for number, table in self.classes for at, which in [table.find(text)]]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([f[k] for f in found] for k in (0, 1)))


class Patterns:
    """Shift table and suffix buckets of byte patterns that consist of words parted by single spaces."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.least = max(1, min(map(len, patterns), default=1))
        # blocks no longer than the shortest pattern
        self.block = min(BLOCK, self.least)
        self.mask = np.uint64(2 ** (8 * self.block) - 1)
        most = self.least - self.block + 1
        self.shift = np.full(1 << TABLE_BITS, most, np.int32)
        lengths = np.array([len(p) for p in patterns], np.int64)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.raw = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        for back in range(most):  # distance of the block's end from the end of the first `least` bytes
            at = self.starts + (self.least - self.block - back)
            np.minimum.at(self.shift, self.hashes(self.raw, at), back)
        suffix = self.hashes(self.raw, self.starts + self.least - self.block)
        order = np.argsort(suffix, kind="stable")
        self.order, self.keys = order, suffix[order]

    def hashes(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """raw has eight bytes more than any place `at` needs."""
        wide = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes() if not raw.flags.c_contiguous else raw, strides=(1,))
        with np.errstate(over="ignore"):
            return (((wide[at] & self.mask) * _MULT) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As that of Tables."""
        n, none = len(text), np.zeros(0, np.int64)
        if n < self.least or not self.patterns:
            return none, none
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        wide = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        tail, down, found = self.least - self.block, np.uint64(64 - TABLE_BITS), []
        if self.least < CLASSES[-1]:
            word = IS_WORD[text]
            at = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
            at = at[at <= n - self.least]
            stop = at + 1
        else:  # each lane owns the window starts from `at` to `stop`
            at = np.arange(0, n - self.least + 1, _LANE)
            stop = np.minimum(at + _LANE, n - self.least + 1)
        with np.errstate(over="ignore"):
            while len(at):
                jump = self.shift[(((wide[at + tail] & self.mask) * _MULT) >> down).astype(np.int64)]
                if (hit := jump == 0).any():
                    found.append(at[hit])
                    jump[hit] = 1
                at = at + jump
                if not (on := at < stop).all():
                    at, stop = at[on], stop[on]
        if not found:
            return none, none
        at = np.concatenate(found)
        # an occurrence begins a word
        at = at[(at == 0) | ~IS_WORD[text[at - 1]]]
        key = self.hashes(padded, at + tail)
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        which = self.order[ranges(low, high - low)]
        at = np.repeat(at, high - low)
        end = at + self.lengths[which]
        ok = end <= n
        ok[ok] = ~IS_WORD[padded[end[ok]]]
        at, which = at[ok], which[ok]
        for skip in range(0, int(self.lengths.max()), 8):  # direct comparison, eight bytes at a time
            left = self.lengths[which] - skip
            some = left > 0
            pattern = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))[(self.starts[which] + skip)[some]]
            differ = pattern ^ wide[np.minimum(at + skip, n)[some]]
            differ &= np.uint64(2**64 - 1) >> (8 * np.maximum(0, 8 - left[some])).astype(np.uint64)
            same = np.ones(len(at), bool)
            same[some] = differ == 0
            at, which = at[same], which[same]
            if not len(at):
                break
        return at, which


def patterns_of(items: list[tuple[int, str]], span: int) -> dict[bytes, list[int]]:
    """Distinct word runs with the items that hold them."""
    out: dict[bytes, dict[int, None]] = {}
    for item, text in items:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = normalized(raw, np.array([0, len(raw)]))[0].tobytes().split()
        for k in range(max(1, len(words) - span + 1) if words else 0):
            out.setdefault(b" ".join(words[k : k + span]), {})[item] = None
    return {p: list(who) for p, who in out.items()}


def _groups(runs: dict[bytes, list[int]]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for pattern in runs:
        if group and size + len(pattern) > GROUP_BYTES:
            yield group
            group, size = [], 0
        group.append(pattern)
        size += len(pattern)
    if group:
        yield group


def leaks(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """Rows (doc_id, item_id, n_runs): the document holds n_runs distinct word runs of the benchmark item."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_runs long"
    items = benchmark.where("item_id is not null").select("item_id", F.lower(text_of()).alias("text")).distinct()
    runs = patterns_of([tuple(r) for r in items.toLocalIterator()], span)
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text_of()).alias("text"))
    found = None
    for group in _groups(runs):
        shared = spark.sparkContext.broadcast((group, [runs[p] for p in group]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            group, owners = shared.value
            table = Tables(group)
            for batch in sliced(batches):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                text, begins = normalized(*buffer(batch.column(1)))
                at, which = table.find(text)
                if not len(at):
                    continue
                doc = np.searchsorted(begins, at, "right") - 1
                pairs = np.unique(np.stack([ids[doc], which], 1), axis=0)
                rows = [(d, item, group[p]) for d, p in pairs.tolist() for item in owners[p]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].decode() for r in rows], pa.string())], ["doc_id", "item_id", "run"])

        part = source.mapInArrow(search, "doc_id long, item_id long, run string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema)
    # few rows: only what was found is shuffled; the set of distinct runs makes repeated rows count once
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("run").alias("n_runs"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents into which no item leaks, with all their columns. Rows with a null doc_id stay."""
    bad = written(leaks(docs, benchmark, span).select(F.col("doc_id").alias("_leaky")).distinct(), "leaks")
    return docs.join(small_side(bad, bad.count()), docs["doc_id"] == bad["_leaky"], "left_anti")
