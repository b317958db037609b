"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 128 bits: signs of summed hash bits over its distinct lower-case words. Two documents are
near copies if their first 64 bits differ in at most TAU places and all 128 in at most TAU_ALL; a group is a connected
component of that relation.

Search is exact. The first 64 bits are regrouped into parts so that correlated bits share a part, and part i gets its own
threshold t_i with sum(t_i) = TAU - parts + 1: then any two fingerprints within TAU differ by at most t_i in some part i.
Number of parts and thresholds are chosen by dynamic programming on candidate counts that are estimated from the
fingerprints. A threshold t is probed from both sides: one fingerprint's variants within floor(t/2) of the part's value meet the
other's within ceil(t/2), so candidates are found by an equi-join on (part, value) and then verified by their distance.
Fingerprints that are equal are joined beforehand and take part once, so thousands of copies do not meet each other.

Defined results: null texts and texts without words have no fingerprint, are no near copies and stay alone; rows with a null doc_id are
left out of `groups` and stay in `deduplicated`; rows that share a doc_id are one document, kept or dropped together; the
smallest doc_id of a group is kept; other columns are ignored or returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import buffer, discard, mix, parts, run_hashes, shared_dir, sliced, small_side, text_of, words, written

TAU = 10
TAU_ALL = 24
BITS = 64
#: Fingerprints from which bit correlations and the skew of values are estimated; all others only scale the estimate.
ESTIMATE_ROWS = 20_000
#: Probe rows that one task of the join gets.
TASK_ROWS = 400_000
_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float32)
_ROW_COST, _PAIR_COST = 1.0, 0.01
_EDGE = ["a1", "a2", "b1", "b2"]


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x 2) uint64, and whether there was a word. Bit sums come from counts of byte values: a histogram of
    256 bins for each of the 16 hash bytes, times a table of signs."""
    docs = len(offsets) - 1
    starts, ends, which = words(raw, offsets)
    h = run_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        key = h + mix(which.astype(np.uint64) + np.uint64(1))  # distinct words of each document
    _, first = np.unique(key, return_index=True)
    h, which = h[first], which[first]
    out = np.zeros((docs, 2), np.uint64)
    for half, wide in enumerate((h, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
        for byte in range(8):
            value = ((wide >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            for low in range(0, docs, 4096):  # bounds the histograms
                here = slice(*np.searchsorted(which, [low, low + 4096])) if np.all(which[:-1] <= which[1:]) else None
                sel = (which >= low) & (which < low + 4096) if here is None else here
                n = min(4096, docs - low)
                count = np.bincount((which[sel] - low) * 256 + value[sel], minlength=n * 256).reshape(n, 256)
                bits = (count.astype(np.float32) @ _SIGNS) > 0
                out[low : low + n, half] |= (bits << np.arange(8)).sum(1).astype(np.uint64) << np.uint64(8 * byte)
    return out, np.bincount(which, minlength=docs) > 0


def _probes(width: int, radius: int) -> list[np.ndarray]:
    """Masks within half the radius, rounded down and up."""
    def ball(r: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for k in range(r + 1) for c in combinations(range(width), k)], np.uint64)

    return [ball(radius // 2), ball(radius - radius // 2)]


def _rows(width: int, radius: int) -> int:
    low = sum(comb(width, k) for k in range(radius // 2 + 1))
    return low if radius % 2 == 0 else low + sum(comb(width, k) for k in range(radius // 2 + 2))


def arrange(bits: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal size; each next bit joins the part with whose bits it correlates most."""
    with np.errstate(invalid="ignore"):  # bits that never change correlate with none
        c = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(np.float32)))) if len(bits) > 1 else np.zeros((BITS, BITS))
    np.fill_diagonal(c, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, out))) // (m - k)
        pool = sorted(left)
        part = [pool[int(np.argmax(c[np.ix_(pool, pool)].sum(1)))]]
        left.discard(part[0])
        while len(part) < size:
            pool = sorted(left)
            part.append(pool[int(np.argmax(c[np.ix_(pool, part)].sum(1)))])
            left.discard(part[-1])
        out.append(sorted(part))
    return out


def allocate(sample: np.ndarray, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """Parts with thresholds (-1: not probed) of least estimated cost for n fingerprints, given a sample of them."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    best, plan = None, []
    other = sample[np.random.default_rng(1).permutation(len(sample))]
    for m in range(1, tau + 2):
        groups, budget = arrange(bits, m), tau - m + 1
        costs = []
        for part in groups:
            mask = np.uint64(sum(1 << b for b in part))
            near = np.bitwise_count((sample ^ other) & mask) if len(sample) > 1 else np.zeros(0, int)
            # share of random pairs within t; where the sample has none, a binomial with the bits' mean disagreement
            p = float(np.clip(near.mean() / len(part), 0.02, 0.5)) if len(near) else 0.5
            cost = [0.0]
            for t in range(0, max(0, budget) + 1):
                if t > len(part) or t > 6:
                    cost.append(float("inf"))
                    continue
                share = max(float((near <= t).mean()) if len(near) else 0, sum(comb(len(part), k) * p**k * (1 - p) ** (len(part) - k) for k in range(t + 1)))
                meets = max(1, comb(t, t // 2))
                cost.append(_ROW_COST * n * _rows(len(part), t) + _PAIR_COST * meets * share * n * n / 2)
            costs.append(cost)
        # thresholds -1.. that sum to tau - m + 1; shifted by one they sum to tau + 1
        table = {0: (0.0, [])}
        for cost in costs:
            fresh: dict[int, tuple[float, list[int]]] = {}
            for total, (c, picks) in table.items():
                for t in range(-1, len(cost) - 1):
                    value = c + cost[t + 1]
                    if total + t + 1 <= tau + 1 and value < fresh.get(total + t + 1, (float("inf"), []))[0]:
                        fresh[total + t + 1] = (value, [*picks, t])
            table = fresh
        if tau + 1 in table and (best is None or table[tau + 1][0] < best):
            best, plan = table[tau + 1][0], list(zip(groups, table[tau + 1][1]))
    return plan


def _gather(x: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for k, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _root(label: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Ends of the chains of labels, which they are then shortened to."""
    at = label[i]
    while (up := label[at]).tobytes() != at.tobytes():
        at = up
    label[i] = at
    return at


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Gives connected rows the same root, the smallest."""
    while len(i):
        i, j = _root(label, i), _root(label, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))


def _edges(keys: np.ndarray, side: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key: rows that connect what is connected by verified pairs of rows with equal keys and
    fitting sides (0 meets 1; 2 meets itself). Pairs are united as they are verified, so memory follows the rows."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([bounds, [len(keys)]]))
    label = np.arange(len(keys))

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        d = np.bitwise_count(a[i] ^ a[j]).astype(np.int64)
        near = np.flatnonzero(d <= TAU)
        i, j, d = i[near], j[near], d[near]
        d = d + np.bitwise_count(b[i] ^ b[j])
        ok = (d <= TAU_ALL) & (d > 0) & ((side[i] == 2) | (side[i] != side[j]))
        _unite(label, i[ok], j[ok])

    order = np.argsort(-size, kind="stable")
    bounds, size = bounds[order], size[order]
    wide = size > 256
    for start, n in zip(bounds[wide].tolist(), size[wide].tolist()):
        for low in range(start, start + n, 256):
            block = np.arange(low, min(low + 256, start + n))
            mine = _root(label, block)
            for at in range(low, start + n, 4096):
                other = np.arange(at, min(at + 4096, start + n))
                if (mine == mine[0]).all():  # what is connected already need not meet
                    other = other[_root(label, other) != mine[0]]
                i, j = np.repeat(block, len(other)), np.tile(other, len(block))
                verify(i[i < j], j[i < j])
                mine = _root(label, block)
    # every row of a small bucket meets the ones behind it, distance by distance
    bounds, size = bounds[~wide], size[~wide]
    last = np.repeat(bounds + size, size)
    rows = np.repeat(bounds, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    for step in range(1, int(size.max()) if len(size) else 0):
        on = rows + step < last
        rows, last = rows[on], last[on]
        verify(rows, rows + step)
    # a spanning star instead of all pairs
    root = _root(label, np.arange(len(keys)))
    hit = np.flatnonzero(root != np.arange(len(keys)))
    return hit, root[hit]


def near_edges(prints: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect all near copies among rows (id, h1, h2) with distinct fingerprints."""
    spark = prints.sparkSession
    some = prints.select("h1").orderBy("h2").limit(ESTIMATE_ROWS).toPandas()["h1"].to_numpy(np.int64).view(np.uint64)
    plan = [(part, t) for part, t in allocate(some, max(n, 2)) if t >= 0]
    rows = n * sum(_rows(len(part), t) for part, t in plan)
    tasks = max(parts(spark), rows // TASK_ROWS + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(bits, t, _probes(len(bits), t)) for bits, t in plan]
        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for k, (bits, t, (low, high)) in enumerate(tables):
                value = _gather(a.view(np.uint64), bits)
                for side, masks in ((2, low),) if t % 2 == 0 else ((0, low), (1, high)):
                    for at in range(0, len(masks), 64):
                        some = masks[at : at + 64]
                        key = (mix((value[None, :] ^ some[:, None]) ^ np.uint64((k + 1) << 56))).ravel().view(np.int64)
                        again = [np.tile(x, len(some)) for x in (a, b)]
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), side, np.int8)), *map(pa.array, again)], ["key", "side", "h1", "h2"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if not held:
                return
            key, side, a, b = (np.concatenate([x[k] for x in held]) for k in range(4))
            cut = len(key) if last else int(np.searchsorted(key.view(np.int64), key[-1], "left"))
            if cut:
                left, right = _edges(key[:cut], side[:cut], a[:cut].view(np.uint64), b[:cut].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x[at]) for at in (left, right) for x in (a, b)], _EDGE)
            held, count = ([[x[cut:] for x in (key, side, a, b)]] if cut < len(key) else []), len(key) - cut

        for batch in batches:
            held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
            count += batch.num_rows
            if count > TASK_ROWS:
                yield from flush(False)
        yield from flush(True)

    # distinct fingerprints stand for their documents, so that a row of the shuffle need not hold an id
    probes = prints.select("h1", "h2").mapInArrow(probe, "key long, side byte, h1 long, h2 long")
    found = probes.repartition(int(tasks), "key").sortWithinPartitions("key").mapInArrow(join, ", ".join(f"{c} long" for c in _EDGE)).distinct()
    for side in ("a", "b"):
        own = small_side(prints.select(F.col("id").alias(side), F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2")), n)
        found = found.join(own, [f"{side}1", f"{side}2"])
    return found.select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, root): the smallest id of the connected component, for each id in the edges. Alternates large-star and
    small-star steps, which take a number of rounds logarithmic in a component's size."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, old = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        old, edges = edges, written(small.distinct(), "edges")
        discard(old)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, group_id, kept), one for each distinct doc_id in a group of two or more; group_id is the smallest of it."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            value, some = fingerprints(*buffer(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(value[:, k].view(np.int64), mask=~some) for k in (0, 1))], ["id", "h1", "h2"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.lower(text_of()).alias("text"))
    signed = written(source.mapInArrow(sign, "id long, h1 long, h2 long"), "prints")
    have = signed.where("h1 is not null")
    same = have.groupBy("h1", "h2").agg(F.min("id").alias("first"))
    prints = written(same.select(F.col("first").alias("id"), "h1", "h2"), "distinct")
    copies = have.join(prints.withColumnRenamed("id", "first"), ["h1", "h2"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    root = components(near_edges(prints, prints.count()).unionByName(copies))
    discard(signed, prints)
    members = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
    return members.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"), (F.col("id") == F.col("root")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group, with all their columns."""
    gone = written(groups(docs).where("not kept").select(F.col("doc_id").alias("_copy")), "copies")
    return docs.join(small_side(gone, gone.count()), docs["doc_id"] == gone["_copy"], "left_anti")
