"""Matching and ranking: hits of each leaf of a query, BM25 over them.

An indexed document has, for each searchable field f, the stored text `<f>_source` and its tokens `<f>_tokens`, and `dl`, the number of all its tokens.
Leaf i of a query gives a column `_h<i>`, its hits by field, weighted. Two ways give the same columns:
`scan` counts in the token arrays; `from_postings` reads only the tokens it needs from a table (token, field, doc_id, positions) sorted by token.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyze import tokens_in, tokens_of
from ..plans.query import Group, Phrase, TextQuery

K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Leaf:
    tokens: tuple[str, ...]
    prefix: bool = False
    field: str | None = None


def leaves_of(query: TextQuery) -> list[Leaf]:
    """Leaves in order; a term's text is analysed as a document's is, so it may be a phrase of several tokens, or none."""
    if query is None:
        return []
    if isinstance(query, Group):
        return [leaf for child in query.children for leaf in leaves_of(child)]
    if isinstance(query, Phrase):
        return [Leaf(tuple(t for x in query.terms for t in tokens_of(x)), False, query.field)]
    return [Leaf(tuple(tokens_of(query.value)), query.prefix, query.field)]


def _hits(tokens: Column, leaf: Leaf) -> Column:
    """Hits of a leaf in one array of tokens. Plain terms need no lambda, which would end code generation."""
    n = len(leaf.tokens)
    if not n:
        return F.lit(0)
    if n == 1 and not leaf.prefix:
        return F.size(tokens) - F.size(F.array_remove(tokens, leaf.tokens[0]))
    if n == 1:
        return F.size(F.filter(tokens, lambda t: t.startswith(leaf.tokens[0])))

    # a lookahead counts overlapping places; a lambda over the array would analyse the text again for each of its tokens
    joined = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.regexp_count(joined, F.lit("(?= " + "  ".join(leaf.tokens) + ("" if leaf.prefix else " ") + ")"))


def scan(docs: DataFrame, leaves: list[Leaf], weights: dict[str, float], texts: dict[str, Column] | None = None) -> DataFrame:
    """docs with the hits of each leaf. texts: folded texts, where tokens are not stored; only texts that contain a leaf's tokens as strings are analysed."""
    columns = {}
    for i, leaf in enumerate(leaves):
        fields = [leaf.field] if leaf.field else list(weights)
        # in the branch itself: a column of tokens would be filled for every document
        hits = {f: _hits(tokens_in(texts[f]) if texts else F.col(f"{f}_tokens"), leaf) for f in fields}
        if texts and leaf.tokens:
            hits = {f: F.when(reduce(operator.and_, (texts[f].contains(t) for t in leaf.tokens)), h).otherwise(0) for f, h in hits.items()}
        columns[f"_h{i}"] = reduce(operator.add, (h * F.lit(weights[f]) for f, h in hits.items()))
    return docs.withColumns(columns)


def may_match(query: TextQuery, texts: dict[str, Column]) -> Column:
    """False only for documents that cannot match: a test on strings, before any analysis."""
    leaves = iter(leaves_of(query))

    def build(node: TextQuery) -> Column:
        if isinstance(node, Group):
            return reduce(operator.and_ if node.op == "and" else operator.or_, [build(c) for c in node.children])
        leaf = next(leaves)
        if not leaf.tokens:
            return F.lit(False)
        return reduce(operator.or_, (reduce(operator.and_, (texts[f].contains(t) for t in leaf.tokens)) for f in ([leaf.field] if leaf.field else texts)))

    return build(query)


def _shifted(by: int) -> Column:
    return F.transform("positions", lambda p: p - by)


def from_postings(postings: DataFrame, leaves: list[Leaf], weights: dict[str, float]) -> DataFrame | None:
    """(doc_id, _h0, ...) of the documents with a hit of any leaf. Postings are read once for all tokens."""
    if not any(leaf.tokens for leaf in leaves):
        return None
    weight = reduce(lambda c, f: c.when(F.col("field") == f, F.lit(weights[f])), weights, F)
    tests, columns, hits = [], [], []
    for i, leaf in enumerate(leaves):
        if not leaf.tokens:
            hits.append(F.lit(0))
            continue
        mine = []
        for k, token in enumerate(leaf.tokens):
            # several tokens may have the prefix
            test = F.col("token").startswith(token) if leaf.prefix and k == len(leaf.tokens) - 1 else F.col("token") == token
            mine.append(test & (F.col("field") == leaf.field) if leaf.field else test)
        tests += mine
        if len(mine) == 1:
            columns.append(F.sum(F.when(mine[0], F.size("positions"))).alias(f"p{i}"))
            hits.append(F.coalesce(F.col(f"p{i}"), F.lit(0)))
        else:
            columns += [F.flatten(F.collect_list(F.when(test, _shifted(k)))).alias(f"p{i}_{k}") for k, test in enumerate(mine)]
            hits.append(F.size(reduce(F.array_intersect, (F.col(f"p{i}_{k}") for k in range(len(mine))))))
    by_field = postings.where(reduce(operator.or_, tests)).groupBy("doc_id", "field").agg(*columns)
    found = by_field.select("doc_id", *((h * weight).cast("double").alias(f"_h{i}") for i, h in enumerate(hits)))
    if len(weights) > 1:
        found = found.groupBy("doc_id").agg(*(F.sum(f"_h{i}").alias(f"_h{i}") for i in range(len(leaves))))
    return found.where(reduce(operator.or_, (F.col(f"_h{i}") > 0 for i in range(len(leaves)))))


def postings_frame(docs: DataFrame, searchable: list[str]) -> DataFrame:
    """(token, field, doc_id, positions) of indexed documents."""
    # outer, as for the inner one Spark would first test whether there are tokens, and so analyse each text twice
    parts = [docs.select("doc_id", F.lit(f).alias("field"), F.posexplode_outer(f"{f}_tokens").alias("position", "token")).where("token is not null") for f in searchable]
    return reduce(DataFrame.unionByName, parts).groupBy("token", "field", "doc_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


#: Tokens whose postings are made at once, and rows of a batch of them; a longer document is taken alone.
SLICE_TOKENS, SLICE_ROWS = 1_000_000, 100_000
_POSTINGS = pa.schema([("token", pa.string()), ("field", pa.string()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])


def stored_postings(docs: DataFrame, searchable: list[str]) -> DataFrame:
    """The same rows as of `postings_frame`, from stored tokens. A document brings all positions of its tokens itself, so nothing is shuffled: each partition of
    documents gives its own postings, and no token is held by one task however many documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, f in enumerate(searchable):
                yield from _postings(batch.column(0), batch.column(k + 1), f)

    return docs.select("doc_id", *(f"{f}_tokens" for f in searchable)).mapInArrow(run, "token string, field string, doc_id long, positions array<int>")


def _postings(ids: pa.Array, tokens: pa.ListArray, field: str) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE_TOKENS, "right")))
        part = tokens.slice(first, last - first)
        sizes = np.diff(ends[first:last], prepend=ends[first - 1] if first else 0)
        words = part.flatten().dictionary_encode()
        if len(words):
            # codes in the order of tokens; the sort is stable, so that positions stay in theirs
            order = pc.sort_indices(words.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            row = np.repeat(np.arange(last - first), sizes)
            key = place[words.indices.to_numpy(zero_copy_only=False)] * (last - first) + row
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            by = np.argsort(key, kind="stable")
            key, at = key[by], at[by].astype(np.int32)
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            names = words.dictionary.take(order).take(pa.array(key[starts] // (last - first))).cast(pa.string())
            found = ids.take(pa.array(first + key[starts] % (last - first)))
            positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(at))
            for k in range(0, len(starts), SLICE_ROWS):
                n = min(SLICE_ROWS, len(starts) - k)
                yield pa.RecordBatch.from_arrays([names.slice(k, n), pa.repeat(pa.scalar(field), n), found.slice(k, n), positions.slice(k, n)], schema=_POSTINGS)
        first = last


def condition(query: TextQuery, leaves: list[Leaf]) -> Column:
    """The boolean tree over the leaves. A leaf without tokens matches nothing under `and`, and is passed over under `or`."""
    number = iter(range(len(leaves)))

    def build(node: TextQuery) -> Column:
        if isinstance(node, Group):
            return reduce(operator.and_ if node.op == "and" else operator.or_, [build(c) for c in node.children])
        return F.col(f"_h{next(number)}") > 0

    return build(query)


def counts_of(n: int) -> list[Column]:
    """_n0, ...: the documents with a hit of each leaf."""
    return [F.count(F.when(F.col(f"_h{i}") > 0, 1)).alias(f"_n{i}") for i in range(n)]


def statistics(hits: DataFrame, n: int) -> DataFrame:
    """(_rows, _dl, _n0.._nk) over the whole index."""
    return hits.agg(F.count("*").alias("_rows"), F.sum("dl").alias("_dl"), *counts_of(n))


def score(n: int, known: dict[str, int] | None = None) -> Column:
    """BM25 of the leaves, higher for better matches; _rows, _dl and _n<i> are statistics of the whole index, as columns or as known numbers."""

    def of(name: str) -> Column:
        return F.lit(float(known[name])) if known else F.col(name)

    norm = K1 * (1 - B + B * F.col("dl") / (of("_dl") / of("_rows")))
    total = F.lit(0.0)
    for i in range(n):
        idf = F.log((of("_rows") - of(f"_n{i}") + 0.5) / (of(f"_n{i}") + 0.5))
        f = F.col(f"_h{i}").cast("double")
        total = total + F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * (f * (K1 + 1) / (f + norm))
    return total
