"""A search as one lazy plan over an index's documents, and its response."""

from __future__ import annotations

import operator
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..definition import IndexDefinition
from ..functions.analyze import folded, n_tokens, tokens
from ..functions.normalize import normalize_column
from ..functions.snippet import snippet_column
from ..errors import SearchError
from ..limits import Limits, TypoPolicy
from ..operators import facets as facet_ops
from ..operators import fuzzy
from ..operators.match import Leaf, condition, counts_of, from_postings, leaves_of, may_match, scan, score, statistics
from .filters import check_filter, filter_column, scope_column
from .query import TextQuery, expand_synonyms, parse_index_query
from .request import Highlight, Request


def index_frame(df: DataFrame, definition: IndexDefinition, doc_id: Column | None = None) -> DataFrame:
    """Documents of an index over a table: doc_id, source_id, stored texts, tokens, dl and typed columns. Where doc_id is not given, the key is it, as the order
    of documents is that of keys."""
    key = F.col(definition.key).cast("long" if definition.id_kind == "safe-integer" else "string")
    texts = {f"{f}_source": F.col(f).cast("string") for f in definition.searchable}
    typed = {f: F.col(f).cast(t.spark) for f, t in definition.projected.items()}
    docs = df.select((key if doc_id is None else doc_id).alias("doc_id"), key.alias("source_id"), *(c.alias(n) for n, c in texts.items()), *(c.alias(n) for n, c in typed.items()))
    return analyzed(docs, definition)


def _normal(f: str, definition: IndexDefinition) -> Column:
    return normalize_column(F.coalesce(F.col(f"{f}_source"), F.lit("")), definition.normalization)


def analyzed(docs: DataFrame, definition: IndexDefinition) -> DataFrame:
    """docs with tokens of the stored texts and their number."""
    columns = {f"{f}_tokens": tokens(_normal(f, definition)) for f in definition.searchable}
    total = F.lit(0)
    for f in definition.searchable:
        total = total + n_tokens(_normal(f, definition))
    return docs.withColumns(columns | {"dl": total.cast("long")})


@dataclass(frozen=True)
class Index:
    """What a search reads: documents, and where they are stored, postings, grams, and the numbers of documents and of their tokens."""

    definition: IndexDefinition
    docs: DataFrame
    postings: DataFrame | None = None
    grams: DataFrame | None = None
    size: tuple[int, int] | None = None


@dataclass
class Response:
    """Lazy tables; `rows()`, `total` and the like run them."""

    hits: DataFrame
    limit: int
    offset: int
    matched: DataFrame
    total_of: DataFrame | None
    facets: dict[str, DataFrame]
    stats: DataFrame | None
    warnings: list[str] = field(default_factory=list)
    hook: Callable[[dict], None] | None = None
    exact: DataFrame | None = None
    near: DataFrame | None = None
    cancelled: Callable[[], bool] | None = None
    hydrator: Callable[[list], dict] | None = None
    started: float = field(default_factory=time.monotonic)

    def go_on(self) -> None:
        """Raises where the caller has given up; asked before each job."""
        if self.cancelled and self.cancelled():
            raise SearchError("QUERY_INVALID", "the search was cancelled", reason="aborted")

    @cached_property
    def _page(self) -> list:
        """Near spellings are looked for only where exact hits do not fill the page."""
        self.go_on()
        need = self.offset + self.limit + 1
        rows = self.exact.orderBy("rank").collect()
        if self.near is not None and len(rows) < need:
            self.go_on()
            more = self.near.orderBy("rank").limit(need - len(rows)).collect()
            rows += [Row(**(r.asDict() | {"rank": len(rows) + k + 1})) for k, r in enumerate(more)]
        rows = rows[self.offset :]
        if self.hook:
            self.hook({"hits": min(len(rows), self.limit), "seconds": time.monotonic() - self.started})
        return rows

    def rows(self) -> list[dict]:
        """Hits with their documents, if asked for; a hydrator of the application gets the ids of the page once, in order, and hits that it has nothing for get None."""
        rows = [r.asDict(recursive=True) for r in self._page[: self.limit]]
        if self.hydrator:
            self.go_on()
            known = self.hydrator([r["id"] for r in rows])
            rows = [r | {"document": known.get(r["id"])} for r in rows]
        return rows

    def ids(self) -> list:
        return [r["id"] for r in self._page[: self.limit]]

    @property
    def has_more(self) -> bool:
        return len(self._page) > self.limit

    @property
    def fuzzy_used(self) -> bool:
        return any(r["fuzzy"] for r in self._page[: self.limit])

    @cached_property
    def total(self) -> int | None:
        self.go_on()
        return self.total_of.first()["total"] if self.total_of is not None else None

    def facet(self, name: str) -> list[tuple]:
        self.go_on()
        return [(r["value"], r["count"]) for r in self.facets[name].collect()]

    def facet_stats(self) -> dict[str, tuple]:
        self.go_on()
        row = self.stats.first() if self.stats is not None else None
        names = [c[:-4] for c in self.stats.columns if c.endswith("_min")] if row else []
        return {n: (row[f"{n}_min"], row[f"{n}_max"]) for n in names if row[f"{n}_min"] is not None}

    def meta(self) -> dict:
        """Never holds values or texts."""
        used = self.fuzzy_used
        notes = [w for w in self.warnings if w != "highlight-unavailable-fuzzy" or used]
        return {"backend": "spark", "fuzzy_used": used, "warnings": notes}


def _visible(definition: IndexDefinition, request: Request, limits: Limits) -> Column | None:
    """Scope, then filter; None where all is seen."""
    parts = []
    if request.scope is not None:
        parts.append(scope_column(request.scope, definition.projected))
    if request.filter is not None:
        check_filter(request.filter, definition.filterable, limits)
        parts.append(filter_column(request.filter, definition.filterable))
    return reduce(operator.and_, parts) if parts else None


#: Hits of stored postings up to which documents are read by their ids, and up to which hits are broadcast to the documents (three numbers or so each).
BY_ID, BROADCAST_HITS = 1_000, 200_000


def ranked(index: Index, query: TextQuery) -> DataFrame:
    """All matches of a text query with `score`, before scope and filter. Statistics are those of the whole index. Where postings are stored, a first job counts
    hits, from the row groups that hold the query's tokens: so the plan knows how many documents there are to read, and reads no others."""
    definition, leaves = index.definition, leaves_of(query)
    weights, n = definition.searchable, len(leaves_of(query))
    if index.postings is None:
        texts = {f: folded(_normal(f, definition)) for f in weights}
        stats = statistics(scan(index.docs, leaves, weights, texts), n)
        hits = scan(index.docs.where(may_match(query, texts)), leaves, weights, texts).where(condition(query, leaves))
        # one row of numbers: a broadcast of it does not grow with the data
        return hits.crossJoin(F.broadcast(stats)).withColumn("score", score(n))
    found = from_postings(index.postings, leaves, weights)
    if found is None:
        return index.docs.where(F.lit(False)).withColumn("score", F.lit(0.0))
    if index.size is None:
        # postings that are made from texts as they are read: some numbers a hit are kept, or made again where an executor is lost
        found = found.persist()
    rows, dl = index.size or tuple(index.docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
    some, docs = found.limit(BY_ID + 1).collect(), index.docs
    if len(some) <= BY_ID:
        counts = [sum(r[f"_h{i}"] > 0 for r in some) for i in range(n)]
        found = docs.sparkSession.createDataFrame(some, found.schema)
        docs = docs.where(F.col("doc_id").isin([r["doc_id"] for r in some]))
    else:
        *counts, size = found.agg(*counts_of(n), F.count("*")).first()
        found = F.broadcast(found) if size <= BROADCAST_HITS else found
    known = {"_rows": max(rows, 1), "_dl": max(dl, 1), **{f"_n{i}": c for i, c in enumerate(counts)}}
    return docs.join(found.where(condition(query, leaves)), "doc_id").withColumn("score", score(n, known))


def plan(index: Index, query: TextQuery, request: Request, limits: Limits = Limits(), fallback: bool = False, policy: TypoPolicy = TypoPolicy(), hook: Callable[[dict], None] | None = None) -> Response:
    definition = index.definition
    request.go_on()
    limit, offset = request.page(limits)
    order = request.order(definition, query is not None)
    names = request.check_facets(definition, limits)
    warnings = []
    if request.highlight:
        request.highlight.check(definition)
        if query is None:
            warnings.append("highlight-unavailable-empty-query")
    visible = _visible(definition, request, limits)
    every = ranked(index, query) if query is not None else index.docs.withColumn("score", F.lit(None).cast("double"))
    matched = every if visible is None else every.where(visible)
    keys = [(F.col("score").desc() if s.field is None else F.col(s.field).desc_nulls_last() if s.descending else F.col(s.field).asc_nulls_first()) for s in order]
    # exact hits in their order, then typo hits by distance; each side brings no more than the page can need
    exact = matched.withColumns({"fuzzy": F.lit(False), "distance": F.lit(0)})
    need = offset + limit + 1
    place = F.row_number().over(Window.orderBy(*keys, "doc_id"))
    near = None
    if fallback and query is not None and definition.typo == "fallback":
        terms, wanted = fuzzy.query_terms(query, definition.normalization, policy)
        if wanted:
            request.go_on()
            fields, leaves = list(definition.searchable), leaves_of(query)
            found = fuzzy.candidates(index.docs, visible, wanted, fields, definition.normalization, min(policy.max_candidates, limits.max_fuzzy_candidates), index.grams)
            # exact hits among the few candidates are told by their tokens
            found = scan(found, leaves, definition.searchable).where(~condition(query, leaves))
            near = fuzzy.survivors(found, terms, wanted, fields, definition.normalization, policy).withColumns({"score": F.lit(None).cast("double"), "fuzzy": F.lit(True)})
            if request.highlight:
                warnings.append("highlight-unavailable-fuzzy")
    texts = [f"{f}_source" for f in definition.searchable] if request.hydrate is True or request.highlight else []
    columns = ["doc_id", "source_id", "score", "fuzzy", *texts, *definition.projected]
    shown = [F.col("rank"), F.col("source_id").alias("id"), "score", "fuzzy"]
    if request.hydrate is True:
        shown.append(F.struct(F.col("source_id").alias(definition.key), *(F.col(f"{f}_source").alias(f) for f in definition.searchable), *(F.col(c) for c in definition.projected if c not in definition.searchable and c != definition.key)).alias("document"))
    if request.highlight and query is not None:
        shown.append(_formatted(request.highlight, definition, leaves_of(query)))
    top = exact.orderBy(*keys, "doc_id").limit(need).withColumn("rank", place).select("rank", *columns)
    tail, page = None, top
    if near is not None:
        tail = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "doc_id"))).select("rank", *columns)
        # all exact hits come first; where the page reaches beyond them, they all are in top
        page = top.unionByName(tail).withColumn("rank", F.row_number().over(Window.orderBy("fuzzy", "rank")))
    page = page.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit + 1))
    pieces = [matched, *([near] if near is not None else [])]
    total = None
    if request.total:
        total = pieces[0].select("doc_id").unionByName(pieces[-1].select("doc_id")) if near is not None else matched
        total = total.agg(F.count("*").alias("total"))
    facets = {}
    for f in names:
        parts = [facet_ops.distribution(p, f, limits.max_facet_values) for p in pieces]
        facets[f] = parts[0] if near is None else facet_ops.merged(parts)
    numeric = [f for f in names if definition.projected[f].numeric]
    both = matched.select(*numeric) if near is None else matched.select(*numeric).unionByName(near.select(*numeric))
    return Response(page.select(*shown), limit, offset, matched, total, facets, facet_ops.ranges(both, numeric) if numeric else None, warnings, hook, top.select(*shown), tail.select(*shown) if tail is not None else None, request.cancelled, request.hydrate if callable(request.hydrate) else None)


def _formatted(h: Highlight, definition: IndexDefinition, leaves: list[Leaf]) -> Column:
    marks = []
    for f in dict.fromkeys(h.fields):
        mine = [(leaf.tokens, leaf.prefix) for leaf in leaves if leaf.field in (None, f)]
        text = snippet_column(_normal(f, definition), mine, h.start, h.end, h.ellipsis)
        marks.append(F.when(~F.col("fuzzy"), text).alias(f))
    return F.struct(*marks).alias("formatted")


def search(index: Index, text: str, request: Request = Request(), limits: Limits = Limits(), policy: TypoPolicy = TypoPolicy(), hook: Callable[[dict], None] | None = None) -> Response:
    """Parses, expands synonyms, matches, ranks, filters, pages, and falls back to near spellings."""
    definition = index.definition
    query = parse_index_query(text, definition.normalization, definition.strategy, limits)
    return plan(index, expand_synonyms(query, definition.synonyms, limits), request, limits, True, policy, hook)


def search_raw(index: Index, query: TextQuery, request: Request = Request(), limits: Limits = Limits()) -> Response:
    """A tree built by the application, with fields and nested groups; no parsing, synonyms or typo fallback."""
    for leaf in leaves_of(query):
        if leaf.field is not None and leaf.field not in index.definition.searchable:
            raise SearchError("QUERY_INVALID", "the field is not searchable", reason="undeclared-field")
    return plan(index, query, request, limits)


def hydrate(hits: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Hits (rank, id, ...) with the columns of a source table; hits whose row is gone stay, with nulls."""
    return hits.join(table, hits["id"] == table[key], "left").orderBy("rank")
