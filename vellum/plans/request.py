"""What a search is asked for besides its text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..definition import IndexDefinition
from ..errors import SearchError
from ..limits import Limits
from .filters import Filter, Scope


@dataclass(frozen=True)
class Sort:
    field: str | None  # None: relevance
    descending: bool = False


def asc(field: str) -> Sort:
    return Sort(field)


def desc(field: str) -> Sort:
    return Sort(field, True)


def relevance() -> Sort:
    return Sort(None, True)


@dataclass(frozen=True)
class Highlight:
    fields: tuple[str, ...]
    start: str = "**"
    end: str = "**"
    ellipsis: str = "…"

    def check(self, definition: IndexDefinition) -> None:
        if not self.fields or any(f not in definition.searchable for f in self.fields):
            raise SearchError("QUERY_INVALID", "highlighted fields must be searchable", reason="highlight-field")
        if any(not isinstance(m, str) or len(m) > 16 or "\0" in m for m in (self.start, self.end, self.ellipsis)):
            raise SearchError("QUERY_INVALID", "markers have at most 16 characters", reason="highlight-marker")


@dataclass(frozen=True)
class Request:
    filter: Filter | None = None
    scope: Scope | None = None
    sort: tuple[Sort, ...] = ()
    limit: int | None = None
    offset: int = 0
    facets: tuple[str, ...] = ()
    total: bool = False
    hydrate: bool | Callable[[list], dict] = False  # or a function of the page's ids to their documents
    highlight: Highlight | None = None
    diagnostics: bool = False
    cancelled: Callable[[], bool] | None = field(default=None, compare=False)

    def page(self, limits: Limits) -> tuple[int, int]:
        limit = limits.default_limit if self.limit is None else self.limit
        for name, value, low, high in (("limit", limit, 1, limits.max_limit), ("offset", self.offset, 0, limits.max_offset)):
            if type(value) is not int or not low <= value <= high:
                raise SearchError("QUERY_LIMIT_EXCEEDED", f"{name} is out of bounds", reason=f"max-{name}")
        return limit, self.offset

    def order(self, definition: IndexDefinition, has_text: bool) -> tuple[Sort, ...]:
        for s in self.sort:
            if s.field is None and not has_text:
                raise SearchError("QUERY_INVALID", "nothing is relevant to an empty query", reason="empty-relevance")
            if s.field is not None and s.field not in definition.sortable:
                raise SearchError("QUERY_INVALID", "the sort field is not declared", reason="undeclared-sort")
        return self.sort or ((relevance(),) if has_text else ())

    def check_facets(self, definition: IndexDefinition, limits: Limits) -> tuple[str, ...]:
        names = tuple(dict.fromkeys(self.facets))
        if len(names) > limits.max_facets:
            raise SearchError("QUERY_LIMIT_EXCEEDED", "too many facets", reason="max-facets")
        if any(f not in definition.facets for f in names):
            raise SearchError("QUERY_INVALID", "the facet is not declared", reason="undeclared-facet")
        return names

    def go_on(self) -> None:
        if self.cancelled and self.cancelled():
            raise SearchError("QUERY_INVALID", "the search was cancelled", reason="aborted")
