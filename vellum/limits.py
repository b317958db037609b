"""Limits on what a caller may ask."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import SearchError


@dataclass(frozen=True)
class Limits:
    max_query_length: int = 512
    max_terms: int = 32
    default_limit: int = 20
    max_limit: int = 100
    max_offset: int = 10_000
    max_facets: int = 10
    max_facet_values: int = 100
    max_filter_depth: int = 8
    max_filter_nodes: int = 64
    max_in_values: int = 100
    max_synonym_expansion: int = 64
    max_fuzzy_candidates: int = 200

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if type(value) is not int or value < (0 if f.name == "max_offset" else 1):
                raise SearchError("CONFIG_INVALID", f"{f.name} must be a positive integer", reason="limit", limit=f.name)
        if self.default_limit > self.max_limit:
            raise SearchError("CONFIG_INVALID", "default_limit is above max_limit", reason="limit", limit="default_limit")


@dataclass(frozen=True)
class TypoPolicy:
    max_candidates: int = 200
    max_terms: int = 4
    min_length: int = 3
    max_distance: int = 2
    grams_per_term: int = 24
    min_overlap: int = 1

    def __post_init__(self) -> None:
        for f in fields(self):
            if type(getattr(self, f.name)) is not int or getattr(self, f.name) < 0:
                raise SearchError("CONFIG_INVALID", f"{f.name} must be a whole number", reason="fuzzy-policy")
        if self.min_length < 3 or self.max_candidates < 1 or self.max_terms < 1:
            raise SearchError("CONFIG_INVALID", "typo policy out of bounds", reason="fuzzy-policy")
