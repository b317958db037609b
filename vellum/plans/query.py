"""Text queries: terms and phrases under `and` or `or`. Nothing that a user types can become an operator."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from ..errors import SearchError
from ..functions.normalize import normalize_text
from ..limits import Limits


@dataclass(frozen=True)
class Term:
    value: str
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    field: str | None = None


@dataclass(frozen=True)
class Group:
    op: str  # and, or
    children: tuple[object, ...]


TextQuery = Term | Phrase | Group | None


def _in(*ranges: tuple[int, int]) -> frozenset[str]:
    return frozenset(chr(c) for a, b in ranges for c in range(a, b + 1))


BLANK = _in((9, 13), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Characters that never part a term, also at its start.
JOINED = _in((0x300, 0x36F), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED), (0x8D3, 0x8E1), (0x8E3, 0x8FF), (0xFE70, 0xFE7F))
PARTING = BLANK | frozenset("!#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") | frozenset("،؛؟٪«»‘’“”…‹›、。，．：；？")


def _tokens(text: str) -> list[Term | Phrase]:
    out: list[Term | Phrase] = []
    for k, piece in enumerate(pieces := text.split('"')):
        words, word = [], ""
        for c in piece + " ":
            if c in JOINED or c not in PARTING:
                word += c
            elif word:
                words.append(word)
                word = ""
        if k % 2 == 0:
            out += map(Term, words)
        elif k == len(pieces) - 1:
            raise SearchError("QUERY_INVALID", "a quote is not closed", reason="unclosed-phrase")
        elif not words:
            raise SearchError("QUERY_INVALID", "a phrase is empty", reason="empty-phrase")
        else:
            out.append(Phrase(tuple(words)))
    return out


def parse_query(text: str, strategy: str = "all", limits: Limits = Limits(), min_prefix: int = 2) -> TextQuery:
    if not isinstance(text, str) or "\0" in text:
        raise SearchError("QUERY_INVALID", "a query is text without NUL", reason="nul")
    if len(text) > limits.max_query_length:
        raise SearchError("QUERY_LIMIT_EXCEEDED", "the query is too long", reason="max-query-length")
    found = _tokens(text)
    if sum(len(t.terms) if isinstance(t, Phrase) else 1 for t in found) > limits.max_terms:
        raise SearchError("QUERY_LIMIT_EXCEEDED", "the query has too many terms", reason="max-terms")
    if strategy == "last-prefix" and found and isinstance(found[-1], Term) and len(found[-1].value) >= min_prefix:
        found[-1] = replace(found[-1], prefix=True)
    if len(found) < 2:
        return found[0] if found else None
    return Group("or" if strategy == "any" else "and", tuple(found))


def parse_index_query(text: str, profiles: tuple[str, ...], strategy: str, limits: Limits) -> TextQuery:
    """Bounds hold for the text as typed and as normalised."""
    if isinstance(text, str) and len(text) > limits.max_query_length:
        raise SearchError("QUERY_LIMIT_EXCEEDED", "the query is too long", reason="max-query-length")
    return parse_query(normalize_text(text, profiles) if isinstance(text, str) else text, strategy, limits)


def synonym_key(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def expand_synonyms(query: TextQuery, synonyms: dict[str, tuple[str, ...]], limits: Limits = Limits()) -> TextQuery:
    """Each term with synonyms becomes an `or` of itself and them, one level deep; phrases stay."""
    table: dict[str, list[str]] = {}
    for key, values in synonyms.items():
        table.setdefault(synonym_key(key), []).extend(values)
    used = 0

    def expand(node: TextQuery) -> TextQuery:
        nonlocal used
        if isinstance(node, Group):
            return Group(node.op, tuple(map(expand, node.children)))
        if not isinstance(node, Term):
            return node
        distinct = {synonym_key(node.value): node} | {}
        for value in table.get(synonym_key(node.value), ()):
            distinct.setdefault(synonym_key(value), replace(node, value=value))
        used += len(distinct) - 1
        if used > limits.max_synonym_expansion:
            raise SearchError("QUERY_LIMIT_EXCEEDED", "too many synonyms", reason="max-synonym-expansion")
        return Group("or", tuple(distinct.values())) if len(distinct) > 1 else node

    return expand(query)


def terms_of(query: TextQuery) -> list[str]:
    """Terms and the words of phrases, in order."""
    if isinstance(query, Group):
        return [t for child in query.children for t in terms_of(child)]
    return list(query.terms) if isinstance(query, Phrase) else [query.value] if query else []


def looks_like_operator(term: str) -> bool:
    return term.upper() in {"AND", "OR", "NOT", "NEAR", "NOTAND", "MATCH"} or bool(re.search(r"[*():^]", term))
