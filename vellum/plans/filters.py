"""Filters and tenant scopes: trees that are checked, then become one Column."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codecs import FieldType, encode
from ..errors import SearchError
from ..limits import Limits

_COMPARE = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_OPS = {*_COMPARE, "in", "not_in", "is_null", "is_not_null", "and", "or", "not"}


@dataclass(frozen=True)
class Filter:
    op: str
    field: str | None = None
    values: tuple[object, ...] = ()
    children: tuple["Filter", ...] = ()


@dataclass(frozen=True)
class Scope:
    """Equalities that the application binds; a user's filter cannot hold or widen them."""

    values: tuple[tuple[str, object], ...]


def _compare(op: str):
    def build(field: str, value: object) -> Filter:
        return Filter(op, field, (value,))

    build.__name__ = op
    return build


eq, neq, gt, gte, lt, lte = map(_compare, ("eq", "neq", "gt", "gte", "lt", "lte"))


def in_list(field: str, values: list[object]) -> Filter:
    return Filter("in", field, tuple(values))


def not_in(field: str, values: list[object]) -> Filter:
    return Filter("not_in", field, tuple(values))


def is_null(field: str) -> Filter:
    return Filter("is_null", field)


def is_not_null(field: str) -> Filter:
    return Filter("is_not_null", field)


def and_(*children: Filter) -> Filter:
    return Filter("and", children=children)


def or_(*children: Filter) -> Filter:
    return Filter("or", children=children)


def not_(child: Filter) -> Filter:
    return Filter("not", children=(child,))


def between(field: str, low: object, high: object) -> Filter:
    return and_(gte(field, low), lte(field, high))


def _bad(reason: str) -> SearchError:
    return SearchError("FILTER_INVALID", "the filter cannot be used", reason=reason)


def is_filter(node: object) -> bool:
    return isinstance(node, Filter) and node.op in _OPS


def check_filter(node: object, fields: dict[str, FieldType], limits: Limits = Limits()) -> None:
    """Raises unless the tree is within limits, and names declared fields with values of their types."""
    count = 0

    def walk(node: object, depth: int) -> None:
        nonlocal count
        count += 1
        if isinstance(node, Scope):
            raise SearchError("SCOPE_INVALID", "a filter cannot hold a scope", reason="scope-in-filter")
        if not is_filter(node):
            raise _bad("unknown-node")
        if depth > limits.max_filter_depth or count > limits.max_filter_nodes:
            raise SearchError("QUERY_LIMIT_EXCEEDED", "the filter is too large", reason="max-filter-depth" if depth > limits.max_filter_depth else "max-filter-nodes")
        if node.op in ("and", "or", "not"):
            if not node.children or node.op == "not" and len(node.children) != 1:
                raise _bad("children")
            for child in node.children:
                walk(child, depth + 1)
            return
        if not isinstance(node.field, str) or node.field not in fields:
            raise _bad("undeclared-field")
        if node.op in ("in", "not_in"):
            if not node.values:
                raise _bad("empty-list")
            if len(node.values) > limits.max_in_values:
                raise SearchError("QUERY_LIMIT_EXCEEDED", "the list is too long", reason="max-in-values")
        for value in node.values:
            encode(fields[node.field], value)

    walk(node, 1)


def filter_column(node: Filter, fields: dict[str, FieldType]) -> Column:
    """SQL's three-valued logic: a null never matches a comparison, nor its negation."""
    if node.op in ("and", "or"):
        return reduce(operator.and_ if node.op == "and" else operator.or_, (filter_column(c, fields) for c in node.children))
    if node.op == "not":
        return ~filter_column(node.children[0], fields)
    column = F.col(node.field)
    if node.op == "is_null":
        return column.isNull()
    if node.op == "is_not_null":
        return column.isNotNull()
    values = [F.lit(encode(fields[node.field], v)).cast(fields[node.field].spark) for v in node.values]
    if node.op in ("in", "not_in"):
        return column.isin(*values) if node.op == "in" else ~column.isin(*values)
    return _COMPARE[node.op](column, values[0])


def bind_scope(values: dict[str, object]) -> Scope:
    if not isinstance(values, dict) or not values:
        raise SearchError("SCOPE_INVALID", "a scope binds at least one field", reason="empty-scope")
    return Scope(tuple(values.items()))


def joined_scope(*scopes: Scope | None) -> Scope | None:
    """All equalities together: contradictions match nothing."""
    values = tuple(v for s in scopes if s for v in s.values)
    return Scope(values) if values else None


def scope_column(scope: Scope, fields: dict[str, FieldType]) -> Column:
    if not isinstance(scope, Scope) or not scope.values or any(f not in fields for f, _ in scope.values):
        raise SearchError("SCOPE_INVALID", "a scope binds declared fields", reason="undeclared-field")
    return reduce(operator.and_, (F.col(f) == F.lit(encode(fields[f], v)).cast(fields[f].spark) for f, v in scope.values))
