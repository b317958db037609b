"""Application search and corpus processing on PySpark DataFrames."""

__version__ = "0.2.0"

from .definition import IndexDefinition, define_index, define_index_from, logical_hash, physical_hash, table
from .engine import Handle, SearchEngine
from .errors import SearchError
from .limits import Limits, TypoPolicy
from .plans.filters import and_, between, bind_scope, eq, gt, gte, in_list, is_not_null, is_null, lt, lte, neq, not_, not_in, or_
from .plans.query import Group, Phrase, Term, looks_like_operator, parse_query
from .plans.request import Highlight, Request, asc, desc, relevance

__all__ = """IndexDefinition define_index define_index_from logical_hash physical_hash table Handle SearchEngine SearchError Limits TypoPolicy and_ between
bind_scope eq gt gte in_list is_not_null is_null lt lte neq not_ not_in or_ Group Phrase Term looks_like_operator parse_query Highlight Request asc desc relevance""".split()
