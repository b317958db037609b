"""Index definitions: what is searched, filtered, sorted and counted."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .codecs import FieldType, field_type
from .errors import SearchError
from .functions.normalize import check_profiles, normalize_text

_INDEX = re.compile(r"[a-z][a-z0-9_]{0,47}")
_FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,63}")
_RESERVED = {"doc_id", "source_id", "rowid", "rank"}
_WORDS = {"and", "or", "not", "near"}
STRATEGIES = ("all", "any", "last-prefix")


@dataclass(frozen=True)
class Source:
    """A table with one key column, of type string or safe-integer."""

    name: str
    key: str
    key_type: str = "string"


def table(name: str, key: str, key_type: str = "string") -> Source:
    if not _FIELD.fullmatch(name) or not _FIELD.fullmatch(key) or key_type not in ("string", "safe-integer"):
        raise _bad("a source is a table name, a key column and a key type", "source")
    return Source(name, key, key_type)


@dataclass(frozen=True)
class IndexDefinition:
    name: str
    mode: str
    source: Source | None
    searchable: dict[str, float]
    filterable: dict[str, FieldType]
    sortable: dict[str, FieldType]
    facets: tuple[str, ...]
    normalization: tuple[str, ...]
    prefix: tuple[int, ...]
    typo: str
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    strategy: str = "all"

    @property
    def projected(self) -> dict[str, FieldType]:
        """Typed columns of a document, filterable ones first."""
        return self.filterable | {k: v for k, v in self.sortable.items() if k not in self.filterable}

    @property
    def key(self) -> str:
        return self.source.key if self.source else "id"

    @property
    def id_kind(self) -> str:
        return self.source.key_type if self.source else "string"


def _bad(message: str, reason: str) -> SearchError:
    return SearchError("CONFIG_INVALID", message, reason=reason)


def define_index(
    name: str,
    *,
    searchable: dict[str, float] | list[str],
    mode: str = "linked",
    source: Source | None = None,
    filterable: dict[str, object] | None = None,
    sortable: dict[str, object] | None = None,
    facets: list[str] = (),
    normalization: list[str] = (),
    prefix: list[int] = (),
    typo: str = "off",
    synonyms: dict[str, list[str]] | None = None,
    strategy: str = "all",
) -> IndexDefinition:
    weights = dict(searchable) if isinstance(searchable, dict) else dict.fromkeys(searchable, 1.0)
    typed = [{k: field_type(v) for k, v in (given or {}).items()} for given in (filterable, sortable)]
    if not isinstance(name, str) or not _INDEX.fullmatch(name):
        raise _bad("index names are lower-case identifiers", "index-name")
    if mode not in ("linked", "manual") or mode == "linked" and source is None:
        raise _bad("a linked index needs a source", "mode")
    if not weights:
        raise _bad("an index searches at least one field", "searchable")
    for f in (*weights, *typed[0], *typed[1]):
        if not isinstance(f, str) or not _FIELD.fullmatch(f) or f.lower() in _RESERVED or f in weights and f.lower() in _WORDS:
            raise _bad(f"field name {f!r} cannot be used", "field-name")
    if any(isinstance(w, bool) or not isinstance(w, (int, float)) or not math.isfinite(w) or w <= 0 for w in weights.values()):
        raise _bad("weights are finite and above 0", "weight")
    for f in set(typed[0]) & set(typed[1]):
        if typed[0][f] != typed[1][f]:
            raise _bad(f"{f} has two types", "field-type")
    if any(f == f"{s}_source" for f in (*typed[0], *typed[1]) for s in weights):
        raise _bad("a typed field is named like a stored text", "field-name")
    if any(f not in typed[0] and f not in typed[1] for f in facets):
        raise _bad("facets must be filterable or sortable", "facet")
    if any(type(p) is not int or not 1 <= p <= 8 for p in prefix):
        raise _bad("prefix lengths are 1 to 8", "prefix")
    if typo not in ("off", "fallback") or strategy not in STRATEGIES:
        raise _bad("unknown typo mode or matching strategy", "mode")
    profiles = check_profiles(list(normalization))
    known: dict[str, tuple[str, ...]] = {}
    for key, values in (synonyms or {}).items():
        row = [normalize_text(x, profiles) if isinstance(x, str) else "" for x in (key, *values)]
        if not all(x.strip() for x in row) or len(row) < 2:
            raise _bad("synonyms are texts", "synonym")
        known[row[0]] = (*known.get(row[0], ()), *row[1:])
    return IndexDefinition(name, mode, source, {k: float(v) for k, v in weights.items()}, *typed, tuple(dict.fromkeys(facets)), profiles, tuple(prefix), typo, known, strategy)


def define_index_from(df: DataFrame, name: str, *, source: Source, filterable: list[str] = (), sortable: list[str] = (), **rest: object) -> IndexDefinition:
    """A definition whose field types are those of the table's columns. Timestamps must be turned into numbers first."""

    def kind(column: str) -> str:
        if column not in df.columns:
            raise _bad(f"the table has no column {column}", "source-column")
        t = df.schema[column].dataType
        for kind, types in {"text": (T.StringType,), "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "number": (T.FloatType, T.DoubleType), "boolean": (T.BooleanType,)}.items():
            if isinstance(t, types):
                return kind
        raise _bad(f"column {column} of type {t.simpleString()} cannot be indexed", "source-column-type")

    if kind(source.key) != ("text" if source.key_type == "string" else "integer"):
        raise _bad("the key column has another type", "source-key")
    return define_index(name, source=source, filterable={c: kind(c) for c in filterable}, sortable={c: kind(c) for c in sortable}, **rest)


def canonical(value: object) -> str:
    """JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def logical_hash(d: IndexDefinition) -> str:
    """Field order counts; the order of synonym keys does not."""
    x = asdict(d)
    for k in ("searchable", "filterable", "sortable"):
        x[k] = list(x[k].items())
    return hashlib.sha256(canonical(x).encode()).hexdigest()


def manifest(d: IndexDefinition) -> dict[str, object]:
    """What the stored tables depend on. Weights, synonyms and the strategy are applied when a query runs."""
    return {
        "version": 2, "backend": "spark", "mode": d.mode, "source": asdict(d.source) if d.source else None, "searchable": list(d.searchable), "normalization": list(d.normalization),
        "projected": [[k, asdict(v)] for k, v in d.projected.items()], "typo": d.typo, "prefix": list(d.prefix),
    }


def physical_hash(d: IndexDefinition) -> str:
    return hashlib.sha256(canonical(manifest(d)).encode()).hexdigest()


def classify_change(old: dict[str, object], new: dict[str, object]) -> str:
    """runtime-only, migration-only (typed columns were added), rebuild-required, or unsupported (another backend made the tables)."""
    if canonical(old) == canonical(new):
        return "runtime-only"
    if old.get("backend") != new.get("backend"):
        return "unsupported"
    if canonical({k: v for k, v in old.items() if k != "projected"}) == canonical({k: v for k, v in new.items() if k != "projected"}):
        return "migration-only"
    return "rebuild-required"
