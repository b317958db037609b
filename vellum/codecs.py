"""Field kinds: which Python values they take, and the Spark types that hold them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import SearchError

SAFE = 2**53 - 1
_KINDS = {"text": "text", "integer": "safe-integer", "safe-integer": "safe-integer", "number": "finite-real", "finite-real": "finite-real", "boolean": "boolean-integer", "boolean-integer": "boolean-integer"}
_SPARK = {"text": T.StringType(), "safe-integer": T.LongType(), "finite-real": T.DoubleType(), "boolean-integer": T.BooleanType(), "timestamp-integer": T.LongType()}
_UNITS = ("unix-seconds", "unix-milliseconds")


@dataclass(frozen=True)
class FieldType:
    kind: str
    unit: str | None = None

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.kind]

    @property
    def numeric(self) -> bool:
        return self.kind in ("safe-integer", "finite-real", "timestamp-integer")


def field_type(given: object) -> FieldType:
    if isinstance(given, FieldType):
        return given
    if isinstance(given, str) and given in _KINDS:
        return FieldType(_KINDS[given])
    if isinstance(given, dict) and given.get("kind") == "timestamp-integer" and given.get("unit") in _UNITS:
        return FieldType("timestamp-integer", given["unit"])
    raise SearchError("CONFIG_INVALID", "unknown field type", reason="field-type")


def encode(kind: FieldType, value: object) -> object:
    """The value as it is compared and stored; an error for all that the kind does not take."""

    def no(reason: str) -> SearchError:
        return SearchError("VALUE_INVALID", f"value does not fit {kind.kind}", reason=reason)

    if value is None:
        raise no("null")
    if kind.kind == "text":
        if not isinstance(value, str):
            raise no("type")
        return value
    if kind.kind == "boolean-integer":
        if not isinstance(value, bool):
            raise no("type")
        return value
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise no("type")
    if isinstance(value, float) and not math.isfinite(value):
        raise no("not-finite")
    if kind.kind == "finite-real":
        return float(value)
    if isinstance(value, float):
        if value != int(value):
            raise no("not-whole")
        value = int(value)
    if abs(value) > SAFE:
        raise no("unsafe-integer")
    return value


def decode(kind: FieldType, value: object) -> object:
    """A stored value; whole numbers may also come as their canonical decimal text."""
    if value is None:
        return None
    if kind.kind in ("safe-integer", "timestamp-integer") and isinstance(value, str):
        if str(int(value)) != value:
            raise SearchError("VALUE_INVALID", "not a canonical integer", reason="integer-text")
        value = int(value)
    if kind.kind == "boolean-integer" and value in (0, 1):
        return bool(value)
    return encode(kind, value)


def check_id(kind: str, value: object) -> object:
    """Document ids are strings, or safe integers; the two never equal each other."""
    if kind == "string" and isinstance(value, str):
        return value
    if kind == "safe-integer" and isinstance(value, int) and not isinstance(value, bool) and abs(value) <= SAFE:
        return value
    raise SearchError("VALUE_INVALID", f"document id is not a {kind}", reason="source-id")
