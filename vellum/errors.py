"""Errors with a code that callers can branch on; details never hold values of documents."""

from __future__ import annotations

CODES = frozenset(
    "SEARCH_" + c
    for c in """CONFIG_INVALID CAPABILITY_UNSUPPORTED QUERY_INVALID QUERY_LIMIT_EXCEEDED FILTER_INVALID VALUE_INVALID RUNTIME_LIMIT_EXCEEDED
    SCOPE_INVALID INDEX_NOT_FOUND INDEX_DRIFT MIGRATION_REQUIRED BACKEND_ERROR ADAPTER_ERROR MAINTENANCE_FAILED""".split()
)


class SearchError(Exception):
    def __init__(self, code: str, message: str, **details: object):
        self.code = code if code.startswith("SEARCH_") else f"SEARCH_{code}"
        if self.code not in CODES:
            raise ValueError(f"unknown error code {code}")
        self.details = details
        super().__init__(f"{self.code}: {message}")
