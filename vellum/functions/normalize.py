"""Portable character replacements, alike in Python and as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SearchError


@dataclass(frozen=True)
class Normalizer:
    """Maps single characters to single characters or to nothing. No target may be a source, so that order is of no matter."""

    name: str
    mapping: tuple[tuple[str, str], ...]

    def __post_init__(self) -> None:
        sources = [a for a, _ in self.mapping]
        if not self.mapping or any(len(a) != 1 or len(b) > 1 for a, b in self.mapping) or len(set(sources)) < len(sources) or any(b and b in sources for _, b in self.mapping):
            raise SearchError("CONFIG_INVALID", "replacements must be distinct characters without chains", reason="normalizer")

    def text(self, value: str) -> str:
        return value.translate({ord(a): b for a, b in self.mapping})

    def column(self, value: Column) -> Column:
        ordered = sorted(self.mapping, key=lambda m: not m[1])  # removed ones last: the target text is shorter
        return F.translate(value, "".join(a for a, _ in ordered), "".join(b for _, b in ordered))


def span(first: int, last: int) -> str:
    return "".join(map(chr, range(first, last + 1)))


_REMOVED = chr(0x640) + span(0x64B, 0x652) + chr(0x670)
_ALEFS = "".join(map(chr, (0x622, 0x623, 0x625, 0x671)))
PROFILES = {
    n.name: n
    for n in (
        Normalizer("arabic-basic", tuple((c, "") for c in _REMOVED) + tuple((c, chr(0x627)) for c in _ALEFS) + ((chr(0x649), chr(0x64A)),)),
        Normalizer("numeric-arabic", tuple(zip(span(0x660, 0x669), "0123456789"))),
    )
}


def check_profiles(names: list[str]) -> tuple[str, ...]:
    if len(set(names)) < len(names) or any(n not in PROFILES for n in names):
        raise SearchError("CONFIG_INVALID", "normalization profiles must be known and named once", reason="normalization")
    return tuple(names)


def normalize_text(value: str, profiles: tuple[str, ...]) -> str:
    for name in profiles:
        value = PROFILES[name].text(value)
    return value


def normalize_column(value: Column, profiles: tuple[str, ...]) -> Column:
    for name in profiles:
        value = PROFILES[name].column(value)
    return value
