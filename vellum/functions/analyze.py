"""Tokens and grams of text, alike in Python, Spark and DuckDB.

A token is a maximal run of letters, numbers and private-use characters, in lower case and without Latin diacritics.
"""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _folds() -> tuple[str, str]:
    source, target = "", ""
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code).islower() and len(parts) == 2 and parts[0].isascii() and unicodedata.combining(parts[1]):
            source, target = source + chr(code), target + parts[0]
    return source + "".join(map(chr, range(0x300, 0x370))), target


#: Characters that fold, the combining marks that go last, and what they fold to.
FOLD_FROM, FOLD_TO = _folds()
_TABLE = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :])


def folded(text: Column) -> Column:
    """What tokens are runs of: a text that lacks a token's characters lacks the token. Texts of one byte for each character have nothing to fold."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, FOLD_FROM, FOLD_TO))


def tokens(text: Column) -> Column:
    return tokens_in(folded(text))


def tokens_in(folded_text: Column) -> Column:
    return F.regexp_extract_all(folded_text, F.lit(f"({TOKEN})"), F.lit(1))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(folded(text), F.lit(TOKEN))


def tokens_sql(text: str) -> str:
    """The same for DuckDB."""
    return f"regexp_extract_all(translate(lower(coalesce({text}, '')), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}')"


def tokens_of(text: str) -> list[str]:
    return regex.findall(TOKEN, text.lower().translate(_TABLE))


def grams_of(text: str) -> list[str]:
    """Successive runs of three code points."""
    return [text[k : k + 3] for k in range(len(text) - 2)]


def grams(text: Column) -> Column:
    """Distinct grams of a text; none for texts of fewer than three characters."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(text, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))
