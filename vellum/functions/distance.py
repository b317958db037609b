"""Edit distance with transpositions, of which none may be edited again (optimal string alignment)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: str, b: str) -> int:
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def allowed(term: str, most: int = 2) -> int:
    return min(most, 0 if len(term) < 5 else 1 if len(term) < 9 else 2)


def closest(terms: list[str], text: str, most: int = 2) -> int | None:
    """The least distance of a term from a word of the text, of those that the term's length allows."""
    words, best = set(text.split()), None
    for term in terms:
        limit = allowed(term, most)
        for word in words:
            if abs(len(word) - len(term)) <= limit and (best is None or best > 0):
                d = osa(term, word)
                if d <= limit and (best is None or d < best):
                    best = d
    return best


def closest_column(text: Column, terms: list[str], most: int = 2) -> Column:
    @F.pandas_udf("int")
    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: closest(terms, t or "", most)).astype("Int32")

    return work(text)
