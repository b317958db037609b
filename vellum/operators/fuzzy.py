"""Typo fallback: documents that share a gram with the query and have a word within a few edits of one of its terms.

Grams block, so that the edit distance, the one Python function of a search, sees few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyze import grams, grams_of
from ..functions.distance import closest_column
from ..functions.normalize import normalize_column, normalize_text
from ..limits import TypoPolicy
from ..plans.query import TextQuery, terms_of


def query_terms(query: TextQuery, profiles: tuple[str, ...], policy: TypoPolicy = TypoPolicy()) -> tuple[list[str], list[str]]:
    """Terms that are long enough, the first few, and their distinct grams."""
    terms = [t for t in (normalize_text(x, profiles) for x in terms_of(query)) if len(t) >= policy.min_length][: policy.max_terms]
    return terms, list(dict.fromkeys(g for t in terms for g in grams_of(t)))[: policy.grams_per_term * max(1, len(terms))]


def haystack(searchable: list[str], profiles: tuple[str, ...]) -> Column:
    return F.concat_ws(" ", *(normalize_column(F.coalesce(F.col(f"{f}_source"), F.lit("")), profiles) for f in searchable))


def gram_table(docs: DataFrame, searchable: list[str], profiles: tuple[str, ...]) -> DataFrame:
    """(gram, doc_id), in lower case."""
    every = F.concat(*(grams(F.lower(normalize_column(F.coalesce(F.col(f"{f}_source"), F.lit("")), profiles))) for f in searchable))
    return docs.select("doc_id", F.explode(F.array_distinct(every)).alias("gram")).select("gram", "doc_id")


def candidates(docs: DataFrame, allowed: Column | None, wanted: list[str], searchable: list[str], profiles: tuple[str, ...], most: int, stored: DataFrame | None = None) -> DataFrame:
    """The first documents by doc_id that may be seen and share a gram with the query; stored is a table of grams, with which the documents are found first and
    then read by their ids."""
    if stored is not None:
        some = stored.where(F.col("gram").isin(*{g.lower() for g in wanted})).select("doc_id").distinct()
        if allowed is not None:
            some = docs.where(allowed).select("doc_id").join(some, "doc_id", "left_semi")
        return docs.where(F.col("doc_id").isin([r[0] for r in some.orderBy("doc_id").limit(most).collect()]))
    shared = F.lit(False)
    for f in searchable:
        text = F.lower(normalize_column(F.coalesce(F.col(f"{f}_source"), F.lit("")), profiles))
        for g in {g.lower() for g in wanted}:
            shared = shared | text.contains(g)
    return (docs if allowed is None else docs.where(allowed)).where(shared).orderBy("doc_id").limit(most)


def survivors(found: DataFrame, terms: list[str], wanted: list[str], searchable: list[str], profiles: tuple[str, ...], policy: TypoPolicy = TypoPolicy()) -> DataFrame:
    """found with `distance`, without what is too far from every term. Compared as written: case counts here."""
    text = haystack(searchable, profiles)
    overlap = F.size(F.array_intersect(grams(text), F.array(*map(F.lit, wanted))))
    near = found.where(overlap >= policy.min_overlap).withColumn("distance", closest_column(text, terms, policy.max_distance))
    return near.where("distance is not null")
