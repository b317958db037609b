"""Counts and ranges of the values of the matched documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distribution(matched: DataFrame, field: str, most: int | None) -> DataFrame:
    """(value, count), most frequent first, then by value; nulls are not counted."""
    counts = matched.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("value"))
    return counts.limit(most) if most else counts


def ranges(matched: DataFrame, fields: list[str]) -> DataFrame:
    """One row (<field>_min, <field>_max, ...) for all numeric facets."""
    return matched.agg(*(f(c).alias(f"{c}_{n}") for c in fields for n, f in (("min", F.min), ("max", F.max))))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Sums of distributions; equal counts are ordered by the value's text."""
    return reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), F.col("value").cast("string"))
