"""Queries over the corpus tables, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, licenses, ngrams, quality, secrets, sentencepiece, simhash, spans, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to."""
    return sentencepiece.encode(table(spark, sf_dir, "documents"), decoded=True)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.decisions(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents from which a sentence is removed."""
    return spans.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"), changed=True)


def op9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cleaned."""
    return spans.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontaminate, op2_sentencepiece, op3_html_text, op4_near_duplicates, op5_url_filters, op6_lm_scores, op7_licenses, op8_quality, op9_repeated_spans, op9_cleaned, op10_secrets)}
