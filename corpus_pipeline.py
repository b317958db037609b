"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents.

Defined results, for each stage: an empty table gives an empty one; other columns come through all stages but the last, whatever their names; each row is judged, repeated ones too. Null and empty
texts are kept by all stages: they are ordinary to the quality rules, near copies of nothing, hold no passage and no secret, and have no pieces (null ids for null). Rows with a null doc_id are judged by the quality
rules and masked, and kept by the two stages between. Very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, quality, secrets, sentencepiece, simhash
from vellum.llm._arrow import discard, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are outliers of their language and source; a null language or source is one of its own."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; rows that share a doc_id stay or go together."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of a benchmark item; null and empty items have none."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in place; n_chars follows the text."""
    return secrets.redacted(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_pieces, ids, decoded): the ids of each document, and the text that they stand for."""
    return sentencepiece.encode(docs, decoded=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", pieces),
]

#: Robust covariances, SimHash groups and pieces are beyond SQL; tests/llm/test_pipeline.py compares run() with brute force for every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
