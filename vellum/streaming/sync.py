"""Keeps an index in step with a stream of changes.

A change is a row (op, <key>, <fields>...) with a number that orders the changes of one key. op is `upsert` or `delete`; for a linked index these are the changes of its
source, and a column <key>_old may name the key that a row had before: the document then keeps its doc_id under the new key. Each micro-batch is one new segment; the last change of
a key wins, and what is equal in the order is told apart by the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Handle
from ..sources.store import _last


def apply(handle: Handle, changes: DataFrame, order: str) -> None:
    """One batch of changes. A row whose key changes is a change of the new key, and of the old one, which is gone unless a later change brings it back."""
    d = handle.definition
    before = f"{d.key}_old"
    old = F.col(before) if before in changes.columns else F.lit(None).cast(changes.schema[d.key].dataType)
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"{f}_source") for f in d.searchable]
    typed = [F.col(c).cast(t.spark).alias(c) for c, t in d.projected.items()]
    rows = changes.select(F.col(order).alias("_order"), F.col(d.key).alias("source_id"), F.when(old != F.col(d.key), old).alias("_old"), (F.col("op") == "upsert").alias("_keep"), *texts, *typed).where("source_id is not null")
    left = rows.where("_keep and _old is not null").select("_order", F.col("_old").alias("source_id"), F.lit(False).alias("_keep"))
    rows = rows.unionByName(left, allowMissingColumns=True)
    # of one place in the order, what stores a document comes after what removes one
    handle.stored.change(_last(rows, "source_id", F.col("_order").desc(), F.col("_keep").desc()).drop("_order"))


def follow(handle: Handle, changes: DataFrame, order: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the query over a streaming table of changes."""

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            apply(handle, df, order)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
