"""Labelled rows for models that are fitted on a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, held_out: int | None = None) -> DataFrame:
    """text and label of at most `most` labelled documents, the first by a hash
    of the id; ids whose remainder modulo `held_out` is 0 are never in."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if held_out:
        rows = rows.where(remainder(F.col("doc_id"), held_out) != 0)
    rows = rows.groupBy("doc_id").agg(F.max(label).alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
