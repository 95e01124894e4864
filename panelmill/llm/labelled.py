"""Labelled rows for the classifiers: a bounded sample to learn from, and who is held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: CRC-32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most *rows* labelled documents, spread by a hash of the id.

    Null labels and ids are left out; a document with several labels takes the largest. The ids are
    at most *rows*, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = sample_by_hash(known, rows, known.count(), "_id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")
