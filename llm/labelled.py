"""Labelled rows for fitting, and the split between learning and held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD_OUT = "coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)"


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, label) of at most ``most`` learning rows, the first by a hash of doc_id, in that order in one partition.

    Rows without a label, a doc_id or a text are not learnt from.
    """
    picked = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(f"not {HELD_OUT} and label in (0, 1) and doc_id is not null")
    picked = picked.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return rows.repartition(1).sortWithinPartitions("order", "doc_id", "text").select("text", "label")
