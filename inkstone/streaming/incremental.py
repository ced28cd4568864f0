"""Scans of a stream of documents, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import scan


def scan_new(docs: DataFrame, since: str = "1 day", time: str = "seen_at") -> DataFrame:
    """Findings of documents (doc_id, text, seen_at) whose content was not seen within ``since``; works on a stream and on a table.

    State is one digest for each content within the watermark.
    """
    keyed = docs.withColumn("digest", F.sha2("text", 256))
    if docs.isStreaming:
        keyed = keyed.withWatermark(time, since).dropDuplicatesWithinWatermark(["digest"])
    else:
        keyed = keyed.dropDuplicates(["digest"])
    return scan(keyed)
