"""Contiguous shards of near-equal bytes from global prefix sums.  DataFrame operations only.

Documents are ordered by doc_id (nulls first; equal ids by checksum and size).
The order is cut into range partitions, each partition's bytes and rows are
totalled, and a partition's prefix sums start at the total of the ones before
it.  A document belongs to the shard in whose equal share of all bytes it
starts, so shards differ by less than one document.  Texts are read once and
never shuffled: only id, size and checksum move.

Edge cases: a null text has size 1 and checksum 0 like an empty one; repeated
rows are kept side by side; with fewer documents than shards some are empty;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    parts = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "parts")
    # One row per range partition; its running sums start where the partitions before it end.
    totals = parts.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("start", F.sum("size").over(inside) - F.col("size")).withColumn("row", F.count("*").over(inside) - 1)
    placed = placed.join(F.broadcast(totals), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"int((bytes_before + start) * {shards} div total)").alias("shard"),
        (F.col("rows_before") + F.col("row")).alias("row"),
    )
    placed = saved(placed, "placed")
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


#: DuckDB has no crc32, so the table-driven algorithm is written out over the bytes of each text.
OP2_SQL = """
WITH codes AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS code
), sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(code[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS text_crc32
  FROM documents, codes
), placed AS (
  SELECT *, (sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size) * 8 // sum(size) OVER () AS shard FROM sized
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""
