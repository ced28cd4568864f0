"""A stored cache of scans: only contents that no earlier run has seen are scanned.

An entry is a content (by SHA-256), the parameters of its scan (by a digest of
rules, words and content type), its findings and the time of the scan.  Entries
older than a time to live are none, and of the others the newest stay up to a
budget of bytes.  A run reads the newest whole version of the table, scans what is
missing once for all copies, writes the next version and drops the one before the
last, so a run that dies leaves the version before it.

The budget is kept without one task that sees all entries: bytes are summed by
hour, the hours before the one where the budget ends stay whole, and only that
hour's entries are ordered, in parts by minute.

Edge cases: null texts have no entry and no findings; repeated rows share an
entry; a changed rule, word or content type makes all entries strangers; an
empty table writes an empty version.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.store import shared_dir
from ..sources.zh_view import zh_docs
from .rule_scan import lexicon_rules, scan_rules

FOUND = "array<struct<start: int, finish: int, found: string, kind: string, severity: int, suggestions: array<string>>>"
ENTRIES = f"digest string, params string, found {FOUND}, held long, made timestamp"
TIME_TO_LIVE, BUDGET = timedelta(days=30), 32 << 20


def _versions(spark: SparkSession, folder: str) -> tuple[object, list[tuple[int, str]]]:
    """The file system, and (number, path) of the whole versions, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v-*/_SUCCESS")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [s.getPath().getParent().toString() for s in fs.globStatus(path) or []]
    return fs, sorted((int(p.rpartition("-")[2]), p) for p in paths)


def parameters(rules: DataFrame, words: tuple[str, ...], content_type: str) -> str:
    """A digest of what a scan depends on but the text; the order of rules does not count."""
    row = rules.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h}:{hash_of(words)}:{content_type}"


def hash_of(words: tuple[str, ...]) -> str:
    return hashlib.sha256("\0".join(sorted(words)).encode()).hexdigest()[:16]


def within_budget(entries: DataFrame, budget: int) -> DataFrame:
    """The newest entries that fit ``budget`` bytes together; of one time by digest."""
    hours = entries.groupBy(F.date_trunc("hour", "made").alias("hour")).agg(F.sum("held").alias("bytes"))
    # One row per hour of the time to live.
    newer = Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("ahead", F.coalesce(F.sum("bytes").over(newer), F.lit(0)))
    marked = entries.withColumn("hour", F.date_trunc("hour", "made")).join(hours, "hour").where(F.col("ahead") < budget)
    minutes = marked.where(F.col("ahead") + F.col("bytes") > budget).withColumn("minute", F.date_trunc("minute", "made"))
    by_minute = minutes.groupBy("minute", "ahead").agg(F.sum("held").alias("in_minute"))
    newer = Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    by_minute = by_minute.select("minute", (F.col("ahead") + F.coalesce(F.sum("in_minute").over(newer), F.lit(0))).alias("before"))
    inside = Window.partitionBy("minute").orderBy(F.desc("made"), "digest").rowsBetween(Window.unboundedPreceding, 0)
    edge = minutes.join(by_minute, "minute").where(F.col("before") < budget).withColumn("upto", F.col("before") + F.sum("held").over(inside)).where(F.col("upto") <= budget)
    return marked.where(F.col("ahead") + F.col("bytes") <= budget).select(entries.columns).unionByName(edge.select(entries.columns))


def scan_cached(
    docs: DataFrame, rules: DataFrame, folder: str, words: tuple[str, ...] = (), content_type: str = "plain", now: datetime | None = None, time_to_live: timedelta = TIME_TO_LIVE, budget: int = BUDGET
) -> DataFrame:
    """doc_id, start, finish, found, kind, severity, suggestions of ``docs`` (doc_id, text), by way of the cache in ``folder``."""
    spark, now = docs.sparkSession, now or datetime.now()
    params = parameters(rules, words, content_type)
    fs, versions = _versions(spark, folder)
    entries = spark.read.schema(ENTRIES).parquet(versions[-1][1]) if versions else spark.createDataFrame([], ENTRIES)
    live = within_budget(entries.where(F.col("made") >= F.lit(now - time_to_live)), budget)
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("digest"))
    known = live.where(F.col("params") == params).select("digest")
    new = texts.join(known, "digest", "left_anti").groupBy("digest").agg(F.first("text").alias("text"))
    rows = scan_rules(new.withColumn("doc_id", F.lit(0)), rules, words, content_type, carry=("digest",))
    one = F.struct("start", "finish", "found", "kind", "severity", "suggestions")
    found = rows.groupBy("digest").agg(F.array_sort(F.collect_list(one)).alias("found"))
    # One pass over the new texts: each has its row, found or not.
    held = new.select("digest", F.octet_length("text").cast("long").alias("held"))
    scanned = held.join(found, "digest", "left").select(
        "digest", F.lit(params).alias("params"), F.coalesce("found", F.array().cast(FOUND)).alias("found"), "held", F.lit(now).cast("timestamp").alias("made")
    )
    path = f"{folder}/v-{(versions[-1][0] if versions else 0) + 1:012d}"
    live.unionByName(scanned).write.mode("overwrite").parquet(path)
    for _, old in versions[:-1]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)
    kept = spark.read.schema(ENTRIES).parquet(path).where(F.col("params") == params)
    return texts.select("doc_id", "digest").join(kept, "digest").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def pol15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all texts by way of a cache that a first run over them has filled, and the texts that the second run scanned anew (none)."""
    docs, rules = zh_docs(spark, sf_dir).withColumnRenamed("zh", "text"), lexicon_rules(spark)
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-ink/cache-{uuid.uuid4().hex}"
    scan_cached(docs, rules, folder, now=datetime(2024, 1, 1), budget=1 << 62)
    rows = scan_cached(docs, rules, folder, now=datetime(2024, 1, 2), budget=1 << 62)
    scanned = spark.read.schema(ENTRIES).parquet(_versions(spark, folder)[1][-1][1]).where(F.col("made") > F.lit(datetime(2024, 1, 1)))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("severity").alias("severity"))
    return counts.unionByName(scanned.selectExpr("cast(null as bigint) AS doc_id", "cast(1 as bigint) AS n", "cast(null as int) AS severity"))


QUERIES = {"pol15_stored_cache": pol15}
