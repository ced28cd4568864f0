"""Texts from files, and back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that a walk takes; JSON is read only where a path names it.
SUFFIXES = ("md", "markdown", "yml", "yaml", "txt")


def read_texts(spark: SparkSession, paths: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, text, content_type) of the files below ``paths``, each once; paths like one of the glob patterns ``exclude`` are left out."""
    rows = spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    named = F.lit(False)
    for p in paths:
        named |= F.col("path").endswith(p)
    rows = rows.where(suffix.isin(*SUFFIXES) | ((suffix == "json") & named))
    for glob in exclude:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob)
        rows = rows.where(~F.col("path").rlike(f"(^|/){pattern}(/|$)"))
    kind = F.when(suffix.isin("md", "markdown"), "markdown").when(suffix.isin("yml", "yaml"), "yaml").when(suffix == "json", "json").otherwise("plain")
    return rows.select("path", "text", kind.alias("content_type")).dropDuplicates(["path"])


def write_fixed(fixed: DataFrame, folder: str) -> None:
    """Fixed texts (doc_id, text, ...) as Parquet in place of what the folder held; readers see the old files until the commit."""
    fixed.select("doc_id", "text").write.mode("overwrite").parquet(folder)
