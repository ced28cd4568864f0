"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and not a recomputation.  A table that
later steps don't read is released at once, and what is left of an application's
tables goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Bytes in an Arrow batch of texts, where the session has the default of 64 MB; buffers of both sides stay small.
_BATCH, _BATCH_BYTES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b"
#: Files of a narrow table for each core at most.
FILES_PER_CORE = 4


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, _BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Where the session names none, a temporary one is set for a local master; a cluster needs the setting."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


_SAVED: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in _SAVED.items():
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def saved(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back.

    A narrow table (ids and numbers, the last step a join or grouping) goes to a few files for each core: its
    partitions are written one after the other, so that one of some hundred KB isn't a file for each shuffle
    partition where the session doesn't join small ones.  Every file costs the executor a few processes on a local file system.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    small_batches(spark)
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SAVED[root] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Deletes tables made by ``saved`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.saved_at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, read by Spark alone."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
