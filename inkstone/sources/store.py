"""Tables written once for an application, in the folder that all executors share.

A table is made anew when the files it is made from change, and what an
application wrote goes when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Written tables: path by name, and the session by folder.
_WRITTEN: dict[tuple[str, str], str] = {}
_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names; where it names none, a temporary one for a local master only."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ink-shared-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def state_of(spark: SparkSession, source: str) -> str:
    """A digest of the names, sizes and times of the files of ``source``; no file is opened."""
    files = spark.read.format("binaryFile").load(source).select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    row = files.agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return f"{row.n}-{abs(row.h or 0)}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path, spark in _FOLDERS.items():
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, for what several readings of it would make anew."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-ink"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _FOLDERS[folder] = spark
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of the files of ``source``, made and written at its first use and after each change of the files."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-ink"
    path = f"{folder}/{name}-{state_of(spark, source)}"
    if _WRITTEN.get((folder, name)) != path:
        make().write.mode("overwrite").parquet(path)
        _WRITTEN[folder, name], _FOLDERS[folder] = path, spark
    return spark.read.parquet(path)
