"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage and survives the loss of an executor, as its files
belong to no executor. ``spark.checkpoint.dir`` names the folder; only a local
session, whose driver and executors share a disk, may go without it. Tables lie
below the application's own folder, so that deleting them touches no other job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; raises on a cluster that does not name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/strataform-scratch"
    return f"{named.rstrip('/')}/strataform/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``release``."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, since: int) -> None:
    """Delete all tables written since the mark but the last one, which holds what they led to."""
    for path in _written[since:-1]:
        _delete(spark, path)
    del _written[since:-1]


def clear(spark: SparkSession) -> None:
    """Delete every table of this application; call it once no result that reads them is needed."""
    _delete(spark, folder(spark))
    _written.clear()
