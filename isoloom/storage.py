"""Folders for intermediate tables, which driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir; it is deleted when the driver's Python ends.

    Where the setting is absent a temporary folder of this machine takes its place, but only for a local master: on a
    cluster each executor would write to its own disk, so there it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='isoloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not _made:
        atexit.register(tidy)
    _made.append(f"{base.rstrip('/')}/isoloom-{uuid.uuid4().hex}")
    return _made[-1]


def tidy() -> None:
    """Delete all folders so far. Results that were not stored elsewhere can't be read after that."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
