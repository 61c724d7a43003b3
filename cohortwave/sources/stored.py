"""Tables that several jobs read, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; without one, an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cohortwave-"))
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table: computed once, safe from lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stored tables from which nothing will be read any more."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
