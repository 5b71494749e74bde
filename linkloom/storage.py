"""Written tables in the folder that all executors share, and broadcasts of
tables that were counted first."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows, at a given width, stay under this.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset the context's checkpoint
    folder. A local master may have one of its own; a cluster without a shared
    folder is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written out and read back, so that its lineage is cut and a lost
    executor costs a re-read."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, row_bytes: int = 128, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a count proves that it fits; else as it is,
    so that the join shuffles."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
