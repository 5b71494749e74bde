"""What the operators share: the shared folder, written tables, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: any run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only if it has been counted and its rows, at the given
#: width, stay under this many bytes.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is
    unset the checkpoint folder of the context. A local master may have one of
    its own; a cluster without a shared folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "snappy", path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, the
    rows are computed once, and lost executors cost a re-read at most."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a count proves that it fits, else as it is
    (the join then shuffles). df should be a written table: it is counted."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hex_digits(rows: int, per_bucket: int, groups: int = 1) -> int:
    """How many leading digits of a hexadecimal hash cut each of `groups`
    groups into key ranges of about per_bucket rows."""
    digits = 0
    while digits < 7 and rows / max(groups, 1) / 16**digits > per_bucket:
        digits += 1
    return digits
