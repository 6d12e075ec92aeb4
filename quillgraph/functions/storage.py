"""Cutting lineage in iterative operators, in a folder that executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``.  Where that is
    unset, a temporary folder serves a master of one machine (``local[...]``);
    any other master raises, since its executors would not see the files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/quillgraph-{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back: no lineage, exact sizes."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """``df`` in as many parts as a shuffle has, or four for each core if that is more,
    by a key.  Spark cuts and joins parts by their bytes alone; rows of few bytes that
    cost much time, or unpack to much memory, else lie in one part."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *key)


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that name in the shared folder, made and written where it is
    not there yet.  The name must tell what the table is made from."""
    path = f"{shared_dir(spark)}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small new file; false if there is one of that name already."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    try:
        out = files.create(at, False)
    except Exception as error:
        if files.exists(at):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def clear(spark: SparkSession) -> None:
    """Remove what this application has written to the shared folder.  Results
    that are still lazy read those tables, so call it when all are stored."""
    remove(spark, shared_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
