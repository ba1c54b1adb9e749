"""Places for tables that a job writes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder; on a cluster
    that is an error, as executors could not see each other's files there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the
    lineage, survives lost executors, and later plans see its real size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_dir(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.mkdirs(at)


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, system = _at(spark, path)
    system.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    at, system = _at(spark, path)
    if not system.rename(at, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file, over one that is there."""
    at, system = _at(spark, path)
    out = system.create(at, True)
    try:
        out.write(text.encode())
    finally:
        out.close()
