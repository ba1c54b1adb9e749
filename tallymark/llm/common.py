"""Helpers that the text and vector operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

#: ASCII white space as the contracts count it: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: list[list[str]] = []
_tables: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _kept:
        _kept[-1].append(path)
    return path


def new_table(name: str) -> str:
    """A name for a table in the session's warehouse."""
    found = f"{name}_{uuid.uuid4().hex}"
    if _tables:
        _tables[-1].append(found)
    return found


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Drops, at its end, what new_path(), new_table() and written() made within.
    For callers that write their result before then; a lazy result still needs
    its tables."""
    _kept.append([])
    _tables.append([])
    try:
        yield
    finally:
        for name in _tables.pop():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in _kept.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: cuts the
    lineage, survives lost executors, and later plans see its real size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of an integer id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def keep_fraction(rows: int, wanted: int) -> float:
    return min(1.0, wanted / max(rows, 1))


def hashed_below(column: str, fraction: float):
    """True for about that fraction of the ids, the same ids in every run."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(11)), F.lit(1_000_000)) < int(fraction * 1_000_000)
