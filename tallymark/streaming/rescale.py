"""Going on from an ended run with another number of state partitions.

A checkpoint fixes its number of state partitions. A new run with a checkpoint of
its own starts from the old one's state, read as a table by Spark's state reader,
and from the records that the old run didn't read: all but the files in its
source log, or the offsets after its last ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists
from . import carried


def totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, quantity and updates of each key of an ended positions run, from its
    state or its table."""
    if exists(spark, f"{checkpoint}/totals"):
        return carried.totals_after(spark, f"{checkpoint}/totals", last_batch(spark, checkpoint)[0])
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "total").load()
    return state.select("key.key", "value.quantity", "value.updates")


def _numbered(spark: SparkSession, path: str) -> dict[int, str]:
    """The log's batches: number and text. Only the numbers of small files."""
    if not exists(spark, path):
        return {}
    rows = spark.read.option("wholetext", "true").text(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)$", 1).alias("n"), "value").filter("n != ''")
    return {int(r.n): r.value for r in rows.orderBy(F.col("n").cast("bigint").desc()).limit(1).collect()}


def last_batch(spark: SparkSession, checkpoint: str) -> tuple[int, str]:
    """The last batch's number and its sources' end offset; raises if it was
    begun but not finished, as its records may be half done."""
    begun, done = _numbered(spark, f"{checkpoint}/offsets"), _numbered(spark, f"{checkpoint}/commits")
    if not done or max(begun) != max(done):
        raise ValueError(f"{checkpoint} has no finished run: restart it from there, and let it end")
    number = max(begun)
    return number, begun[number].strip().splitlines()[-1]


def read_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """path and millis of each file that the run has read."""
    lines = spark.read.text(f"{checkpoint}/sources/0").filter(F.col("value").startswith("{"))
    return lines.select(F.from_json("value", "path STRING, timestamp BIGINT").alias("f")).select("f.path", F.col("f.timestamp").alias("millis")).distinct()


#: How far back a file may be dated and still be new: Spark's file source has the same limit.
FILE_AGE_MILLIS = 7 * 86_400_000


def rest_of_files(rows: DataFrame, checkpoint: str) -> DataFrame:
    """rows (with seq) without those of files that the ended run has read. Files
    of long before its last one aren't opened: their time is on the listing."""
    spark = rows.sparkSession
    last_batch(spark, checkpoint)
    done = read_files(spark, checkpoint)
    latest = done.agg(F.max("millis")).first()[0]
    if latest is None:
        return rows
    oldest = latest - FILE_AGE_MILLIS
    plain = lambda path: F.regexp_replace(path, "^file:/+", "/")
    read = done.filter(F.col("millis") >= oldest).select(plain(F.col("path")).alias("_read"))
    fresh = rows.filter(F.col("seq.file_modification_time") >= F.timestamp_millis(F.lit(oldest)))
    return fresh.join(read, plain(F.col("seq.file_path")) == F.col("_read"), "left_anti")


def starting_offsets(spark: SparkSession, checkpoint: str) -> str:
    """For a topic: where the ended run stopped, as startingOffsets takes it."""
    offset = last_batch(spark, checkpoint)[1]
    json.loads(offset)
    return offset
