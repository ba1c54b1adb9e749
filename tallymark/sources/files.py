"""Record streams as directories: key, JSON value and timestamp, like a log's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records
from ..scratch import exists, remove, rename

RECORD = "key STRING, value STRING, timestamp TIMESTAMP"


def record_columns(rows: DataFrame, schema: str, key: str, time: str) -> list[Column]:
    """key, value and timestamp: the key's column, all columns as JSON, and an
    epoch-millisecond column."""
    return [F.col(key).alias("key"), records.encode(rows, schema).alias("value"), F.timestamp_millis(time).alias("timestamp")]


def as_records(rows: DataFrame, schema: str, key: str, time: str) -> DataFrame:
    return rows.select(*record_columns(rows, schema, key, time))


def publish(rows: DataFrame, path: str, schema: str, key_col: str, time: str, order: str, partitions: int | None = None, key: str | None = None) -> None:
    """Writes the rows as records; one key's records are in one partition, in
    the order of `time` and `order`."""
    by = key or key_col
    dealt = rows.repartition(partitions, by) if partitions else rows.repartition(by)
    as_records(dealt.sortWithinPartitions(time, order), schema, key_col, time).write.parquet(path)


def _counts(raw: DataFrame) -> DataFrame:
    """file and n: each partition's records."""
    return raw.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))


def seal(spark: SparkSession, path: str) -> None:
    """Writes the manifest, the records of each partition of a directory that is
    wholly written: its end, for complete(). It comes last, by one rename; a
    directory that got more records is sealed anew."""
    _counts(spark.read.schema(RECORD).parquet(path)).write.mode("overwrite").json(f"{path}/_manifest-new")
    remove(spark, f"{path}/_manifest")
    rename(spark, f"{path}/_manifest-new", f"{path}/_manifest")


def shortfalls(spark: SparkSession, path: str) -> DataFrame:
    """file, n (by the manifest) and found: the partitions that lack records."""
    told = spark.read.schema("file STRING, n BIGINT").json(f"{path}/_manifest")
    found = _counts(spark.read.schema(RECORD).parquet(path)).withColumnRenamed("n", "found")
    return told.join(found, "file", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found < n")


def require_whole(spark: SparkSession, path: str) -> None:
    """Raises if a directory has no manifest or a partition holds less than that
    says, which is named."""
    if not exists(spark, f"{path}/_manifest"):
        raise ValueError(f"{path} has no manifest: it isn't known to be complete")
    if short := shortfalls(spark, path).orderBy("file").limit(10).collect():
        raise ValueError(f"{path} is short of records: " + ", ".join(f"{r.file} holds {r.found} of {r.n}" for r in short))


def complete(spark: SparkSession, path: str, schema: str, expected: int | None = None, sealed: bool = False) -> DataFrame:
    """The decoded records of a directory; raises if there are fewer than
    expected, so that a half-written stream isn't taken for all of it. sealed:
    it must have a manifest, and a partition short of that is named."""
    raw = spark.read.schema(RECORD).parquet(path)
    if sealed:
        require_whole(spark, path)
    if expected is not None and (found := raw.count()) < expected:
        raise ValueError(f"{path} holds {found} of {expected} records")
    return records.decode(raw, schema)


def with_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The decoded records with their own key and time: recordKey, recordMillis."""
    raw = spark.read.schema(RECORD).parquet(path)
    whole = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), F.col("key").alias("recordKey"), F.unix_millis("timestamp").alias("recordMillis"))
    return whole.select("r.*", "recordKey", "recordMillis")


def partition_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per symbol, the files that hold its records and how often the event time
    falls from one record to the next within a file."""
    raw = spark.read.schema(RECORD).parquet(path)
    own = raw.select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("r.eventTime").over(Window.partitionBy("r.symbol", "file").orderBy("block", "at"))
    own = own.select(F.col("r.symbol").alias("symbol"), "file", (F.col("r.eventTime") < before).alias("falls"))
    return own.groupBy("symbol").agg(F.count_distinct("file").alias("partitions"), F.count(F.when(F.col("falls"), 1)).alias("falls"))


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A directory, or a pattern of files, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def logged(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of records as a stream: key, value, timestamp, and seq, the
    order in which one key's records arrived."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    return stream(spark, path, RECORD, files_per_trigger).select("key", "value", "timestamp", at.alias("seq"))


def arrivals(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """value and seq of logged()."""
    return logged(spark, path, files_per_trigger).select("value", "seq")
