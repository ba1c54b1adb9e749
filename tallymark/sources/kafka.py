"""The same streams on Kafka; needs Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions import records
from .files import as_records


def read_options(config: JobConfig, topic: str, committed: bool) -> dict[str, str]:
    """From the earliest offset; committed: only what finished transactions wrote."""
    options = {"kafka.bootstrap.servers": config.bootstrap_servers, "subscribe": topic, "startingOffsets": "earliest"}
    return options | ({"kafka.isolation.level": "read_committed"} if committed else {})


def write_options(config: JobConfig, topic: str) -> dict[str, str]:
    """Ordered, idempotent producers."""
    return {
        "kafka.bootstrap.servers": config.bootstrap_servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true",
        "kafka.max.in.flight.requests.per.connection": "1", "kafka.compression.type": "gzip",
    }


def logged(spark: SparkSession, config: JobConfig, topic: str, committed: bool = False, starting: str = "earliest") -> DataFrame:
    """A topic as a stream: key, value, timestamp, and seq, the order in which
    one key's records arrived."""
    raw = spark.readStream.format("kafka").options(**read_options(config, topic, committed) | {"startingOffsets": starting}).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp", F.struct("partition", "offset").alias("seq"))


def snapshot(spark: SparkSession, config: JobConfig, topic: str, schema: str) -> DataFrame:
    """All records up to the end offsets at the start of the read."""
    raw = spark.read.format("kafka").options(**read_options(config, topic, True), endingOffsets="latest", failOnDataLoss="true").load()
    return records.decode(raw.select(F.col("value").cast("string").alias("value")), schema)


def publish(rows: DataFrame, config: JobConfig, topic: str, schema: str, key: str, time: str) -> None:
    """Kafka's sink repeats records after a failure; readers drop repeats by
    (key, updateCount) or (key, windowEnd)."""
    as_records(rows, schema, key, time).write.format("kafka").options(**write_options(config, topic)).save()
