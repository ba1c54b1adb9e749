"""Records judged once, before any job reads them.

One stream per source writes every record with its reason (none for a good one)
to a directory with a part for the good and one for the bad. The directory's log
of finished micro-batches makes that exactly-once: through failures and restarts
each record is in one of the two parts, once. Jobs read the good part as their
source; the bad part holds the dead letters: the record as it came, its place in
the source, and why it can't be used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import JobConfig
from ..functions import records
from ..scratch import make_dir
from ..sources import files, kafka

#: seq by the kind of source: a file's time, path and row, or a partition and offset.
FILE_SEQ = "STRUCT<file_modification_time: TIMESTAMP, file_path: STRING, row_index: BIGINT>"
TOPIC_SEQ = "STRUCT<partition: INT, offset: BIGINT>"


def place(config: JobConfig, name: str) -> str:
    return f"{config.intake_path}/{name}"


def _schema(config: JobConfig) -> str:
    return f"{files.RECORD}, seq {TOPIC_SEQ if config.bootstrap_servers else FILE_SEQ}, reason STRING, fate STRING"


def run_intake(spark: SparkSession, config: JobConfig, name: str, schema: str, fault: Column, committed: bool = False) -> StreamingQuery:
    """Judges the records of config's `name`_path as they come."""
    path = getattr(config, f"{name}_path")
    raw = kafka.logged(spark, config, path, committed) if config.bootstrap_servers else files.logged(spark, path, config.files_per_trigger)
    out = records.judged(raw, schema, fault).withColumn("fate", F.when(F.col("reason").isNull(), "good").otherwise("bad"))
    make_dir(spark, place(config, name))  # so that a job can wait there for the first record
    trigger = {"processingTime": f"{config.trigger_millis} milliseconds"} if config.trigger_millis else {"availableNow": True}
    writer = out.writeStream.outputMode("append").queryName(f"intake_{name}").option("checkpointLocation", f"{config.checkpoint_path}/intake_{name}").trigger(**trigger)
    return writer.format("parquet").partitionBy("fate").option("path", place(config, name)).start()


def accepted(spark: SparkSession, config: JobConfig, name: str) -> DataFrame:
    """The good records as a stream: value and seq, the order of arrival at the source."""
    rows = files.stream(spark, place(config, name), _schema(config), config.files_per_trigger)
    return rows.filter("fate = 'good'").select("value", "seq")


def dead_letters(spark: SparkSession, config: JobConfig, name: str) -> DataFrame:
    """The bad records so far: key, value, timestamp, seq and reason."""
    return spark.read.schema(_schema(config)).parquet(place(config, name)).filter("fate = 'bad'").drop("fate")
