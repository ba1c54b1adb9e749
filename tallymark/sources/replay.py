"""Replays a log's first n records, so many at a time.

The records are numbered in a total order and written by the micro-batch they
belong to. A stream that is only a clock then publishes one such part after the
other, each by one rename: after a stop, a failure or a kill the same checkpoint
goes on with the next part, and n records are published in all, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations
from ..scratch import exists, rename
from . import files


def prepare(rows: DataFrame, records: list[Column], path: str, n: int, per_batch: int, time: str, tie: str) -> int:
    """Writes the first n rows by `time` and `tie`, as the columns of `records`,
    to part=0, part=1, ... of path; the number of parts. Raises if there are
    fewer than n."""
    if n <= 0 or per_batch <= 0:
        raise ValueError("a replay has records, in parts of some")
    own = relations.numbered(rows, time, tie).filter(F.col("ordinal") < n).withColumn("part", F.expr(f"ordinal div {per_batch}"))
    parts = -(-n // per_batch)
    dealt = own.select(*records, "ordinal", "part").repartitionByRange(parts, "part").sortWithinPartitions("part", "ordinal")
    dealt.write.partitionBy("part").parquet(path)
    found = rows.sparkSession.read.schema(f"{files.RECORD}, ordinal BIGINT, part BIGINT").parquet(path).count()
    if found < n:
        raise ValueError(f"the log holds {found} of {n} records to replay")
    return parts


def start(spark: SparkSession, prepared: str, out: str, checkpoint: str, trigger_millis: int = 0) -> StreamingQuery:
    """Publishes a part at each tick; ticks after the last one do nothing."""

    def publish(tick: DataFrame, number: int) -> None:
        done, work = f"{out}/batch={number}", f"{out}/_work-{number}"
        if not exists(spark, f"{prepared}/part={number}") or exists(spark, done):
            return
        part = spark.read.schema(f"{files.RECORD}, ordinal BIGINT, part BIGINT").parquet(prepared).filter(F.col("part") == number)
        part.repartition(1).sortWithinPartitions("ordinal").select("key", "value", "timestamp").write.mode("overwrite").parquet(work)
        rename(spark, work, done)

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return clock.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=f"{trigger_millis} milliseconds").start()


def run(spark: SparkSession, prepared: str, out: str, checkpoint: str, parts: int, trigger_millis: int = 0) -> None:
    """Publishes the parts that aren't there yet, and ends."""
    query = start(spark, prepared, out, checkpoint, trigger_millis)
    try:
        while not exists(spark, f"{out}/batch={parts - 1}"):
            query.awaitTermination(0.1)  # raises what it failed with
    finally:
        query.stop()
