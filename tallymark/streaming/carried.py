"""Running positions by whole micro-batches, with a table of totals between them.

Each micro-batch is worked on as a batch is: a key's updates are cut into time
buckets, whose totals are added up first, so no task holds all of a key's
updates. What one micro-batch hands to the next is a row for each key, its
quantity and number of updates. Nothing runs in Python, and the number of
partitions isn't bound to the checkpoint.

A micro-batch's result and totals are written under its number. Both come from
the totals before it and from its own records alone, so if it is run again after
a failure they are the same; the result is put in place by one rename, and left
alone if it is there already. So each is there once, whole.

Every micro-batch reads the totals of all keys. Where a micro-batch has far fewer
updates than there are keys, keyed state (processors.RunningPosition) costs less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import positions
from ..scratch import exists, remove, rename

TOTALS = "key STRING, quantity BIGINT, updates BIGINT"


def totals_after(spark: SparkSession, place: str, number: int) -> DataFrame | None:
    return spark.read.schema(TOTALS).parquet(f"{place}/{number}") if exists(spark, f"{place}/{number}") else None


def advance(updates: DataFrame, before: DataFrame | None, bucket_millis: int) -> tuple[DataFrame, DataFrame]:
    """The position after each update, and each key's totals after all of them."""
    rows = positions.running(updates, bucket_millis, before)
    now = updates.groupBy("key").agg(F.sum("signedQuantity").alias("quantity"), F.count(F.lit(1)).alias("updates"))
    if before is not None:
        now = before.unionByName(now).groupBy("key").agg(F.sum("quantity").alias("quantity"), F.sum("updates").alias("updates"))
    return rows, now.select("key", "quantity", "updates")


def start(updates: DataFrame, as_records, out: str, checkpoint: str, name: str, trigger: dict, opening: DataFrame | None = None, bucket_millis: int = positions.DAY) -> StreamingQuery:
    """Writes positions to batch=0, batch=1, ... of `out`, as as_records() makes
    them. opening: totals of another run to go on from."""
    place = f"{checkpoint}/totals"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = totals_after(spark, place, number - 1) if number else opening
        own = batch.persist()
        try:
            rows, now = advance(own, before, bucket_millis)
            now.write.mode("overwrite").parquet(f"{place}/{number}")
            done, work = f"{out}/batch={number}", f"{out}/_work-{number}"
            if not exists(spark, done):
                as_records(rows).write.mode("overwrite").parquet(work)
                rename(spark, work, done)
        finally:
            own.unpersist()
        remove(spark, f"{place}/{number - 2}")

    return updates.writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(**trigger).start()
