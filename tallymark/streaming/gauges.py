"""Live numbers of the jobs' streams, kept from run to run.

Each stream reports, by micro-batch, its records, a sketch of its keys and how old
its records were. A listener writes a report as a small file under the micro-batch's
number, so one that is run again replaces its report. Sketches merge: distinct keys
are those of all micro-batches, before and after a restart.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

from ..scratch import put_text

REPORT = "stream STRING, batch BIGINT, at STRING, records BIGINT, keys STRING, median_age_millis BIGINT, p99_age_millis BIGINT, micro_batch_millis BIGINT, input_per_second DOUBLE, late BIGINT"


def observed(rows: DataFrame, name: str, key: str = "key", time: str = "eventTime") -> DataFrame:
    """The rows; each micro-batch reports on them under that name."""
    age = F.unix_millis(F.current_timestamp()) - F.col(time)
    return rows.observe(name, F.count(F.lit(1)).alias("records"), F.hll_sketch_agg(key).alias("keys"), F.percentile_approx(age, [0.5, 0.99]).alias("age"))


class Gauges(StreamingQueryListener):
    """Writes what observed() reports to `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items():
            if not name.startswith("gauge_") or not row["records"]:
                continue
            stream, (median, most) = name.removeprefix("gauge_"), row["age"] or (None, None)
            report = {
                "stream": stream, "batch": p.batchId, "at": p.timestamp, "records": row["records"], "keys": base64.b64encode(bytes(row["keys"])).decode(), "median_age_millis": median, "p99_age_millis": most,
                "micro_batch_millis": p.batchDuration, "input_per_second": p.inputRowsPerSecond, "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            }
            put_text(self.spark, f"{self.path}/{stream}/{p.batchId}.json", json.dumps(report))

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


def reports(spark: SparkSession, path: str) -> DataFrame:
    """A row for each stream and micro-batch that had records."""
    return spark.read.schema(REPORT).json(f"{path}/*")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Each stream's records, distinct keys (about), micro-batches and latency, over all runs."""
    rows = reports(spark, path).withColumn("sketch", F.unbase64("keys"))
    return rows.groupBy("stream").agg(
        F.sum("records").alias("records"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("keys"), F.count(F.lit(1)).alias("batches"),
        F.max("p99_age_millis").alias("p99_age_millis"), F.max("micro_batch_millis").alias("micro_batch_millis"), F.sum("late").alias("late"),
    )


def settle(queries: dict[str, StreamingQuery], spark: SparkSession) -> None:
    """Waits until the listener has heard of all that has happened."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
