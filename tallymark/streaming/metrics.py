"""Live numbers of a running stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def observed(rows: DataFrame, name: str, key: str = "key", time: str = "eventTime") -> DataFrame:
    """The rows; each micro-batch reports its records, about how many keys it
    has, and how old its records are (median and 99th percentile, ms)."""
    age = (F.unix_millis(F.current_timestamp()) - F.col(time)).cast("double")
    return rows.observe(name, F.count(F.lit(1)).alias("records"), F.approx_count_distinct(key).alias("keys"), F.percentile_approx(age, [0.5, 0.99]).alias("age"))


def reports(query: StreamingQuery, name: str) -> list[dict]:
    """What observed() reported of the micro-batches that had input."""
    found = (p.observedMetrics.get(name) for p in query.recentProgress if p.numInputRows)
    return [r.asDict() for r in found if r is not None]


def rates(query: StreamingQuery) -> list[float]:
    """Rows per second of the recent micro-batches that had input."""
    return [p.processedRowsPerSecond for p in query.recentProgress if p.numInputRows]


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their window had closed, and were left out."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
