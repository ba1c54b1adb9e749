"""Closing values of windows, carried over quiet windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import last_boundary, next_boundary


def closing_positions(positions: DataFrame, window_millis: int) -> DataFrame:
    """The position with the greatest event time of each key and window; of
    equal times the later update's."""
    own = positions.withColumn("windowEnd", next_boundary("eventTime", window_millis))
    last = F.max_by(F.struct("quantity", "lastTradeId"), F.struct("eventTime", "updateCount"))
    return own.groupBy("key", "symbol", "windowEnd").agg(last.alias("c")).select("key", "symbol", "windowEnd", "c.quantity", "c.lastTradeId")


def closing_prices(prices: DataFrame, window_millis: int, arrival: str = "seq") -> DataFrame:
    """The last price of each symbol and window, by time, then by arrival."""
    own = prices.withColumn("windowEnd", next_boundary("eventTime", window_millis))
    return own.groupBy("symbol", "windowEnd").agg(F.max_by("price", F.struct("eventTime", arrival)).alias("price"))


def horizon(positions: DataFrame, prices: DataFrame, window_millis: int, delay_millis: int = 0) -> Column:
    """The last boundary that both streams have passed, as a scalar subquery:
    what a watermark over both would have closed. The last window stays open."""
    latest = lambda rows: rows.agg(F.max("eventTime").alias("t"))
    both = latest(positions).union(latest(prices)).agg(F.min("t").alias("t"), F.count("t").alias("n"))
    reached = F.when(F.col("n") == 2, last_boundary(F.col("t") - delay_millis - 1, window_millis))
    return both.select(reached.alias("horizon")).scalar()


def carried(closing: DataFrame, key: str, until: Column, window_millis: int, most_windows: int | None = None) -> DataFrame:
    """A row for each window from a key's first to `until`: a quiet window gets
    the values of the last one that had any, up to most_windows after it.

    Each closing row is repeated up to the next one's window, so the calendar
    is never joined, and rows are made only after ticks are down to one per
    window.
    """
    following = F.lead("windowEnd").over(Window.partitionBy(key).orderBy("windowEnd")) - window_millis
    last = [following, F.col("until")] if most_windows is None else [following, F.col("until"), F.col("windowEnd") + (most_windows - 1) * window_millis]
    spans = closing.withColumn("until", until).withColumn("last", F.least(*last))
    spans = spans.filter(F.col("windowEnd") <= F.col("last"))
    ends = F.explode(F.sequence(F.col("windowEnd"), F.col("last"), F.lit(window_millis).cast("bigint")))
    return spans.withColumn("closeEnd", F.col("windowEnd")).withColumn("windowEnd", ends).drop("until", "last")
