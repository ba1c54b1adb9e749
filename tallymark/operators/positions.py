"""Trades to running positions. Works on batches; split() and by_symbol() on streams too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import signed
from ..functions.keys import account_key

DAY = 86_400_000


def by_symbol(trades: DataFrame) -> DataFrame:
    """One signed update per trade, keyed by symbol: the allocations aren't
    read, so the symbol side has a fraction of the account side's rows."""
    return trades.select(F.col("symbol").alias("key"), "symbol", signed("side", "quantity").alias("signedQuantity"), "tradeId", "eventTime")


def split(trades: DataFrame) -> DataFrame:
    """One signed update per allocation, keyed by account/sub-account/symbol."""
    each = trades.select("symbol", "side", "tradeId", "eventTime", F.inline("allocations"))
    return each.select(account_key("account", "subAccount", "symbol").alias("key"), "symbol", signed("side", "quantity").alias("signedQuantity"), "tradeId", "eventTime")


def running(updates: DataFrame, bucket_millis: int = DAY, opening: DataFrame | None = None) -> DataFrame:
    """The position after each update: running sum, update count 1..n and the
    update's trade, per key in the order of event time and trade id.

    A key's updates are cut into time buckets, whose totals are added up first
    (a few rows per key); then rows are summed within their bucket alone. So a
    key with a large share of all rows is worked on by many tasks, and the
    updates are shuffled once, by key and bucket. opening: key, quantity and
    updates of each key's earlier ones, which are added to its first bucket.
    """
    own = updates.withColumn("bucket", F.floor(F.col("eventTime") / bucket_millis))
    totals = own.groupBy("key", "bucket").agg(F.sum("signedQuantity").alias("quantity"), F.count(F.lit(1)).alias("updates"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    q0, n0 = (F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in ("quantity", "updates"))
    before = totals.select("key", "bucket", q0.alias("q0"), n0.alias("n0"))
    if opening is not None:
        held = opening.select("key", F.col("quantity").alias("q"), F.col("updates").alias("n"))
        more = lambda c, by: (F.col(c) + F.coalesce(by, F.lit(0))).alias(c)
        before = before.join(held, "key", "left").select("key", "bucket", more("q0", F.col("q")), more("n0", F.col("n")))
    within = Window.partitionBy("key", "bucket").orderBy("eventTime", "tradeId").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumn("q", F.sum("signedQuantity").over(within)).withColumn("n", F.count(F.lit(1)).over(within))
    both = summed.join(before, ["key", "bucket"])
    return both.select("key", "symbol", (F.col("q0") + F.col("q")).alias("quantity"), F.col("tradeId").alias("lastTradeId"), (F.col("n0") + F.col("n")).alias("updateCount"), "eventTime")


def final(positions: DataFrame) -> DataFrame:
    """Each key's position after its last update."""
    return positions.groupBy("key", "symbol").agg(F.max_by("quantity", "updateCount").alias("quantity"), F.max("updateCount").alias("updateCount"))


def roll_up(finals: DataFrame) -> DataFrame:
    """Final positions summed by symbol."""
    return finals.groupBy("symbol").agg(F.sum("quantity").alias("quantity"))


def net(updates: DataFrame) -> DataFrame:
    """Net quantity per symbol, and over all symbols (symbol null)."""
    return updates.rollup("symbol").agg(F.sum("signedQuantity").alias("quantity"))
