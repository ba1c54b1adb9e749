"""Trades and prices out of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import trade_id

#: Fixed values of the mapping: the account universe, and event types by meaning.
ACCOUNTS = ("ACC1", "ACC2", "ACC3", "ACC4")
SUB_ACCOUNT = "SUB1"
SYMBOLS = ("SYM0", "SYM1", "SYM2", "SYM3")
SIDES = {"purchase": "BUY", "signup": "SELL"}
TICKS = ("view", "click")

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str = "ts") -> Column:
    """Epoch milliseconds of a timestamp without zone, taken as UTC."""
    return F.unix_millis(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _symbol() -> Column:
    return F.concat(F.lit("SYM"), (_k() % 4).cast("string"))


def event_trades(events: DataFrame) -> DataFrame:
    """Block trades: purchases buy and signups sell, four equal allocations."""
    each = F.floor("value").cast("bigint") + 1
    side = F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL")
    allocations = F.array(*(F.struct(F.lit(a).alias("account"), each.alias("quantity"), F.lit(SUB_ACCOUNT).alias("subAccount")) for a in ACCOUNTS))
    return events.filter(F.col("event_type").isin(*SIDES)).select(allocations.alias("allocations"), millis().alias("eventTime"), (each * 4).alias("quantity"), side.alias("side"), _symbol().alias("symbol"), trade_id("event_id").alias("tradeId"))


def event_prices(events: DataFrame) -> DataFrame:
    """Price ticks: views and clicks, in quarters; seq is the order of arrival."""
    price = ((_k() + 4) * F.lit("0.25").cast("decimal(18,2)")).cast("decimal(18,2)")
    return events.filter(F.col("event_type").isin(*TICKS)).select(millis().alias("eventTime"), price.alias("price"), _symbol().alias("symbol"), F.col("event_id").alias("seq"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trades(read(spark, sf_dir, "events"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_prices(read(spark, sf_dir, "events"))


def line_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger set of updates: each line of an order, sold if it was returned,
    on its part's symbol; the id has all that tells lines apart."""
    lines = read(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("bigint")
    # extendedprice as cents, so that its digits are the same wherever it is printed
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    ident = F.format_string("%012d-%03d-%012d-%012d-%015d", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)
    symbol = F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string"))
    return lines.select(symbol.alias("key"), symbol.alias("symbol"), side.alias("signedQuantity"), ident.alias("tradeId"), millis("l_shipdate").alias("eventTime"))
