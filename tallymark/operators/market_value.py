"""Positions at the close times the price at the close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions.amounts import market_value
from .closing import carried, closing_positions, closing_prices, horizon


def value_at_close(positions: DataFrame, prices: DataFrame, window_millis: int, delay_millis: int = 0, price_windows: int | None = 240, until: Column | None = None) -> DataFrame:
    """One row per key and closed window, from the key's first, with the last
    position and the last price before the close. Silent where no price is in
    reach. An as-of join made of aggregations and one equi-join on symbol and
    window, whose price side has a row per symbol and window."""
    until = horizon(positions, prices, window_millis, delay_millis) if until is None else until
    held = carried(closing_positions(positions, window_millis), "key", until, window_millis)
    at = carried(closing_prices(prices, window_millis), "symbol", until, window_millis, price_windows)
    both = held.drop("closeEnd").join(at.drop("closeEnd"), ["symbol", "windowEnd"])
    return both.select("key", "symbol", "quantity", "price", market_value("quantity", "price").alias("marketValue"), "lastTradeId", "windowEnd")
