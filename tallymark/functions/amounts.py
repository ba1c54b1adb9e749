"""Quantities and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(side: Column | str, quantity: Column | str) -> Column:
    """BUY adds, SELL takes away; any other side raises."""
    side = F.col(side) if isinstance(side, str) else side
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    bad = F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce(side, F.lit("null")))).cast("bigint")
    return F.when(side == "BUY", quantity).when(side == "SELL", -quantity).otherwise(bad)


def market_value(quantity: Column | str, price: Column | str) -> Column:
    """Exact: a decimal of the price's two places."""
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    price = F.col(price) if isinstance(price, str) else price
    return (price * quantity).cast("decimal(38,2)")


def on_a_quarter(price: Column | str) -> Column:
    price = F.col(price) if isinstance(price, str) else price
    return F.pmod(price * 4, F.lit(1)) == 0
