"""Reconciliation: each check is a row (name, expected, actual, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import market_value, on_a_quarter
from ..functions.keys import well_formed
from ..operators import closing, positions
from ..scratch import written


def _rows(facts: DataFrame, checks: dict[str, tuple[Column | int, Column | int]]) -> DataFrame:
    """facts: one row. checks: name -> expected and actual over its columns."""
    as_long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    each = F.array(*(F.struct(F.lit(n).alias("name"), as_long(e).alias("expected"), as_long(a).alias("actual")) for n, (e, a) in checks.items()))
    out = facts.select(F.inline(each))
    return out.withColumn("ok", F.col("expected").eqNullSafe(F.col("actual")))


def _count(name: str, rows: DataFrame, expected: int = 0) -> DataFrame:
    return _rows(rows.agg(F.count(F.lit(1)).alias("n")), {name: (expected, F.col("n"))})


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, parts)


def orders(trades: DataFrame, accounts: int, symbols: list[str], expected: Column | int) -> DataFrame:
    """Counts (how many orders there should be), keys, sums and ids of the block
    trades, in two passes."""
    total = F.aggregate("allocations", F.lit(0).cast("bigint"), lambda s, a: s + a["quantity"])
    facts = trades.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"), F.sum(F.size("allocations")).alias("allocations"), F.count(F.when(total != F.col("quantity"), 1)).alias("unequal"),
        F.count_distinct("side").alias("sides"), F.count_distinct("tradeId").alias("ids"),
    )
    keys = positions.split(trades).agg(F.count_distinct("key").alias("keys"), F.count(F.when(~well_formed("key", accounts, symbols), 1)).alias("bad"))
    n = F.col("n")
    return union(
        _rows(facts, {
            "orders": (expected, F.col("ids")), "unique symbols": (len(symbols), F.col("symbols")), "allocations": (n * accounts, F.col("allocations")), "blocks unlike their allocations": (0, F.col("unequal")),
            "both sides": (2, F.col("sides")), "duplicate trade ids": (0, n - F.col("ids")),
        }),
        _rows(keys, {"unique account keys": (accounts * len(symbols), F.col("keys")), "malformed account keys": (0, F.col("bad"))}),
    )


def prices(rows: DataFrame, symbols: int) -> DataFrame:
    facts = rows.agg(F.count_distinct("symbol").alias("symbols"), F.count(F.when(F.col("price") <= 0, 1)).alias("low"), F.count(F.when(~on_a_quarter("price"), 1)).alias("odd"))
    return _rows(facts, {"price symbols": (symbols, F.col("symbols")), "prices not positive": (0, F.col("low")), "prices off a quarter": (0, F.col("odd"))})


def _by_key(positions_: DataFrame, whole: bool) -> DataFrame:
    """One row per key: its updates, its last position and whether its counts run 1..n."""
    n = F.count(F.lit(1))
    sound = (F.min("updateCount") == 1) & (F.max("updateCount") == n) & (F.count_distinct("updateCount") == n)
    return positions_.groupBy("key", "symbol").agg(n.alias("n"), F.max_by("quantity", "updateCount").alias("quantity"), sound.alias("sound")).withColumn("whole", F.lit(whole))


def running(by_symbol: DataFrame, by_account: DataFrame, accounts: int, symbols: list[str]) -> DataFrame:
    """Both sides' keys, counts and totals, from one row per key."""
    both = written(_by_key(by_symbol, True).union(_by_key(by_account, False)), "check-keys")  # a row per key, looked at twice
    whole, split = F.col("whole"), ~F.col("whole")
    of = lambda side, x: F.coalesce(F.sum(F.when(side, x)), F.lit(0))
    facts = both.agg(
        of(whole, F.col("n")).alias("n"), F.count_if(whole).alias("keys"), of(split, F.col("n")).alias("m"), F.count_if(split).alias("account_keys"),
        F.count_if(split & ~well_formed("key", accounts, symbols)).alias("bad"), F.count_if(whole & ~F.col("sound")).alias("broken"), F.count_if(split & ~F.col("sound")).alias("account_broken"),
    )
    totals = both.groupBy("symbol").agg(F.sum(F.when(whole, F.col("quantity"))).alias("a"), F.sum(F.when(split, F.col("quantity"))).alias("b"))
    return union(
        _rows(facts, {
            "symbol keys": (len(symbols), F.col("keys")), "account keys": (accounts * len(symbols), F.col("account_keys")),
            "account updates": (F.col("n") * accounts, F.col("m")), "malformed keys": (0, F.col("bad")),
            "symbols with broken counts": (0, F.col("broken")), "accounts with broken counts": (0, F.col("account_broken")),
        }),
        _count("unequal totals", totals.filter(~F.col("a").eqNullSafe(F.col("b")))),
    )


def values(mv: DataFrame, positions_: DataFrame, ticks: DataFrame, window_millis: int, keys: int, label: str, price_windows: int | None = 240, floor: int = 1) -> DataFrame:
    """Market values against the streams that fed them, recomputed apart: one
    pass over the values, then one row per key, then one per last window. At
    least `floor` windows must have values."""
    until = mv.agg(F.max("windowEnd").alias("m")).scalar()
    price = closing.carried(closing.closing_prices(ticks, window_millis), "symbol", until, window_millis, price_windows).select("symbol", "windowEnd", F.col("price").alias("p"))
    held = closing.carried(closing.closing_positions(positions_, window_millis), "key", until, window_millis).select("key", "windowEnd", F.col("quantity").alias("q"))
    before = F.lag("windowEnd").over(Window.partitionBy("key").orderBy("windowEnd"))
    joined = mv.join(price, ["symbol", "windowEnd"], "left").join(held, ["key", "windowEnd"], "left").withColumn("step", F.col("windowEnd") - before)
    unlike = lambda a, b: F.count_if(~F.col(a).eqNullSafe(b))
    each = joined.groupBy("key").agg(
        F.max("windowEnd").alias("last"), (F.count_if(F.col("step") != window_millis) > 0).cast("int").alias("gap"), F.count_if(F.col("step") == 0).alias("twice"),
        unlike("marketValue", market_value("quantity", "price")).alias("wrong"), unlike("price", F.col("p")).alias("price"), unlike("quantity", F.col("q")).alias("quantity"),
    )
    names = ("gap", "twice", "wrong", "price", "quantity")
    by_end = each.groupBy("last").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names))
    facts = by_end.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), F.coalesce(F.max_by("n", "last"), F.lit(0)).alias("at_end"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
    facts = facts.withColumn("windows", mv.agg(F.count_distinct("windowEnd").alias("n")).scalar())
    return _rows(facts, {
        f"{label} windows up to the floor": (floor, F.least(F.col("windows"), F.lit(floor))), f"{label} keys": (keys, F.col("keys")), f"{label} wrong values": (0, F.col("wrong")), f"{label} keys with a gap": (0, F.col("gap")), f"{label} keys missing from the last window": (0, F.col("keys") - F.col("at_end")),
        f"{label} duplicates": (0, F.col("twice")), f"{label} prices unlike the close": (0, F.col("price")), f"{label} quantities unlike the close": (0, F.col("quantity")),
    })


def state(totals: DataFrame, written: DataFrame, label: str) -> DataFrame:
    """A stream's state (key, quantity, updates) against each key's last written position."""
    last = positions.final(written).select("key", F.col("quantity").alias("q"), F.col("updateCount").alias("n"), F.lit(1).alias("there"))
    both = totals.withColumn("held", F.lit(1)).join(last, "key", "full_outer")
    differ = lambda a, b: F.count_if(~F.col(a).eqNullSafe(F.col(b)))
    facts = both.agg(F.count("there").alias("written"), F.count("held").alias("held"), differ("held", "there").alias("alone"), differ("quantity", "q").alias("quantity"), differ("updates", "n").alias("updates"))
    return _rows(facts, {f"{label} keys in state": (F.col("written"), F.col("held")), f"{label} keys on one side": (0, F.col("alone")), f"{label} unequal quantities": (0, F.col("quantity")), f"{label} unequal update counts": (0, F.col("updates"))})
