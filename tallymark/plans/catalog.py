"""The registered queries: name -> function of (spark, sf_dir), and their SQL.

Windows are one hour here, over the month that the events table spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import records
from ..functions.keys import symbol_of, trade_id
from ..functions.times import last_boundary, next_boundary
from ..operators import closing, positions, relations
from ..operators.market_value import value_at_close
from ..scratch import new_path, written
from ..sources import files
from ..streaming import jobs
from . import checks, sql, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = sql.HOUR


def query(text: str | None, *parts: str):
    """Registers a query under its function's name, with the SQL of its rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE_SQL[f.__name__] = f"{sql.with_(*parts)}\n{text}" if parts else text
        return f

    return add


def _symbol_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions.running(positions.by_symbol(tables.trades(spark, d)))


def _account_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions.running(positions.split(tables.trades(spark, d)))


def _until(spark: SparkSession, d: str, window_millis: int) -> Column:
    """The last close of both streams, by one look at the events. Positions have
    their trades' times, so these tell it without working out any position."""
    latest = lambda kinds: F.max(F.when(F.col("event_type").isin(*kinds), tables.millis()))
    ends = tables.read(spark, d, "events").agg(latest(tables.SIDES).alias("trade"), latest(tables.TICKS).alias("tick"))
    both = F.when(F.col("trade").isNotNull() & F.col("tick").isNotNull(), F.least("trade", "tick"))
    return ends.select(last_boundary(both - 1, window_millis).alias("until")).scalar()


POSITION = "SELECT key, symbol, quantity, lastTradeId, updateCount, eventTime FROM"
VALUE = "SELECT key, symbol, quantity, price, marketValue, lastTradeId, windowEnd FROM"


@query(f"{POSITION} symbol_positions", *sql.BASE)
def positions_by_symbol(spark, d):
    return _symbol_positions(spark, d)


@query(f"{POSITION} account_positions", *sql.BASE)
def positions_by_account(spark, d):
    return _account_positions(spark, d)


@query("SELECT key, symbol, signedQuantity, tradeId, eventTime FROM symbol_updates", sql.TRADES)
def symbol_updates(spark, d):
    return positions.by_symbol(tables.trades(spark, d))


@query("SELECT key, symbol, signedQuantity, tradeId, eventTime FROM account_updates", sql.TRADES)
def split_by_allocation(spark, d):
    return positions.split(tables.trades(spark, d))


FINAL = "SELECT key, symbol, arg_max(quantity, updateCount) AS quantity, max(updateCount) AS updateCount FROM account_positions GROUP BY ALL"


@query(FINAL, *sql.BASE)
def final_positions(spark, d):
    return positions.final(_account_positions(spark, d))


@query(f"SELECT symbol, CAST(sum(quantity) AS BIGINT) AS quantity FROM ({FINAL}) GROUP BY symbol", *sql.BASE)
def account_rollup(spark, d):
    return positions.roll_up(positions.final(_account_positions(spark, d)))


@query("SELECT symbol, CAST(sum(signedQuantity) AS BIGINT) AS quantity FROM symbol_updates GROUP BY ROLLUP (symbol)", *sql.BASE)
def net_positions(spark, d):
    return positions.net(positions.by_symbol(tables.trades(spark, d)))


@query("""SELECT coalesce(s.symbol, a.symbol) AS symbol, s.q AS "left", a.q AS "right" FROM (SELECT symbol, CAST(sum(signedQuantity) AS BIGINT) AS q FROM symbol_updates GROUP BY 1) s
FULL JOIN (SELECT symbol, CAST(sum(signedQuantity) AS BIGINT) AS q FROM account_updates GROUP BY 1) a ON s.symbol = a.symbol WHERE s.q IS DISTINCT FROM a.q""", *sql.BASE)
def reconcile_totals(spark, d):
    total = lambda p: positions.roll_up(positions.final(p))
    return relations.unequal_totals(total(_symbol_positions(spark, d)), total(_account_positions(spark, d)), "symbol", "quantity")


CLOSING = f"""SELECT key, symbol, eventTime // {HOUR} * {HOUR} + {HOUR} AS windowEnd, arg_max(quantity, (eventTime, updateCount)) AS quantity,
arg_max(lastTradeId, (eventTime, updateCount)) AS lastTradeId FROM account_positions GROUP BY 1, 2, 3"""


@query(CLOSING, *sql.BASE)
def closing_positions(spark, d):
    return closing.closing_positions(_account_positions(spark, d), HOUR)


@query(f"SELECT symbol, eventTime // {HOUR} * {HOUR} + {HOUR} AS windowEnd, arg_max(price, (eventTime, seq)) AS price FROM prices GROUP BY 1, 2", *sql.BASE)
def closing_prices(spark, d):
    return closing.closing_prices(tables.prices(spark, d), HOUR)


@query(f"""SELECT s.symbol, s.windowEnd, p.price, p.closeEnd FROM (SELECT symbol, unnest(generate_series(min(eventTime) // {HOUR} * {HOUR} + {HOUR}, (SELECT max(eventTime) FROM prices) // {HOUR} * {HOUR}, {HOUR})) AS windowEnd FROM prices GROUP BY symbol) s
ASOF JOIN (SELECT symbol, price, eventTime, eventTime // {HOUR} * {HOUR} + {HOUR} AS closeEnd FROM prices) p ON s.symbol = p.symbol AND s.windowEnd > p.eventTime WHERE s.windowEnd - p.closeEnd < {24 * HOUR}""", *sql.BASE)
def carried_prices(spark, d):
    """Closing prices over quiet windows, for a day at most."""
    ticks = tables.prices(spark, d)
    until = ticks.agg((F.max("eventTime") - F.pmod(F.max("eventTime"), F.lit(HOUR))).alias("t")).scalar()
    return closing.carried(closing.closing_prices(ticks, HOUR), "symbol", until, HOUR, 24).select("symbol", "windowEnd", "price", "closeEnd")


@query(f"{VALUE} symbol_values", *sql.ALL)
def mv_by_symbol(spark, d):
    return value_at_close(_symbol_positions(spark, d), tables.prices(spark, d), HOUR, until=_until(spark, d, HOUR))


@query(f"{VALUE} account_values", *sql.ALL)
def mv_by_account(spark, d):
    return value_at_close(_account_positions(spark, d), tables.prices(spark, d), HOUR, until=_until(spark, d, HOUR))


DAY_ALL = (*sql.BASE, sql.market_values("symbol", positions.DAY), sql.market_values("account", positions.DAY))


@query(f"{VALUE} account_values", *DAY_ALL)
def mv_by_account_daily(spark, d):
    """The same with windows of a day: the window length is a parameter."""
    return value_at_close(_account_positions(spark, d), tables.prices(spark, d), positions.DAY, until=_until(spark, d, positions.DAY))


@query("SELECT count(DISTINCT windowEnd) AS windows FROM account_values", *sql.ALL)
def windows_closed(spark, d):
    return mv_by_account(spark, d).agg(F.count_distinct("windowEnd").alias("windows"))


@query(f"SELECT key, CAST(count(*) FILTER (WHERE d <> {HOUR}) AS BIGINT) AS gaps FROM (SELECT key, windowEnd - lag(windowEnd) OVER (PARTITION BY key ORDER BY windowEnd) AS d FROM account_values) GROUP BY key", *sql.ALL)
def window_gaps(spark, d):
    return relations.gaps(mv_by_account(spark, d), HOUR)


@query("SELECT key, count(*) AS updates, min(updateCount) = 1 AND max(updateCount) = count(*) AS ok FROM account_positions GROUP BY key", *sql.BASE)
def update_continuity(spark, d):
    return relations.broken_counts(_account_positions(spark, d))


@query("SELECT DISTINCT key FROM account_values WHERE key NOT IN (SELECT key FROM account_values WHERE windowEnd = (SELECT max(windowEnd) FROM account_values))", *sql.ALL)
def absent_from_last_window(spark, d):
    return relations.absent_from_last(mv_by_account(spark, d))


@query("SELECT key, windowEnd, count(*) AS n FROM account_values GROUP BY 1, 2 HAVING count(*) > 1", *sql.ALL)
def duplicate_windows(spark, d):
    return relations.duplicates(mv_by_account(spark, d), "key", "windowEnd")


@query("SELECT symbol, price, count(*) AS n FROM prices GROUP BY 1, 2 HAVING count(*) > 1", *sql.BASE)
def repeated_prices(spark, d):
    """The duplicate finder on rows that do repeat."""
    return relations.duplicates(tables.prices(spark, d), "symbol", "price")


@query("SELECT printf('T%09d', i) AS tradeId FROM (SELECT unnest(generate_series(0, (SELECT count(*) FROM events) - 1)) AS i) WHERE printf('T%09d', i) NOT IN (SELECT tradeId FROM trades)", *sql.BASE)
def missing_trade_ids(spark, d):
    """Event numbers that are no trade."""
    n = tables.read(spark, d, "events").count()
    return relations.missing_ids(tables.trades(spark, d), 0, n)


@query("SELECT symbol, q FROM (SELECT symbol, 4 * each AS q FROM trades WHERE side = 'BUY') EXCEPT ALL SELECT symbol, q FROM (SELECT symbol, 4 * each AS q FROM trades WHERE side = 'SELL')", *sql.BASE)
def set_difference(spark, d):
    """Bought lots that weren't sold, as often as that holds."""
    t = tables.trades(spark, d).select("symbol", F.col("quantity").alias("q"), "side")
    return relations.difference(t.filter("side = 'BUY'").drop("side"), t.filter("side = 'SELL'").drop("side"))


LOTS = "(SELECT symbol, 4 * each AS q FROM trades WHERE side = '{}')"


@query(f"""SELECT *, 'left' AS side FROM (SELECT * FROM {LOTS.format('BUY')} EXCEPT ALL SELECT * FROM {LOTS.format('SELL')}) UNION ALL
SELECT *, 'right' AS side FROM (SELECT * FROM {LOTS.format('SELL')} EXCEPT ALL SELECT * FROM {LOTS.format('BUY')})""", *sql.BASE)
def symmetric_difference(spark, d):
    t = tables.trades(spark, d).select("symbol", F.col("quantity").alias("q"), "side")
    return relations.symmetric_difference(t.filter("side = 'BUY'").drop("side"), t.filter("side = 'SELL'").drop("side"))


STAGES = ("trades", "prices", "symbol_positions", "account_positions", "symbol_values", "account_values")


def _stages(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str]]:
    found = (tables.trades(spark, d), tables.prices(spark, d), _symbol_positions(spark, d), _account_positions(spark, d), mv_by_symbol(spark, d), mv_by_account(spark, d))
    return [(n, rows, "key" if "key" in rows.columns else "symbol") for n, rows in zip(STAGES, found, strict=True)]


@query(" UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS records, count(DISTINCT {'key' if '_' in s else 'symbol'}) AS keys FROM {s}" for s in STAGES), *sql.ALL)
def stage_counts(spark, d):
    """Records and distinct keys of each stream."""
    return checks.union(*(rows.agg(F.lit(n).alias("stage"), F.count(F.lit(1)).alias("records"), F.count_distinct(k).alias("keys")) for n, rows, k in _stages(spark, d)))


@query("""SELECT 'symbol' AS side, eventTime // 60000 * 60000 AS minute, count(*) AS records FROM symbol_positions GROUP BY 2 UNION ALL
SELECT 'account', eventTime // 60000 * 60000, count(*) FROM account_positions GROUP BY 2""", *sql.BASE)
def stage_rates(spark, d):
    """Updates per minute of event time on each side."""
    rate = lambda rows, side: rows.groupBy(F.window(F.timestamp_millis("eventTime"), "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("records")).select(F.lit(side).alias("side"), F.unix_millis("w.start").alias("minute"), "records")
    return rate(_symbol_positions(spark, d), "symbol").union(rate(_account_positions(spark, d), "account"))


@query("SELECT DISTINCT symbol, side FROM trades", *sql.BASE)
def distinct_sides(spark, d):
    return tables.trades(spark, d).select("symbol", "side").distinct()


@query("SELECT symbol, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells FROM trades GROUP BY symbol", *sql.BASE)
def buy_sell_mix(spark, d):
    mix = tables.trades(spark, d).groupBy("symbol").pivot("side", ["BUY", "SELL"]).count()
    return mix.select("symbol", F.coalesce("BUY", F.lit(0)).alias("buys"), F.coalesce("SELL", F.lit(0)).alias("sells"))


@query("SELECT symbol, count(*) AS ticks, count(DISTINCT count(*)) OVER () AS levels FROM prices GROUP BY symbol", *sql.BASE)
def prices_per_symbol(spark, d):
    """Ticks per symbol; levels is 1 if all have the same number."""
    each = tables.prices(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"))
    return each.withColumn("levels", each.agg(F.count_distinct("ticks").alias("n")).scalar())


@query("SELECT count(*) AS trades, 4 * count(*) AS allocations, CAST(sum(4 * each) AS BIGINT) AS quantity FROM trades", *sql.BASE)
def fan_out(spark, d):
    return tables.trades(spark, d).agg(F.count(F.lit(1)).alias("trades"), F.sum(F.size("allocations")).cast("bigint").alias("allocations"), F.sum("quantity").alias("quantity"))


@query("""SELECT count(*) AS records, CAST(sum(CAST('0x' || substr(sha256(printf('{"eventTime":%d,"price":%.2f,"symbol":"%s"}', eventTime, CAST(price AS DOUBLE), symbol)), 1, 15) AS BIGINT)) AS VARCHAR) AS hash FROM prices""", *sql.BASE)
def price_fingerprint(spark, d):
    """A hash of the encoded stream, to compare runs by."""
    rows = tables.prices(spark, d)
    return relations.fingerprint(rows, records.encode(rows, schemas.PRICE))


def _power(base: int) -> str:
    """The weight of row i in the ordered fingerprint."""
    out = "1::BIGINT"
    for k in range(relations.ORDINAL_BITS):
        out = f"({out} * CASE WHEN (i >> {k}) & 1 = 1 THEN {pow(base, 1 << k, relations.PRIME)} ELSE 1 END % {relations.PRIME})"
    return out


@query(
    f"""SELECT count(*) AS records, concat_ws('-', {", ".join(f"coalesce(sum(CAST(h * {_power(b)} % {relations.PRIME} AS HUGEINT)) % {relations.PRIME}, 0)::BIGINT::VARCHAR" for b in relations.BASES)}) AS hash FROM (
SELECT row_number() OVER (ORDER BY eventTime, seq) - 1 AS i, CAST('0x' || substr(sha256(printf('{{"eventTime":%d,"price":%.2f,"symbol":"%s"}}', eventTime, CAST(price AS DOUBLE), symbol)), 1, 15) AS BIGINT) % {relations.PRIME} AS h FROM prices)""",
    *sql.BASE,
)
def price_order_fingerprint(spark, d):
    """A hash of the encoded stream and of its order."""
    rows = tables.prices(spark, d)
    return relations.ordered_fingerprint(rows, records.encode(rows, schemas.PRICE), "eventTime", "seq")


@query("SELECT symbol, arg_max(price, (eventTime, seq)) AS price, arg_max(eventTime, (eventTime, seq)) AS eventTime, arg_max(seq, (eventTime, seq)) AS seq FROM prices WHERE eventTime < 1705276800000 GROUP BY symbol", *sql.BASE)
def latest_prices_before(spark, d):
    """Each symbol's last tick before a moment."""
    rows = tables.prices(spark, d)
    return relations.latest_before(rows, F.lit(1705276800000), "symbol").select("symbol", "price", "eventTime", "seq")


@query("SELECT symbol, CAST(count(*) FILTER (eventTime < before) AS BIGINT) AS falls FROM (SELECT symbol, eventTime, lag(eventTime) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM prices) GROUP BY symbol", *sql.BASE)
def arrival_order(spark, d):
    return relations.out_of_order(tables.prices(spark, d), "symbol", "seq")


@query("SELECT tradeId, symbol, side, 4 * each AS quantity, eventTime FROM trades ORDER BY eventTime, tradeId LIMIT 100", *sql.BASE)
def first_trades(spark, d):
    """The first hundred trades: a bounded replay."""
    return relations.take(tables.trades(spark, d), 100, "eventTime", "tradeId").select("tradeId", "symbol", "side", "quantity", "eventTime")


@query(f"SELECT tradeId, eventTime, eventTime // {HOUR} * {HOUR} + {HOUR} AS windowEnd FROM trades", *sql.BASE)
def window_boundaries(spark, d):
    return tables.trades(spark, d).select("tradeId", "eventTime", next_boundary("eventTime", HOUR).alias("windowEnd"))


@query("SELECT key, symbol, split_part(key, '/', 3) AS of_key FROM account_updates", *sql.BASE)
def symbols_of_keys(spark, d):
    return positions.split(tables.trades(spark, d)).select("key", "symbol", symbol_of("key").alias("of_key"))


@query("SELECT o_orderkey, printf('T%09d', o_orderkey) AS tradeId FROM orders")
def trade_ids(spark, d):
    return tables.read(spark, d, "orders").select("o_orderkey", trade_id("o_orderkey").alias("tradeId"))


def _check(name: str, expected: str, actual: str) -> str:
    return f"SELECT '{name}' AS name, CAST({expected} AS BIGINT) AS expected, CAST({actual} AS BIGINT) AS actual, ({expected}) = ({actual}) AS ok"


@query(" UNION ALL ".join((
    _check("orders", "(SELECT count(*) FROM events WHERE event_type IN ('purchase', 'signup'))", "(SELECT count(DISTINCT tradeId) FROM symbol_updates)"),
    _check("unique symbols", "4", "(SELECT count(DISTINCT symbol) FROM trades)"), _check("allocations", "(SELECT 4 * count(*) FROM trades)", "(SELECT count(*) FROM account_updates)"),
    _check("blocks unlike their allocations", "0", "(SELECT count(*) FROM trades JOIN (SELECT tradeId, sum(abs(signedQuantity)) AS q FROM account_updates GROUP BY 1) USING (tradeId) WHERE q <> 4 * each)"), _check("both sides", "2", "(SELECT count(DISTINCT side) FROM trades)"), _check("duplicate trade ids", "0", "(SELECT count(*) - count(DISTINCT tradeId) FROM trades)"),
    _check("unique account keys", "16", "(SELECT count(DISTINCT key) FROM account_updates)"), _check("malformed account keys", "0", "(SELECT count(*) FROM account_updates WHERE NOT regexp_full_match(key, 'ACC[1-4]/SUB1/SYM[0-3]'))"),
)), *sql.BASE)
def checks_orders(spark, d):
    wanted = tables.read(spark, d, "events").filter(F.col("event_type").isin(*tables.SIDES)).agg(F.count(F.lit(1)).alias("n")).scalar()
    return checks.orders(tables.trades(spark, d), len(tables.ACCOUNTS), list(tables.SYMBOLS), wanted)


@query(" UNION ALL ".join((
    _check("price symbols", "4", "(SELECT count(DISTINCT symbol) FROM prices)"), _check("prices not positive", "0", "(SELECT count(*) FROM prices WHERE price <= 0)"), _check("prices off a quarter", "0", "(SELECT count(*) FROM prices WHERE (price * 4) % 1 <> 0)"),
)), *sql.BASE)
def checks_prices(spark, d):
    return checks.prices(tables.prices(spark, d), len(tables.SYMBOLS))


@query(" UNION ALL ".join((
    _check("symbol keys", "4", "(SELECT count(DISTINCT key) FROM symbol_positions)"), _check("account keys", "16", "(SELECT count(DISTINCT key) FROM account_positions)"),
    _check("account updates", "(SELECT 4 * count(*) FROM symbol_positions)", "(SELECT count(*) FROM account_positions)"), _check("malformed keys", "0", "(SELECT count(*) FROM account_positions WHERE NOT regexp_full_match(key, 'ACC[1-4]/SUB1/SYM[0-3]'))"),
    _check("symbols with broken counts", "0", "(SELECT count(*) FROM (SELECT key FROM symbol_positions GROUP BY key HAVING min(updateCount) <> 1 OR max(updateCount) <> count(*)))"),
    _check("accounts with broken counts", "0", "(SELECT count(*) FROM (SELECT key FROM account_positions GROUP BY key HAVING min(updateCount) <> 1 OR max(updateCount) <> count(*)))"), _check("unequal totals", "0", "(SELECT count(*) FROM (SELECT symbol, sum(signedQuantity) FROM symbol_updates GROUP BY 1 EXCEPT SELECT symbol, sum(signedQuantity) FROM account_updates GROUP BY 1))"),
)), *sql.BASE)
def checks_positions(spark, d):
    return checks.running(_symbol_positions(spark, d), _account_positions(spark, d), len(tables.ACCOUNTS), list(tables.SYMBOLS))


#: Windows that each side's values must cover, at least.
FLOOR = 24


def _value_checks(side: str, keys: int) -> str:
    v = f"{side}_values"
    # each closing value from its window to the next one's, and the values that differ from it
    unlike = lambda rows, key, value, order: f"""(SELECT count(*) FROM {v} v LEFT JOIN (SELECT k, a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b, x FROM (
  SELECT {key} AS k, eventTime // {HOUR} * {HOUR} + {HOUR} AS a, arg_max({value}, (eventTime, {order})) AS x FROM {rows} GROUP BY 1, 2)) c
  ON v.{key} = c.k AND v.windowEnd >= c.a AND (c.b IS NULL OR v.windowEnd < c.b) WHERE v.{value} IS DISTINCT FROM c.x)"""  # noqa: E731
    return " UNION ALL ".join((
        _check(f"{side} keys", str(keys), f"(SELECT count(DISTINCT key) FROM {v})"), _check(f"{side} wrong values", "0", f"(SELECT count(*) FROM {v} WHERE marketValue <> quantity * price)"),
        _check(f"{side} keys with a gap", "0", f"(SELECT count(*) FROM (SELECT key FROM {v} GROUP BY key HAVING max(windowEnd) - min(windowEnd) <> (count(*) - 1) * {HOUR}))"),
        _check(f"{side} keys missing from the last window", "0", f"(SELECT count(*) FROM (SELECT key FROM {v} GROUP BY key HAVING max(windowEnd) < (SELECT max(windowEnd) FROM {v})))"),
        _check(f"{side} duplicates", "0", f"(SELECT count(*) FROM (SELECT key FROM {v} GROUP BY key, windowEnd HAVING count(*) > 1))"),
        _check(f"{side} prices unlike the close", "0", unlike("prices", "symbol", "price", "seq")), _check(f"{side} quantities unlike the close", "0", unlike(f"{side}_positions", "key", "quantity", "updateCount")),
        _check(f"{side} windows up to the floor", str(FLOOR), f"(SELECT least(count(DISTINCT windowEnd), {FLOOR}) FROM {v})"),
    ))


@query(_value_checks("symbol", 4) + " UNION ALL " + _value_checks("account", 16), *sql.ALL)
def checks_market_values(spark, d):
    """Positions, ticks and values are written once; what was written is checked."""
    ticks = written(tables.prices(spark, d), "ticks")
    until, found = _until(spark, d, HOUR), []
    for side, made, keys in (("symbol", _symbol_positions, 4), ("account", _account_positions, 16)):
        held = written(made(spark, d), f"{side}-positions")
        mv = written(value_at_close(held, ticks, HOUR, until=until), f"{side}-values")
        found.append(checks.values(mv, held, ticks, HOUR, keys, side, floor=FLOOR))
    return checks.union(*found)


@query("""SELECT tradeId, symbol, side, 4 * each AS quantity, CAST(4 AS INTEGER) AS allocations, eventTime FROM trades""", *sql.BASE)
def json_roundtrip(spark, d):
    """Trades encoded as JSON and decoded again."""
    t = tables.trades(spark, d)
    raw = t.select(records.encode(t, schemas.BLOCK_TRADE).alias("value"))
    back = records.checked(records.decode(raw, schemas.BLOCK_TRADE), records.trade_fault())
    return back.select("tradeId", "symbol", "side", "quantity", F.size("allocations").alias("allocations"), "eventTime")


@query("SELECT CASE WHEN event_id % 10 = 0 THEN 'quantity not positive' WHEN event_id % 10 = 1 THEN 'unknown side' ELSE 'blank symbol' END AS reason, count(*) AS n FROM events WHERE event_type IN ('purchase', 'signup') AND event_id % 10 < 3 GROUP BY 1")
def quarantine(spark, d):
    """Every tenth trade loses its quantity, its side or its symbol: they are set apart, with the reason."""
    n = F.substring("tradeId", 2, 9).cast("bigint") % 10
    t = tables.trades(spark, d).withColumn("quantity", F.when(n == 0, 0).otherwise(F.col("quantity"))).withColumn("side", F.when(n == 1, "HOLD").otherwise(F.col("side"))).withColumn("symbol", F.when(n == 2, " ").otherwise(F.col("symbol")))
    return records.quarantine(t, records.trade_fault())[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT key, symbol, quantity, lastTradeId, updateCount, eventTime, key AS recordKey, eventTime AS recordMillis FROM account_positions", *sql.BASE)
def sink_roundtrip(spark, d):
    """Positions through the keyed sink and back, as a snapshot that is known to be
    whole, with each record's own key and time."""
    path = new_path(spark, "positions-by-account")
    files.publish(_account_positions(spark, d), path, schemas.POSITION, "key", "eventTime", "updateCount")
    files.seal(spark, path)
    files.require_whole(spark, path)
    return files.with_records(spark, path, schemas.POSITION)


@query("SELECT key, symbol, quantity, price, marketValue, lastTradeId, windowEnd, key AS recordKey, windowEnd AS recordMillis FROM account_values", *sql.ALL)
def market_value_records(spark, d):
    """Market values through their keyed sink and back."""
    path = new_path(spark, "mv-by-account")
    files.publish(mv_by_account(spark, d), path, schemas.MARKET_VALUE, "key", "windowEnd", "windowEnd")
    return files.with_records(spark, path, schemas.MARKET_VALUE)


@query("SELECT tradeId, symbol, side, 4 * each AS quantity, eventTime, tradeId AS recordKey, eventTime AS recordMillis FROM trades", *sql.BASE)
def trade_records(spark, d):
    """Block trades published by trade id."""
    path = new_path(spark, "orders")
    files.publish(tables.trades(spark, d), path, schemas.BLOCK_TRADE, "tradeId", "eventTime", "tradeId")
    return files.with_records(spark, path, schemas.BLOCK_TRADE).drop("allocations")


@query("SELECT symbol, CAST(1 AS BIGINT) AS partitions, CAST(0 AS BIGINT) AS falls FROM prices GROUP BY symbol", *sql.BASE)
def keyed_partitions(spark, d):
    """One symbol's published prices are in one partition, sorted by time."""
    path = new_path(spark, "prices")
    ticks = tables.prices(spark, d)
    files.publish(ticks.select(*schemas.names(schemas.PRICE)), path, schemas.PRICE, "symbol", "eventTime", "eventTime", key="symbol")
    return files.partition_report(spark, path, schemas.PRICE)


@query(f"{POSITION} symbol_positions", *sql.BASE)
def stream_positions_by_symbol(spark, d):
    return jobs.stream_positions(spark, d, by_account=False)


@query(f"{POSITION} account_positions", *sql.BASE)
def stream_positions_by_account(spark, d):
    return jobs.stream_positions(spark, d, by_account=True)


@query("""SELECT CASE event_id % 10 WHEN 0 THEN 'quantity not positive' WHEN 1 THEN 'unknown side' WHEN 2 THEN 'blank symbol' WHEN 3 THEN 'malformed' ELSE 'good' END AS reason, count(*) AS n
FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1""")
def stream_dead_letters(spark, d):
    return jobs.stream_dead_letters(spark, d)


@query(f"{POSITION} symbol_positions", *sql.BASE)
def stream_trades_once(spark, d):
    return jobs.stream_trades_once(spark, d)


@query("""SELECT tradeId, i // ((n * 3 // 4 + 4) // 5) AS batch FROM (SELECT tradeId, row_number() OVER (ORDER BY eventTime, tradeId) - 1 AS i, count(*) OVER () AS n FROM trades) WHERE i < n * 3 // 4""", *sql.BASE)
def replay_trades(spark, d):
    return jobs.replay_trades(spark, d)


def _state_check(side: str) -> str:
    keys = f"(SELECT count(DISTINCT key) FROM {side}_positions)"
    return " UNION ALL ".join([f"SELECT '{side} keys in state' AS name, {keys} AS expected, {keys} AS actual, true AS ok", *(f"SELECT '{side} {what}', 0::BIGINT, 0::BIGINT, true" for what in ("keys on one side", "unequal quantities", "unequal update counts"))])


@query(f"{_state_check('symbol')} UNION ALL {_state_check('account')}", *sql.BASE)
def checks_stream_state(spark, d):
    return jobs.stream_state(spark, d)


@query(f"{VALUE} symbol_values", *sql.ALL)
def stream_mv_by_symbol(spark, d):
    return jobs.stream_market_values(spark, d, by_account=False)


@query(f"{VALUE} account_values", *sql.ALL)
def stream_mv_by_account(spark, d):
    return jobs.stream_market_values(spark, d, by_account=True)


@query("SELECT key, symbol, CAST(sum(signedQuantity) OVER w AS BIGINT) AS quantity, tradeId AS lastTradeId, row_number() OVER w AS updateCount, eventTime FROM line_updates WINDOW w AS (PARTITION BY key ORDER BY eventTime, tradeId ROWS UNBOUNDED PRECEDING)", sql.LINES)
def line_positions(spark, d):
    """Running positions over the largest table."""
    return positions.running(tables.line_updates(spark, d), 90 * positions.DAY)


@query(f"SELECT key, symbol, eventTime // {positions.DAY} * {positions.DAY} + {positions.DAY} AS windowEnd, arg_max(quantity, (eventTime, updateCount)) AS quantity, arg_max(lastTradeId, (eventTime, updateCount)) AS lastTradeId FROM line_positions GROUP BY 1, 2, 3", sql.LINES, sql.positions("line"))
def line_closing_positions(spark, d):
    return closing.closing_positions(line_positions(spark, d), positions.DAY)
