"""The queries' results in SQL, for engines other than Spark."""

HOUR = 3_600_000

TRADES = """
trades AS (SELECT printf('T%09d', event_id) AS tradeId, 'SYM' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS symbol,
  CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, CAST(floor(value) AS BIGINT) + 1 AS each, epoch_us(ts) // 1000 AS eventTime
  FROM events WHERE event_type IN ('purchase', 'signup')),
symbol_updates AS (SELECT symbol AS key, symbol, CASE side WHEN 'BUY' THEN 4 * each ELSE -4 * each END AS signedQuantity, tradeId, eventTime FROM trades),
account_updates AS (SELECT a || '/SUB1/' || symbol AS key, symbol, CASE side WHEN 'BUY' THEN each ELSE -each END AS signedQuantity, tradeId, eventTime
  FROM trades, (SELECT unnest(['ACC1', 'ACC2', 'ACC3', 'ACC4']) AS a))"""

PRICES = """
prices AS (SELECT event_id AS seq, 'SYM' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 4) AS symbol,
  CAST((CAST(json_extract_string(props, '$.k') AS BIGINT) + 4) * 0.25 AS DECIMAL(18,2)) AS price, epoch_us(ts) // 1000 AS eventTime
  FROM events WHERE event_type IN ('view', 'click'))"""


def positions(side: str) -> str:
    return f"""
{side}_positions AS (SELECT key, symbol, CAST(sum(signedQuantity) OVER w AS BIGINT) AS quantity, tradeId AS lastTradeId,
  row_number() OVER w AS updateCount, eventTime FROM {side}_updates
  WINDOW w AS (PARTITION BY key ORDER BY eventTime, tradeId ROWS UNBOUNDED PRECEDING))"""


def market_values(side: str, w: int = HOUR, most: int = 240) -> str:
    """By an as-of join of each close with the latest position and price before it."""
    return f"""
{side}_closes AS (SELECT key, symbol, unnest(generate_series(a, b, {w})) AS windowEnd FROM (
  SELECT key, symbol, min(eventTime) // {w} * {w} + {w} AS a,
    (SELECT (least((SELECT max(eventTime) FROM trades), (SELECT max(eventTime) FROM prices)) - 1) // {w} * {w}) AS b
  FROM {side}_positions GROUP BY key, symbol) WHERE a <= b),
{side}_held AS (SELECT c.key, c.symbol, c.windowEnd, p.quantity, p.lastTradeId FROM {side}_closes c
  ASOF JOIN {side}_positions p ON c.key = p.key AND c.windowEnd > p.eventTime),
{side}_values AS (SELECT h.key, h.symbol, h.quantity, r.price, CAST(h.quantity * r.price AS DECIMAL(38,2)) AS marketValue, h.lastTradeId, h.windowEnd
  FROM {side}_held h ASOF JOIN prices r ON h.symbol = r.symbol AND h.windowEnd > r.eventTime
  WHERE h.windowEnd - (r.eventTime // {w} * {w} + {w}) < {most * w})"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BASE = (TRADES, PRICES, positions("symbol"), positions("account"))
ALL = (*BASE, market_values("symbol"), market_values("account"))
LINES = """
line_updates AS (SELECT 'P' || (l_partkey % 50) AS key, 'P' || (l_partkey % 50) AS symbol,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS BIGINT) AS signedQuantity,
  printf('%012d-%03d-%012d-%012d-%015d', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS tradeId,
  epoch_us(l_shipdate) // 1000 AS eventTime FROM lineitem)"""
