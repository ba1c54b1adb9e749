"""Record schemas. Columns are in the order of their JSON keys."""

ALLOCATION = "STRUCT<account: STRING, quantity: BIGINT, subAccount: STRING>"
BLOCK_TRADE = f"allocations ARRAY<{ALLOCATION}>, eventTime BIGINT, quantity BIGINT, side STRING, symbol STRING, tradeId STRING"
PRICE = "eventTime BIGINT, price DECIMAL(18,2), symbol STRING"
POSITION = "eventTime BIGINT, key STRING, lastTradeId STRING, quantity BIGINT, symbol STRING, updateCount BIGINT"
MARKET_VALUE = "key STRING, lastTradeId STRING, marketValue DECIMAL(38,2), price DECIMAL(18,2), quantity BIGINT, symbol STRING, windowEnd BIGINT"
UPDATE = "key STRING, symbol STRING, signedQuantity BIGINT, tradeId STRING, eventTime BIGINT"


def names(schema: str) -> list[str]:
    """Top-level column names of one of the flat schemas above."""
    return [part.split()[0] for part in schema.split(", ")]
