"""Keys and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "/"


def account_key(account: Column | str, sub_account: Column | str, symbol: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, account, sub_account, symbol)


def symbol_of(key: Column | str) -> Column:
    """The symbol of an account key; a value without a separator raises."""
    key = F.col(key) if isinstance(key, str) else key
    bad = F.raise_error(F.concat(F.lit("not an account key: "), key)).cast("string")
    return F.when(F.instr(key, SEPARATOR) > 0, F.substring_index(key, SEPARATOR, -1)).when(key.isNull(), F.lit(None)).otherwise(bad)


def trade_id(n: Column | str) -> Column:
    """Ids that sort in the order of their numbers."""
    return F.format_string("T%09d", n)


def well_formed(key: Column | str, accounts: int, symbols: list[str]) -> Column:
    """True for ACCn/SUB1/symbol keys of the given universe."""
    key = F.col(key) if isinstance(key, str) else key
    return key.rlike(rf"\AACC[1-{accounts}]/SUB1/(?:{'|'.join(symbols)})\z")
