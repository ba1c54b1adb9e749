"""Decoding, encoding and validity of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def decode(raw: DataFrame, schema: str, value: str = "value", strict: bool = True) -> DataFrame:
    """One column per field of the JSON in `value`. Strict: bad JSON fails the
    query. Otherwise it gives nulls; see quarantine(). inline() keeps the parsed
    record in place: else it is parsed again for each use of a column."""
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    return raw.select(F.inline(F.array(F.from_json(value, schema, options))))


def decode_beside(raw: DataFrame, schema: str, value: str = "value", strict: bool = True) -> DataFrame:
    """decode(), with raw's other columns beside the fields."""
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    others = [c for c in raw.columns if c != value]
    whole = raw.select(*others, F.inline(F.array(F.from_json(value, schema, options))))
    return whole.select(*(c for c in whole.columns if c not in others), *others)


def encode(rows: DataFrame, schema: str) -> Column:
    """JSON with sorted keys and plain decimals, the same bytes every time."""
    return F.to_json(F.struct(*sorted(schemas.names(schema) if "<" not in schema else rows.columns)))


def blank(text: str) -> Column:
    return F.col(text).isNull() | (F.trim(text) == "")


def _faults(*cases: tuple[Column, str]) -> Column:
    """The first fault's name, null if there is none; an unknown condition counts as a fault."""
    found = F.lit(None).cast("string")
    for fault, name in reversed(cases):
        found = F.when(F.coalesce(fault, F.lit(True)), name).otherwise(found)
    return found


def trade_fault() -> Column:
    sum_of = F.aggregate("allocations", F.lit(0).cast("bigint"), lambda s, a: s + a["quantity"])
    bad = F.exists("allocations", lambda a: F.coalesce((F.trim(a["account"]) == "") | (F.trim(a["subAccount"]) == "") | (a["quantity"] <= 0), F.lit(True)))
    return _faults(
        (blank("tradeId"), "blank tradeId"), (blank("symbol"), "blank symbol"), (~F.col("side").isin("BUY", "SELL"), "unknown side"), (F.col("quantity") <= 0, "quantity not positive"),
        (F.size("allocations") < 1, "no allocations"), (bad, "bad allocation"), (sum_of != F.col("quantity"), "allocations don't sum to the block"), (F.col("eventTime").isNull(), "no event time"),
    )


def price_fault() -> Column:
    return _faults((blank("symbol"), "blank symbol"), (F.col("price") <= 0, "price not positive"), (F.col("eventTime").isNull(), "no event time"))


def position_fault() -> Column:
    return _faults((blank("key"), "blank key"), (blank("symbol"), "blank symbol"), (F.col("quantity").isNull(), "no quantity"), (blank("lastTradeId"), "blank lastTradeId"), (F.col("updateCount") <= 0, "updateCount not positive"), (F.col("eventTime").isNull(), "no event time"))


def market_value_fault() -> Column:
    return _faults((blank("key"), "blank key"), (blank("symbol"), "blank symbol"), (F.col("quantity").isNull(), "no quantity"), (F.col("price").isNull(), "no price"), (F.col("marketValue").isNull(), "no market value"))


def checked(rows: DataFrame, fault: Column) -> DataFrame:
    """The rows; a faulty one fails the query."""
    return rows.filter(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True))


def quarantine(rows: DataFrame, fault: Column) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with a `reason`."""
    judged = rows.withColumn("reason", fault)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def judged(raw: DataFrame, schema: str, fault: Column, value: str = "value") -> DataFrame:
    """raw with a `reason`: null for a good record, else that it isn't JSON of
    the schema, or its first fault."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.select(F.struct("*").alias("_record"), F.inline(F.array(F.from_json(value, f"{schema}, _corrupt STRING", options))))
    broken = F.col(f"_record.{value}").isNull() | F.col("_corrupt").isNotNull()
    return parsed.select("_record.*", F.when(broken, "malformed").otherwise(fault).alias("reason"))
