"""Comparisons and orders between sets of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import trade_id


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_ids(rows: DataFrame, first: int, n: int, id_col: str = "tradeId") -> DataFrame:
    """Trade ids of the n numbers from first that don't occur."""
    wanted = rows.sparkSession.range(first, first + n).select(trade_id("id").alias(id_col))
    return wanted.join(rows.select(id_col), id_col, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b hasn't, as often as a has more of them."""
    return a.exceptAll(b.select(*a.columns))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other, with the side."""
    return difference(a, b).withColumn("side", F.lit("left")).union(difference(b.select(*a.columns), a).withColumn("side", F.lit("right")))


def unequal_totals(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ or that one side lacks."""
    both = left.select(key, F.col(value).alias("left")).join(right.select(key, F.col(value).alias("right")), key, "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


def gaps(rows: DataFrame, step: int, key: str = "key", at: str = "windowEnd") -> DataFrame:
    """Per key, how many rows don't follow the one before by exactly step."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return rows.select(key, (F.col(at) - before).alias("d")).groupBy(key).agg(F.count(F.when(F.col("d") != step, 1)).alias("gaps"))


def broken_counts(positions: DataFrame) -> DataFrame:
    """Per key, whether updateCount runs from 1 to n: no window is needed, as n
    distinct numbers from 1 to n have no gap."""
    n = F.count(F.lit(1))
    ok = (F.min("updateCount") == 1) & (F.max("updateCount") == n) & (F.count_distinct("updateCount") == n)
    return positions.groupBy("key").agg(n.alias("updates"), ok.alias("ok"))


def absent_from_last(rows: DataFrame, key: str = "key", at: str = "windowEnd") -> DataFrame:
    """Keys that the last window lacks."""
    last = rows.agg(F.max(at).alias("m")).scalar()
    return rows.select(key).distinct().join(rows.filter(F.col(at) == last).select(key), key, "left_anti")


def latest_before(rows: DataFrame, bound: Column, *by: str, time: str = "eventTime", tie: str = "seq") -> DataFrame:
    """The last row before a bound, of each group."""
    rest = [c for c in rows.columns if c not in by]
    top = rows.filter(F.col(time) < bound).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return top.select(*by, "r.*")


def out_of_order(rows: DataFrame, by: str, arrival: str, time: str = "eventTime", bucket: int = 1 << 20) -> DataFrame:
    """Per group, how often the time falls from one arrival to the next.
    arrival: a number. Arrivals are cut into buckets of that many numbers; falls
    are counted within each, then between the last time of one bucket and the
    first of the next, so a large group is worked on by many tasks."""
    own = rows.withColumn("_bucket", F.floor(F.col(arrival) / bucket))
    before = F.lag(time).over(Window.partitionBy(by, "_bucket").orderBy(arrival))
    each = own.withColumn("_falls", (F.col(time) < before).cast("bigint")).groupBy(by, "_bucket")
    each = each.agg(F.coalesce(F.sum("_falls"), F.lit(0)).alias("falls"), F.min_by(time, arrival).alias("first"), F.max_by(time, arrival).alias("last"))
    between = F.lag("last").over(Window.partitionBy(by).orderBy("_bucket"))
    each = each.withColumn("falls", F.col("falls") + F.coalesce((F.col("first") < between).cast("bigint"), F.lit(0)))
    return each.groupBy(by).agg(F.sum("falls").alias("falls"))


def numbered(rows: DataFrame, time: str, tie: str, bucket_millis: int = 3_600_000) -> DataFrame:
    """The rows with `ordinal`, their place from 0 in the order of `time` (epoch
    milliseconds) and `tie`. Time buckets are counted first, then rows are
    numbered within theirs, so no task sorts all rows."""
    own = rows.withColumn("_bucket", F.floor(F.col(time) / bucket_millis))
    counts = own.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    before = counts.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(time, tie)) - 1
    return own.withColumn("_at", at).join(before, "_bucket").withColumn("ordinal", F.col("_at") + F.col("_before")).drop("_bucket", "_at", "_before")


def take(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n records of the stream in a total order."""
    return rows.orderBy(*order).limit(n)


def fingerprint(rows: DataFrame, encoded: Column) -> DataFrame:
    """The number of records and a hash of all of them in any order: the sum of
    the first 60 bits of each one's SHA-256."""
    h = F.conv(F.substring(F.sha2(encoded, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.sum(h).cast("string").alias("hash"))


#: Of ordered_fingerprint: a Mersenne prime, so that products of two residues fit
#: in 64 bits, and the bases of its two independent polynomials.
PRIME, BASES = (1 << 31) - 1, (1_000_003, 998_244_353)
#: Ordinals have so many bits at most.
ORDINAL_BITS = 40


def power(base: int, exponent: Column) -> Column:
    """base to the exponent modulo PRIME, by the exponent's bits."""
    out = F.lit(1).cast("bigint")
    for k in range(ORDINAL_BITS):
        factor = F.when(F.shiftright(exponent, k).bitwiseAND(F.lit(1)) == 1, F.lit(pow(base, 1 << k, PRIME))).otherwise(F.lit(1))
        out = out * factor.cast("bigint") % F.lit(PRIME)
    return out


def ordered_fingerprint(rows: DataFrame, encoded: Column, time: str, tie: str) -> DataFrame:
    """The number of records and a hash of all of them in their order: for each
    base the sum of (hash of the record) * base ^ (its ordinal) modulo PRIME, so
    two records that change places change it. Terms are added in any order."""
    h = F.conv(F.substring(F.sha2(encoded, 256), 1, 15), 16, 10).cast("bigint") % PRIME
    own = numbered(rows.withColumn("_hash", h), time, tie)
    terms = [(F.col("_hash") * power(base, F.col("ordinal")) % PRIME).cast("decimal(38,0)") for base in BASES]
    sums = [F.coalesce((F.sum(t) % PRIME).cast("bigint"), F.lit(0)).cast("string") for t in terms]
    return own.agg(F.count(F.lit(1)).alias("records"), F.concat_ws("-", *sums).alias("hash"))
