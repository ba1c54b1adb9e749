"""Positions against a plain recomputation over generated trades."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import positions, relations

HOLDERS = [("north", "a"), ("north", "b"), ("south", "a")]


def generated(n, seed):
    """Trades with uneven allocations, repeated times, and ids in no order."""
    draw = random.Random(seed)
    ids = draw.sample(range(10_000), n)
    found = []
    for i in ids:
        shares = [draw.randint(1, 60) for _ in HOLDERS]
        allocations = [(a, q, s) for (a, s), q in zip(HOLDERS, shares, strict=True)]
        found.append((allocations, draw.randrange(0, 40_000, 500), sum(shares), draw.choice(["BUY", "SELL"]), draw.choice(["QRX", "UVO", "ZED"]), f"T{i:09d}"))
    return found


def plain(trades, by_account):
    """What is held after each trade, one trade at a time."""
    held, seen, rows = defaultdict(int), defaultdict(int), []
    for allocations, at, quantity, side, symbol, ident in sorted(trades, key=lambda t: (t[1], t[5])):
        sign = 1 if side == "BUY" else -1
        for key, q in [(f"{a}/{s}/{symbol}", q) for a, q, s in allocations] if by_account else [(symbol, quantity)]:
            held[key] += sign * q
            seen[key] += 1
            rows.append((key, symbol, held[key], ident, seen[key], at))
    return sorted(rows)


def rows_of(df):
    return sorted((r.key, r.symbol, r.quantity, r.lastTradeId, r.updateCount, r.eventTime) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rows = generated(240, 5)
    return rows, spark.createDataFrame(rows, schemas.BLOCK_TRADE)


@pytest.mark.parametrize("bucket", [500, 7_000, positions.DAY])
@pytest.mark.parametrize("by_account", [False, True])
def test_running_positions_equal_the_plain_ones(made, by_account, bucket):
    rows, df = made
    updates = positions.split(df) if by_account else positions.by_symbol(df)
    found = rows_of(positions.running(updates, bucket))
    assert found == plain(rows, by_account)
    assert len(found) == len(rows) * (len(HOLDERS) if by_account else 1)
    assert min(r[2] for r in found) < 0 < max(r[2] for r in found)


def test_both_sides_have_the_same_totals(made):
    rows, df = made
    both = [positions.roll_up(positions.final(positions.running(f(df)))) for f in (positions.by_symbol, positions.split)]
    assert relations.unequal_totals(*both, "symbol", "quantity").count() == 0
    net = {r.symbol: r.quantity for r in positions.net(positions.by_symbol(df)).collect()}
    assert net[None] == sum((1 if r[3] == "BUY" else -1) * r[2] for r in rows)


def test_unequal_totals_are_found(spark):
    """A key that differs, and one that each side lacks."""
    a = spark.createDataFrame([("QRX", 7), ("UVO", -2), ("ZED", 0)], "symbol string, quantity long")
    b = spark.createDataFrame([("QRX", 7), ("UVO", 2), ("NEW", 5)], "symbol string, quantity long")
    assert sorted(map(tuple, relations.unequal_totals(a, b, "symbol", "quantity").collect())) == [("NEW", None, 5), ("UVO", -2, 2), ("ZED", 0, None)]


def test_final_positions_are_the_last_ones(made):
    rows, df = made
    last = {r[0]: (r[2], r[4]) for r in sorted(plain(rows, True), key=lambda r: r[4])}
    assert {r.key: (r.quantity, r.updateCount) for r in positions.final(positions.running(positions.split(df))).collect()} == last


def test_bucketed_sums_equal_whole_ones(spark):
    df = spark.range(3000).select(F.concat(F.lit("K"), (F.col("id") % 3).cast("string")).alias("key"), F.lit("S").alias("symbol"), ((F.col("id") * 7919) % 101 - 50).alias("signedQuantity"), F.format_string("T%09d", "id").alias("tradeId"), (F.col("id") * 37 % 5000 - 2000).alias("eventTime"))
    a, b = positions.running(df, 100), positions.running(df, 10**9)
    assert relations.symmetric_difference(a, b).count() == 0
    assert relations.broken_counts(a).filter("not ok").count() == 0


def test_broken_counts_and_repeated_rows_are_found(spark):
    rows = [("QRX", 1), ("QRX", 2), ("UVO", 1), ("UVO", 3), ("ZED", 1), ("ZED", 1)]
    df = spark.createDataFrame(rows, "key string, updateCount long")
    assert {r.key: r.ok for r in relations.broken_counts(df).collect()} == {"QRX": True, "UVO": False, "ZED": False}
    assert [tuple(r) for r in relations.duplicates(df, "key", "updateCount").collect()] == [("ZED", 1, 2)]


def test_an_unknown_side_fails(spark):
    rows = [(*generated(1, 1)[0][:3], "LEND", "QRX", "T000000001")]
    with pytest.raises(Exception, match="unknown side"):
        positions.by_symbol(spark.createDataFrame(rows, schemas.BLOCK_TRADE)).collect()


def test_sums_beyond_64_bits_fail(spark):
    df = spark.createDataFrame([("K", "K", 2**62, f"T{i}", i) for i in range(3)], schemas.UPDATE)
    with pytest.raises(Exception):
        positions.running(df).collect()


@pytest.mark.parametrize("per_bucket", [1, 97, 4000])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_falls_in_arrival_order(spark, per_bucket, seed):
    """Bucketed or not, each fall of time counts once, across buckets too."""
    draw = random.Random(seed)
    rows = [(draw.choice("abc"), i, draw.randrange(50)) for i in draw.sample(range(1000), 300)]
    falls, last = defaultdict(int), {}
    for g, _, at in sorted(rows, key=lambda r: r[1]):
        falls[g] += at < last.get(g, -1)
        last[g] = at
    df = spark.createDataFrame(rows, "g string, seq long, eventTime long")
    assert {r.g: r.falls for r in relations.out_of_order(df, "g", "seq", bucket=per_bucket).collect()} == dict(falls)


def test_updates_are_shuffled_once(spark):
    """Of the exchanges, one holds the updates; the others hold bucket totals."""
    plan = positions.running(spark.range(9).select(F.lit("K").alias("key"), F.lit("K").alias("symbol"), F.col("id").alias("signedQuantity"), F.lit("T").alias("tradeId"), F.col("id").alias("eventTime")))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([s for s in shuffles if "bucket" in s]) <= 3 and "CartesianProduct" not in plan and "Python" not in plan
