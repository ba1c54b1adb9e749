"""Values at closes against a plain recomputation over generated streams."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.times import next_boundary
from tallymark.operators import relations
from tallymark.operators.closing import horizon
from tallymark.operators.market_value import value_at_close
from tallymark.plans import checks

WINDOW = 7_000
KEYS = [("east/x/QRX", "QRX"), ("west/x/QRX", "QRX"), ("west/y/UVO", "UVO"), ("east/x/ZED", "ZED"), ("solo", "solo")]


def generated(seed, n_held=60, n_ticks=50, span=40 * WINDOW):
    """Positions and ticks in no order, on boundaries and at equal times too;
    QRX's ticks end early, ZED has none, and the key solo is a symbol itself."""
    draw = random.Random(seed)
    at = lambda most: draw.choice([draw.randrange(most), draw.randrange(0, most, WINDOW)])
    held, seen = [], {}
    for t in sorted(at(span) for _ in range(n_held)):
        key, symbol = draw.choice(KEYS)
        seen[key] = seen.get(key, 0) + 1
        held.append((t, key, f"T{len(held):09d}", draw.randint(-90, 90), symbol, seen[key]))
    ticks = []
    for t in sorted(at(span) for _ in range(n_ticks)):
        symbol = draw.choice(["QRX", "UVO", "solo"])
        ticks.append((t // 3 if symbol == "QRX" else t, Decimal(draw.randint(1, 400)) / 4, symbol, len(ticks)))
    return draw.sample(held, len(held)), draw.sample(ticks, len(ticks))


def plain(held, ticks, until, reach):
    """Each key at each close, from all that came before it."""
    found = []
    for key, symbol in {(h[1], h[4]) for h in held}:
        own = sorted((h for h in held if h[1] == key), key=lambda h: (h[0], h[5]))
        for end in range(own[0][0] // WINDOW * WINDOW + WINDOW, until + 1, WINDOW):
            last = [h for h in own if h[0] < end][-1]
            near = sorted((t[0], t[3], t[1]) for t in ticks if t[2] == symbol and t[0] < end and (reach is None or end - (t[0] // WINDOW + 1) * WINDOW < reach * WINDOW))
            if near:
                found.append((key, symbol, last[3], near[-1][2], last[3] * near[-1][2], last[2], end))
    return sorted(found)


def streams(spark, held, ticks):
    return spark.createDataFrame(held, schemas.POSITION), spark.createDataFrame(ticks, schemas.PRICE + ", seq BIGINT")


def rows_of(df):
    return sorted((r.key, r.symbol, r.quantity, r.price, r.marketValue, r.lastTradeId, r.windowEnd) for r in df.collect())


@pytest.mark.parametrize("reach", [1, 4, 240, None])
@pytest.mark.parametrize("seed", [11, 12])
def test_values_equal_the_plain_ones(spark, seed, reach):
    held, ticks = generated(seed)
    until = 44 * WINDOW
    found = rows_of(value_at_close(*streams(spark, held, ticks), WINDOW, price_windows=reach, until=F.lit(until).cast("bigint")))
    assert found == plain(held, ticks, until, reach)
    assert len(found) > 40 and not any(r[1] == "ZED" for r in found)


def test_a_price_reaches_as_far_as_it_should(spark):
    held, ticks = [(WINDOW * 3 + 1, "UVO", "T000000000", 8, "UVO", 1)], [(WINDOW * 2, Decimal("3.25"), "UVO", 0)]
    found = value_at_close(*streams(spark, held, ticks), WINDOW, price_windows=240, until=F.lit(WINDOW * 400).cast("bigint"))
    assert [r[6] // WINDOW for r in rows_of(found)] == list(range(4, 243))


def test_boundaries(spark):
    times = [t + k * 7_000 for t in (0, 1, 6_999) for k in (-2, -1, 0, 5)]
    df = spark.createDataFrame([(t,) for t in times], "t bigint")
    assert [r[0] for r in df.select(next_boundary("t", 7_000)).collect()] == [(t // 7_000 + 1) * 7_000 for t in times]


def test_the_last_window_stays_open(spark):
    held, ticks = streams(spark, *generated(13))
    last = min(held.agg(F.max("eventTime")).first()[0], ticks.agg(F.max("eventTime")).first()[0])
    for delay in (0, 1, WINDOW, 9 * WINDOW + 5):
        assert spark.range(1).select(horizon(held, ticks, WINDOW, delay)).first()[0] == (last - delay - 1) // WINDOW * WINDOW
    assert value_at_close(held, ticks.limit(0), WINDOW).count() == 0


@pytest.fixture(scope="module")
def sound(spark):
    held, ticks = generated(14, n_held=30)
    held, ticks = streams(spark, [h for h in held if h[4] != "ZED"], ticks)
    mv = value_at_close(held, ticks, WINDOW)
    rows = rows_of(mv)
    # from each key's first close on, prices are known throughout, so that a missing row is a gap
    return held, ticks, spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows], "key string, symbol string, quantity long, price decimal(18,2), marketValue decimal(38,2), lastTradeId string, windowEnd long")


def failed(mv, held, ticks):
    return {r.name.removeprefix("mv ") for r in checks.values(mv, held, ticks, WINDOW, mv.select("key").distinct().count(), "mv").collect() if not r.ok}


FAULTS = {
    "a row less": (lambda mv, at: mv.filter(~at), {"keys with a gap"}),
    "a row twice": (lambda mv, at: mv.union(mv.filter(at)), {"duplicates", "keys with a gap"}),
    "another price": (lambda mv, at: mv.withColumn("price", F.when(at, F.col("price") + 1).otherwise(F.col("price"))), {"wrong values", "prices unlike the close"}),
    "another quantity": (lambda mv, at: mv.withColumn("quantity", F.when(at, F.col("quantity") - 3).otherwise(F.col("quantity"))).withColumn("marketValue", (F.col("quantity") * F.col("price")).cast("decimal(38,2)")), {"quantities unlike the close"}),
}


def test_checks_pass_on_sound_values(sound):
    assert failed(sound[2], *sound[:2]) == set()


@pytest.mark.parametrize("name", FAULTS)
def test_checks_find_faults(sound, name):
    held, ticks, mv = sound
    key, first, last = mv.groupBy("key").agg(F.min("windowEnd").alias("a"), F.max("windowEnd").alias("b")).filter("b - a > 20000").orderBy("key").first()
    fault, found = FAULTS[name]
    wrong = fault(mv, (F.col("key") == key) & (F.col("windowEnd") == first + WINDOW))
    assert failed(wrong, held, ticks) == found


def test_keys_absent_from_the_last_window_and_gaps_are_found(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3), ("c", 2)], "key string, windowEnd long")
    assert [r.key for r in relations.absent_from_last(df).collect()] == ["c"]
    assert {r.key: r.gaps for r in relations.gaps(df, 1).collect()} == {"a": 0, "b": 1, "c": 0}
