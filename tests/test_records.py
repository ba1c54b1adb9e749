from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.config import JobConfig
from tallymark.functions import keys, records
from tallymark.functions.amounts import on_a_quarter
from tallymark.operators import relations
from tallymark.plans import checks
from tallymark.sources import files, kafka

TRADE = '{"allocations":[{"account":"ACC1","quantity":5,"subAccount":"SUB1"}],"eventTime":7,"quantity":5,"side":"BUY","symbol":"AAPL","tradeId":"T000000001"}'


def raw(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_a_trade_survives_the_round_trip_byte_by_byte(spark):
    t = records.decode(raw(spark, TRADE), schemas.BLOCK_TRADE)
    assert [r[0] for r in t.select(records.encode(t, schemas.BLOCK_TRADE)).collect()] == [TRADE]


def test_decimals_are_plain(spark):
    p = spark.createDataFrame([(1, Decimal("100.00"), "AAPL")], schemas.PRICE)
    assert p.select(records.encode(p, schemas.PRICE)).first()[0] == '{"eventTime":1,"price":100.00,"symbol":"AAPL"}'


def test_bad_json_fails_or_is_set_apart(spark):
    with pytest.raises(Exception):
        records.decode(raw(spark, "{oops"), schemas.BLOCK_TRADE).collect()
    good, bad = records.quarantine(records.decode(raw(spark, TRADE, "{oops"), schemas.BLOCK_TRADE, strict=False), records.trade_fault())
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["blank tradeId"]


@pytest.mark.parametrize("name", ["blank tradeId", "blank symbol", "unknown side", "quantity not positive", "no allocations", "allocations don't sum to the block", "no event time", "bad allocation"])
def test_each_fault_is_named(spark, name):
    change = {
        "blank tradeId": ("tradeId", F.lit(" ")), "blank symbol": ("symbol", F.lit(None).cast("string")), "unknown side": ("side", F.lit("HOLD")), "quantity not positive": ("quantity", F.lit(0).cast("bigint")),
        "no allocations": ("allocations", F.slice("allocations", 1, 0)), "allocations don't sum to the block": ("quantity", F.lit(6).cast("bigint")), "no event time": ("eventTime", F.lit(None).cast("bigint")),
        "bad allocation": ("allocations", F.transform("allocations", lambda a: a.withField("account", F.lit("")))),
    }[name]
    t = records.decode(raw(spark, TRADE), schemas.BLOCK_TRADE)
    assert records.checked(t, records.trade_fault()).count() == 1
    broken = t.withColumn(*change)
    assert [r.reason for r in records.quarantine(broken, records.trade_fault())[1].collect()] == [name]
    with pytest.raises(Exception, match=name.split("'")[0]):
        records.checked(broken, records.trade_fault()).collect()


def test_other_records_faults(spark):
    p = spark.createDataFrame([(1, Decimal("0.00"), "A"), (1, None, "A"), (1, Decimal("1.00"), "A")], schemas.PRICE)
    assert sorted(str(r[0]) for r in p.select(records.price_fault()).collect()) == ["None", "price not positive", "price not positive"]
    q = spark.createDataFrame([(1, "k", "T", 0, "s", 1), (1, "k", "T", 0, "s", 0)], schemas.POSITION)
    assert [r[0] for r in q.select(records.position_fault()).collect()] == [None, "updateCount not positive"]
    m = spark.createDataFrame([("k", "T", None, Decimal(1), 1, "s", 1)], schemas.MARKET_VALUE)
    assert m.select(records.market_value_fault()).first()[0] == "no market value"


def test_keys(spark):
    df = spark.createDataFrame([("ACC1", "SUB1", "AAPL")], "a string, s string, y string")
    assert df.select(keys.account_key("a", "s", "y")).first()[0] == "ACC1/SUB1/AAPL"
    assert df.select(keys.symbol_of(F.lit("ACC1/SUB1/AAPL"))).first()[0] == "AAPL"
    with pytest.raises(Exception, match="not an account key"):
        df.select(keys.symbol_of("y")).collect()
    shaped = spark.createDataFrame([("ACC1/SUB1/AAPL", True), ("ACC5/SUB1/AAPL", False), ("ACC1/SUB1/AAPL\n", False), ("ACC1/SUB2/AAPL", False)], "k string, ok boolean")
    assert shaped.filter(keys.well_formed("k", 4, ["AAPL"]) != F.col("ok")).count() == 0
    assert spark.range(7, 8).select(keys.trade_id("id")).first()[0] == "T000000007"


def test_quarters(spark):
    df = spark.createDataFrame([(Decimal("1.25"),), (Decimal("1.30"),)], "p decimal(18,2)")
    assert [r[0] for r in df.select(on_a_quarter("p")).collect()] == [True, False]


def test_a_short_snapshot_is_refused(spark, tmp_path):
    p = spark.createDataFrame([(t, Decimal("1.00"), s) for t in (3, 1, 2) for s in "AB"], schemas.PRICE)
    path = str(tmp_path / "p")
    files.publish(p, path, schemas.PRICE, "symbol", "eventTime", "price", partitions=3)
    assert relations.symmetric_difference(files.complete(spark, path, schemas.PRICE, 6), p).count() == 0
    assert {tuple(r) for r in files.partition_report(spark, path, schemas.PRICE).collect()} == {("A", 1, 0), ("B", 1, 0)}
    with pytest.raises(ValueError, match="6 of 7"):
        files.complete(spark, path, schemas.PRICE, 7)


def test_order_checks_find_disorder(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 3, 2), ("A", 2, 3)], "symbol string, eventTime bigint, seq bigint")
    assert relations.out_of_order(df, "symbol", "seq").first().falls == 1
    assert relations.latest_before(df, F.lit(3), "symbol").first().seq == 3
    assert relations.missing_ids(spark.createDataFrame([("T000000001",)], "tradeId string"), 0, 3).count() == 2


def test_order_checks_find_broken_trades(spark):
    a = [(f"ACC{i}", 5, "SUB1") for i in range(1, 5)]
    good = [(a, 1, 20, "BUY", "AAPL", "T1"), (a, 2, 20, "SELL", "AAPL", "T2")]
    failed = lambda rows, n=2: {r.name for r in checks.orders(spark.createDataFrame(rows, schemas.BLOCK_TRADE), 4, ["AAPL"], n).collect() if not r.ok}
    assert failed(good) == set()
    assert failed([*good, good[0]]) == {"duplicate trade ids"}
    assert failed(good[:1]) == {"both sides", "orders"}
    assert failed([*good, (a, 3, 21, "BUY", "AAPL", "T3")], 3) == {"blocks unlike their allocations"}
    assert failed(good, 3) == {"orders"}


def test_fingerprints_ignore_order_and_notice_changes(spark):
    p = spark.createDataFrame([(t, Decimal("1.00"), "A") for t in range(50)], schemas.PRICE)
    of = lambda df: tuple(relations.fingerprint(df, records.encode(df, schemas.PRICE)).first())
    assert of(p) == of(p.orderBy(F.desc("eventTime"))) != of(p.withColumn("price", F.col("price") + (F.col("eventTime") == 3).cast("int")).select(F.col("eventTime"), F.col("price").cast("decimal(18,2)"), "symbol"))


def test_config():
    c = JobConfig.from_environment({"WINDOW_MILLIS": "10000", "ORDERS_PATH": "o", "DELAY_MILLIS": " "})
    assert (c.window_millis, c.orders_path, c.delay_millis) == (10_000, "o", 2_000)
    with pytest.raises(ValueError):
        JobConfig(window_millis=0)


def test_kafka_options():
    c = JobConfig(bootstrap_servers="h:1")
    assert kafka.read_options(c, "orders", False) == {"kafka.bootstrap.servers": "h:1", "subscribe": "orders", "startingOffsets": "earliest"}
    assert kafka.read_options(c, "prices", True)["kafka.isolation.level"] == "read_committed"
    assert kafka.write_options(c, "t")["kafka.acks"] == "all"
