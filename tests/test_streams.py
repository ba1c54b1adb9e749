"""Streams give what batches give, over several micro-batches and restarts."""

import dataclasses
import os
import signal
import subprocess
import sys
import time
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.config import JobConfig
from tallymark.operators import positions, relations
from tallymark.operators.market_value import value_at_close
from tallymark.sources import files
from tallymark.streaming import jobs, metrics, processors

MINUTE = 60_000


def updates(spark, lo, hi):
    return spark.range(lo, hi).select(F.format_string("K%d", F.col("id") % 3).alias("key"), F.format_string("S%d", F.col("id") % 3 % 2).alias("symbol"), (F.col("id") * 31 % 11 - 4).alias("signedQuantity"), F.format_string("T%09d", "id").alias("tradeId"), (F.col("id") * 7_000).alias("eventTime"))


def ticks(spark, lo, hi):
    return spark.range(lo, hi).select((F.col("id") * 7_000 + 500).alias("eventTime"), (F.col("id") % 40 + 1).cast("decimal(18,2)").alias("price"), F.format_string("S%d", F.col("id") % 2).alias("symbol"), F.col("id").alias("seq"))


def run_positions(spark, top):
    source = files.stream(spark, f"{top}/in", schemas.UPDATE, files_per_trigger=1)
    jobs.finish(jobs.start(jobs.running_positions(source), f"{top}/out", f"{top}/state"))
    return spark.read.schema(processors.POSITION).parquet(f"{top}/out")


def same(a, b):
    return relations.symmetric_difference(a, b.select(*a.columns)).count() == 0


def test_positions_go_on_after_a_restart(spark, tmp_path):
    updates(spark, 0, 40).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert same(run_positions(spark, tmp_path), positions.running(updates(spark, 0, 40)))
    updates(spark, 40, 90).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = run_positions(spark, tmp_path)  # the same checkpoint: nothing is repeated or lost
    assert same(found, positions.running(updates(spark, 0, 90)))
    assert same(run_positions(spark, tmp_path), found)


@pytest.mark.parametrize("salts", [1, 3])
def test_values_equal_the_batch_over_micro_batches(spark, tmp_path, salts):
    for lo in range(0, 120, 40):
        positions.running(updates(spark, 0, 120)).filter(F.col("eventTime").between(lo * 7_000, lo * 7_000 + 279_999)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/held")
        ticks(spark, lo, lo + 40).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
    held = files.stream(spark, f"{tmp_path}/held", processors.POSITION, 1)
    price = files.stream(spark, f"{tmp_path}/ticks", schemas.PRICE + ", seq BIGINT", 1)
    jobs.finish(jobs.start(jobs.values_at_close(held, price, MINUTE, salts=salts), f"{tmp_path}/out", f"{tmp_path}/state"))
    found = spark.read.schema(processors.VALUE).parquet(f"{tmp_path}/out")
    assert same(found, value_at_close(positions.running(updates(spark, 0, 120)), ticks(spark, 0, 120), MINUTE))


def test_a_silent_source_holds_windows_back(spark, tmp_path):
    """The watermark is the least of both sources': without prices nothing closes."""
    positions.running(updates(spark, 0, 60)).write.parquet(f"{tmp_path}/held")
    spark.createDataFrame([(500, Decimal("1.00"), "S0", 0)], schemas.PRICE + ", seq BIGINT").write.parquet(f"{tmp_path}/ticks")
    held, price = files.stream(spark, f"{tmp_path}/held", processors.POSITION), files.stream(spark, f"{tmp_path}/ticks", schemas.PRICE + ", seq BIGINT")
    jobs.finish(jobs.start(jobs.values_at_close(held, price, MINUTE), f"{tmp_path}/out", f"{tmp_path}/state"))
    assert spark.read.schema(processors.VALUE).parquet(f"{tmp_path}/out").count() == 0


def orders(spark, lo, hi):
    """Trades of uneven allocations, one a second."""
    shares = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.struct(F.concat(F.lit("H"), k.cast("string")).alias("account"), (k * (F.col("id") % 5 + 1)).alias("quantity"), F.lit("s").alias("subAccount")))
    return spark.range(lo, hi).select(shares.alias("allocations"), (F.col("id") * 1000).alias("eventTime"), (6 * (F.col("id") % 5 + 1)).alias("quantity"), F.when(F.col("id") % 3 == 0, "SELL").otherwise("BUY").alias("side"), F.format_string("S%d", F.col("id") % 2).alias("symbol"), F.format_string("T%09d", "id").alias("tradeId"))


def configured(top, **options):
    paths = {f"{n}_path": f"{top}/{n}" for n in ("orders", "prices", "checkpoint", *jobs.SIDES, *jobs.VALUES)}
    return JobConfig(**(paths | {"window_millis": MINUTE, "delay_millis": 0, "idle_millis": 0, "trigger_millis": 0} | options))


def put(rows, path, schema, key, order):
    """Appends records, as a producer does."""
    files.as_records(rows.coalesce(1).sortWithinPartitions("eventTime", order), schema, key, "eventTime").write.mode("append").parquet(path)


def read(spark, path, schema):
    return files.with_records(spark, path, schema)


@pytest.mark.parametrize("state", ["keyed", "table"])
def test_both_jobs_run_from_one_configuration(spark, tmp_path, state):
    """JSON records in, keyed records with their times out, for both sides of both jobs."""
    config = configured(tmp_path, files_per_trigger=1, salts=3, positions_state=state)
    for lo in (0, 150):
        put(orders(spark, lo, lo + 150), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
        put(ticks(spark, lo // 7, lo // 7 + 25), config.prices_path, schemas.PRICE + ", seq BIGINT", "symbol", "seq")
    for query in jobs.run_positions(spark, config).values():
        jobs.finish(query)
    for query in jobs.run_market_values(spark, config).values():
        jobs.finish(query)
    price = ticks(spark, 0, 46).union(ticks(spark, 21, 25)).select(*schemas.names(schemas.PRICE), "seq")
    for name, updates_of in jobs.SIDES.items():
        held = positions.running(updates_of(orders(spark, 0, 300)))
        found = read(spark, f"{tmp_path}/{name}", schemas.POSITION)
        assert same(found.select(*held.columns), held)
        assert found.filter("recordKey != key or recordMillis != eventTime").count() == 0
        mv = value_at_close(held, price, MINUTE)
        values = read(spark, f"{tmp_path}/{name.replace('positions', 'mv')}", schemas.MARKET_VALUE)
        assert same(values.select(*mv.columns), mv) and mv.count() >= 8
        assert values.filter("recordKey != key or recordMillis != windowEnd").count() == 0


def test_bad_records_fail_or_are_left_out(spark, tmp_path):
    put(orders(spark, 0, 20), f"{tmp_path}/orders", schemas.BLOCK_TRADE, "tradeId", "tradeId")
    spark.createDataFrame([("k", "{oops", None), ("k", '{"symbol":"S0","side":"BUY","quantity":-3}', None)], files.RECORD).write.mode("append").parquet(f"{tmp_path}/orders")
    with pytest.raises(Exception):
        jobs.finish(jobs.run_positions(spark, configured(tmp_path), ["positions_by_symbol"])["positions_by_symbol"])
    config = configured(tmp_path, checkpoint_path=f"{tmp_path}/other", positions_by_symbol_path=f"{tmp_path}/skipped", bad_records="skip")
    jobs.finish(jobs.run_positions(spark, config, ["positions_by_symbol"])["positions_by_symbol"])
    held = positions.running(positions.by_symbol(orders(spark, 0, 20)))
    assert same(read(spark, f"{tmp_path}/skipped", schemas.POSITION).select(*held.columns), held)


@pytest.mark.parametrize("idle", [0, 5000])
def test_an_idle_source_holds_windows_back_unless_told_otherwise(spark, tmp_path, idle):
    config = configured(tmp_path, idle_millis=idle)
    put(positions.running(positions.by_symbol(orders(spark, 0, 200))).withColumn("seq", F.lit(0)), config.positions_by_symbol_path, schemas.POSITION, "key", "updateCount")
    put(ticks(spark, 0, 3), config.prices_path, schemas.PRICE, "symbol", "seq")  # the last one at 14.5 s
    jobs.finish(jobs.run_market_values(spark, config, ["mv_by_symbol"])["mv_by_symbol"])
    ends = sorted({r.windowEnd for r in read(spark, config.mv_by_symbol_path, schemas.MARKET_VALUE).collect()})
    assert ends == ([60_000, 120_000, 180_000] if idle else [])


def test_settings_reach_the_queries(spark, tmp_path):
    """Cadence, parallelism and age: of a job that runs on, a micro-batch each second."""
    config = configured(tmp_path, trigger_millis=1000, parallelism=3, files_per_trigger=1)
    for lo in (0, 30):
        put(orders(spark, lo, lo + 30), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    own = jobs.settled(spark, config)
    assert own.conf.get("spark.sql.shuffle.partitions") == "3" != spark.conf.get("spark.sql.shuffle.partitions")
    query = jobs.run_positions(spark, config, ["positions_by_symbol"])["positions_by_symbol"]
    try:
        for _ in range(120):
            if sum(p.numInputRows for p in query.recentProgress) >= 60:
                break
            time.sleep(0.5)
        began = [datetime.fromisoformat(p.timestamp.replace("Z", "+00:00")).timestamp() for p in query.recentProgress if p.numInputRows]
        assert len(began) == 2 and abs(began[1] - round(began[1])) < 0.3
        assert {s.numShufflePartitions for p in query.recentProgress if p.numInputRows for s in p.stateOperators} == {3}
    finally:
        query.stop()
    held = positions.running(positions.by_symbol(orders(spark, 0, 60)))
    assert same(read(spark, config.positions_by_symbol_path, schemas.POSITION).select(*held.columns), held)


KILLED = """
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
from tallymark.config import JobConfig
from tallymark.streaming import jobs
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {top!r} + "/w").getOrCreate()
jobs.run_positions(spark, JobConfig(**{config!r}), ["positions_by_account"])["positions_by_account"].awaitTermination()
"""


@pytest.mark.parametrize("state", ["keyed", "table"])
def test_exactly_once_through_a_kill(spark, tmp_path, state):
    """The whole process, JVM and workers, is killed while micro-batches run; a
    restart from the same checkpoint leaves every row once."""
    config = configured(tmp_path, files_per_trigger=1, trigger_millis=1, positions_state=state)
    for lo in range(0, 400, 40):
        put(orders(spark, lo, lo + 40), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(home=home, top=str(tmp_path), config=dataclasses.asdict(config))
    job = subprocess.Popen([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": home}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    try:
        begun = f"{config.checkpoint_path}/positions_by_account/offsets"
        for _ in range(600):
            n = len([x for x in os.listdir(begun) if x.isdigit()]) if os.path.isdir(begun) else 0
            if n >= 3 or job.poll() is not None:
                break
            time.sleep(0.1)
        assert n >= 3 and job.poll() is None
    finally:
        os.killpg(job.pid, signal.SIGKILL)
        job.wait()
    ended = len([x for x in os.listdir(f"{config.checkpoint_path}/positions_by_account/commits") if x.isdigit()])
    assert ended < 10  # killed before it was done
    again = dataclasses.replace(config, trigger_millis=0)
    jobs.finish(jobs.run_positions(spark, again, ["positions_by_account"])["positions_by_account"])
    held = positions.running(positions.split(orders(spark, 0, 400)))
    assert same(read(spark, config.positions_by_account_path, schemas.POSITION).select(*held.columns), held)


def test_live_numbers_and_repeatable_batches(spark, tmp_path):
    for lo in (0, 20):
        updates(spark, lo, lo + 20).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = files.stream(spark, f"{tmp_path}/in", schemas.UPDATE, 1)
    query = jobs.start_batches(metrics.observed(source, "stage"), f"{tmp_path}/out", f"{tmp_path}/state")
    jobs.finish(query)
    found = metrics.reports(query, "stage")
    assert [(r["records"], r["keys"]) for r in found] == [(20, 3)] * 2
    now = time.time() * 1000  # event times start at 0, so ages are about the time itself
    assert all(now - 600_000 < r["age"][0] <= r["age"][1] <= now for r in found)
    assert len(metrics.rates(query)) == 2 and min(metrics.rates(query)) > 0
    assert same(spark.read.parquet(f"{tmp_path}/out").drop("batch"), updates(spark, 0, 40))


def test_late_positions_change_nothing(spark, tmp_path):
    """A position of a closed window is counted and left out."""
    held = positions.running(updates(spark, 0, 60))
    held.coalesce(1).write.mode("append").parquet(f"{tmp_path}/held")
    ticks(spark, 0, 60).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")

    def run():
        read = lambda name, schema: files.stream(spark, f"{tmp_path}/{name}", schema, 1)
        query = jobs.start(jobs.values_at_close(read("held", processors.POSITION), read("ticks", schemas.PRICE + ", seq BIGINT"), MINUTE), f"{tmp_path}/out", f"{tmp_path}/state")
        jobs.finish(query)
        return query, spark.read.schema(processors.VALUE).parquet(f"{tmp_path}/out").collect()

    before = run()[1]
    spark.createDataFrame([("K0", "S0", 999, "T999999999", 99, 5)], processors.POSITION).write.mode("append").parquet(f"{tmp_path}/held")
    query, after = run()
    assert metrics.late_rows(query) >= 1
    assert sorted(map(str, after)) == sorted(map(str, before))
