"""Bad records, repeats, kills, failing branches and another parallelism: nothing is lost or counted twice."""

import dataclasses
import os
import signal
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions import records
from tallymark.operators import positions
from tallymark.operators.market_value import value_at_close
from tallymark.sources import files
from tallymark.streaming import intake, jobs, rescale
from tests.test_streams import MINUTE, configured, orders, put, read, same, ticks

BAD = ["{oops", '{"symbol":"S0","side":"BUY","quantity":-3}', '{"allocations":[],"eventTime":"x","quantity":1}', None]


def put_bad(spark, path, n):
    rows = [(f"bad{n}-{k}", value, None) for k, value in enumerate(BAD)]
    spark.createDataFrame(rows, files.RECORD).coalesce(1).write.mode("append").parquet(path)


def held_by(rows, side="positions_by_symbol"):
    return positions.running(jobs.SIDES[side](rows))


def test_each_record_has_its_reason(spark):
    raw = spark.createDataFrame([(v, k) for k, v in enumerate([*BAD, '{"price":1.00,"eventTime":5,"symbol":"S"}'])], "value STRING, key INT")
    found = {r.key: r.reason for r in records.judged(raw, schemas.PRICE, records.price_fault()).collect()}
    assert found == {0: "malformed", 1: "price not positive", 2: "malformed", 3: "malformed", 4: None}


KILLED = """
import sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
from tallymark.config import JobConfig
from tallymark.streaming import jobs
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {top!r} + "/w").getOrCreate()
jobs.supervise(jobs.run_positions(spark, JobConfig(**{config!r}), ["positions_by_symbol"]))
"""


def killed(top, config, log, batches):
    """Runs the positions job in a process of its own and kills it once so many
    micro-batches of that log have begun; whether it was still at work."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = KILLED.format(home=home, top=str(top), config=dataclasses.asdict(config))
    job = subprocess.Popen([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": home}, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    n = 0
    try:
        for _ in range(900):
            n = len([x for x in os.listdir(log) if x.isdigit()]) if os.path.isdir(log) else 0
            if n >= batches or job.poll() is not None:
                break
            time.sleep(0.1)
        return n >= batches and job.poll() is None
    finally:
        os.killpg(job.pid, signal.SIGKILL)
        job.wait()


def test_dead_letters_add_up_through_a_kill(spark, tmp_path):
    config = configured(tmp_path, files_per_trigger=1, trigger_millis=1, bad_records="divert", intake_path=f"{tmp_path}/intake")
    for n in range(6):
        put(orders(spark, 40 * n, 40 * n + 40), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
        put_bad(spark, config.orders_path, n)
    assert killed(tmp_path, config, f"{config.checkpoint_path}/intake_orders/offsets", 4)
    ended = os.listdir(f"{config.checkpoint_path}/intake_orders/commits")
    assert len([x for x in ended if x.isdigit()]) < 12  # it wasn't done
    jobs.supervise(jobs.run_positions(spark, dataclasses.replace(config, trigger_millis=0), ["positions_by_symbol"]))
    dead = intake.dead_letters(spark, config, "orders")
    assert {r.reason: r.n for r in dead.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()} == {"malformed": 18, "blank tradeId": 6}
    assert dead.select("key").distinct().count() == dead.select("seq").distinct().count() == 24
    good = spark.read.parquet(f"{tmp_path}/intake/orders").filter("fate = 'good'")
    assert good.count() == good.select("key").distinct().count() == 240
    held = held_by(orders(spark, 0, 240))
    assert same(read(spark, config.positions_by_symbol_path, schemas.POSITION).select(*held.columns), held)


def test_both_jobs_divert(spark, tmp_path):
    config = configured(tmp_path, bad_records="divert", intake_path=f"{tmp_path}/intake")
    put(orders(spark, 0, 200), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    put(ticks(spark, 0, 30), config.prices_path, schemas.PRICE, "symbol", "seq")
    put_bad(spark, config.prices_path, 0)
    jobs.supervise(jobs.run_positions(spark, config, ["positions_by_account"]))
    jobs.supervise(jobs.run_market_values(spark, config, ["mv_by_account"]))
    assert [intake.dead_letters(spark, config, n).count() for n in ("orders", "prices", "positions_by_account")] == [0, 4, 0]
    mv = value_at_close(held_by(orders(spark, 0, 200), "positions_by_account"), ticks(spark, 0, 30), MINUTE)
    assert same(read(spark, config.mv_by_account_path, schemas.MARKET_VALUE).select(*mv.columns), mv) and mv.count() > 0


def test_trades_that_are_sent_again_count_once(spark, tmp_path):
    """A producer's and a whole file's replay, in the same and in later micro-batches."""
    config = configured(tmp_path, files_per_trigger=1, repeats="drop", remember_millis=60_000)
    for lo, hi in ((1, 60), (30, 120), (100, 180), (1, 20)):  # the last one's are long forgotten: late
        put(orders(spark, lo, hi), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
        time.sleep(1.1)  # files are read in the order of their times
    jobs.supervise(jobs.run_positions(spark, config, ["positions_by_symbol"]))
    held = held_by(orders(spark, 1, 180))
    assert same(read(spark, config.positions_by_symbol_path, schemas.POSITION).select(*held.columns), held)


def test_positions_that_are_sent_again_change_no_value(spark, tmp_path):
    config = configured(tmp_path, repeats="drop", files_per_trigger=1)
    held = held_by(orders(spark, 1, 300), "positions_by_account")
    parts = [held.filter(F.col("eventTime").between(lo, lo + 149_999)) for lo in (0, 150_000)]
    for part in (parts[0], parts[0], parts[1], parts[0].union(parts[1])):
        put(part, config.positions_by_account_path, schemas.POSITION, "key", "updateCount")
        time.sleep(1.1)
    put(ticks(spark, 0, 45), config.prices_path, schemas.PRICE, "symbol", "seq")
    queries = jobs.run_market_values(spark, config, ["mv_by_account"])
    jobs.supervise(queries)
    mv = value_at_close(held, ticks(spark, 0, 45), MINUTE)
    found = read(spark, config.mv_by_account_path, schemas.MARKET_VALUE)
    assert same(found.select(*mv.columns), mv) and mv.count() > 0
    dropped = sum(s.customMetrics.get("numDroppedDuplicateRows", 0) for p in queries["mv_by_account"].recentProgress for s in p.stateOperators)
    assert dropped >= parts[0].count()


@pytest.mark.parametrize("states, to", [(("keyed", "keyed"), 4), (("keyed", "table"), 1), (("table", "keyed"), 4)])
def test_another_parallelism_goes_on_exactly(spark, tmp_path, states, to):
    config = configured(tmp_path, files_per_trigger=2, parallelism=2, positions_state=states[0])
    for lo in (0, 40, 80):
        put(orders(spark, lo, lo + 40), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    jobs.supervise(jobs.run_positions(spark, config, ["positions_by_account"]))
    old = f"{config.checkpoint_path}/positions_by_account"
    assert {r.key: (r.quantity, r.updates) for r in rescale.totals(spark, old).collect()} == {r.key: (r.quantity, r.updateCount) for r in positions.final(held_by(orders(spark, 0, 120), "positions_by_account")).collect()}
    resumed = dataclasses.replace(config, parallelism=to, positions_state=states[1], resume_from=config.checkpoint_path, checkpoint_path=f"{tmp_path}/second")
    with pytest.raises(ValueError, match="writes beside it"):
        jobs.run_positions(spark, resumed, ["positions_by_account"])
    resumed = dataclasses.replace(resumed, positions_by_account_path=f"{tmp_path}/positions_second")
    for hi in (150, 190):  # and once more, from the new checkpoint
        put(orders(spark, 120 if hi == 150 else 150, hi), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
        query = jobs.run_positions(spark, resumed, ["positions_by_account"])
        jobs.supervise(query)
        if states[1] == "keyed":
            assert {s.numShufflePartitions for p in query["positions_by_account"].recentProgress for s in p.stateOperators} == {to}
    held = held_by(orders(spark, 0, 190), "positions_by_account")
    found = read(spark, config.positions_by_account_path, schemas.POSITION).union(read(spark, resumed.positions_by_account_path, schemas.POSITION))
    assert same(found.select(*held.columns), held)


def test_a_run_that_did_not_end_is_not_taken_over(spark, tmp_path):
    config = configured(tmp_path)
    put(orders(spark, 0, 20), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    jobs.supervise(jobs.run_positions(spark, config, ["positions_by_symbol"]))
    checkpoint = f"{config.checkpoint_path}/positions_by_symbol"
    os.remove(f"{checkpoint}/commits/0")
    with pytest.raises(ValueError, match="no finished run"):
        rescale.last_batch(spark, checkpoint)


def test_a_failing_branch_ends_the_job(spark, tmp_path):
    good = configured(tmp_path / "good", trigger_millis=200)
    bad = configured(tmp_path / "bad", trigger_millis=200)
    put(orders(spark, 0, 20), good.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    put_bad(spark, bad.orders_path, 0)
    queries = {"good": jobs.run_positions(spark, good, ["positions_by_symbol"])["positions_by_symbol"], "bad": jobs.run_positions(spark, bad, ["positions_by_account"])["positions_by_account"]}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|STREAM_FAILED"):
        jobs.supervise(queries)
    assert not queries["good"].isActive and not queries["bad"].isActive
