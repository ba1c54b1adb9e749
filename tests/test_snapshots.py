"""Bounded replay, sealed snapshots, ordered fingerprints, gauges and the audit of state."""

import dataclasses
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.operators import positions, relations
from tallymark.plans import checks
from tallymark.plans.catalog import _power
from tallymark.sources import files, replay
from tallymark.streaming import gauges, jobs, rescale
from tests.test_streams import configured, orders, put, read, same


def test_numbers_follow_the_order_over_all_buckets(spark):
    rows = orders(spark, 0, 500).select("tradeId", "eventTime").repartition(7)
    got = {r.tradeId: r.ordinal for r in relations.numbered(rows, "eventTime", "tradeId", 30_000).collect()}
    assert got == {f"T{k:09d}": k for k in range(500)}


def prepared(spark, top, n, per_batch):
    rows = orders(spark, 0, 100).repartition(3)
    return replay.prepare(rows, files.record_columns(rows, schemas.BLOCK_TRADE, "tradeId", "eventTime"), f"{top}/prepared", n, per_batch, "eventTime", "tradeId")


def test_a_replay_has_n_records_in_order_and_goes_on(spark, tmp_path):
    assert prepared(spark, tmp_path, 64, 10) == 7
    where = (f"{tmp_path}/prepared", f"{tmp_path}/orders", f"{tmp_path}/checkpoint")
    replay.run(spark, *where, 3)  # stopped after three parts or a little later
    before = {x: os.stat(f"{tmp_path}/orders/{x}").st_mtime_ns for x in os.listdir(f"{tmp_path}/orders") if x.startswith("batch=")}
    assert 3 <= len(before)
    replay.run(spark, *where, 7)
    assert all(os.stat(f"{tmp_path}/orders/{x}").st_mtime_ns == t for x, t in before.items())  # nothing is published twice
    found = spark.read.schema(f"{files.RECORD}, batch INT").parquet(f"{tmp_path}/orders").collect()
    assert sorted((r.batch, r.key) for r in found) == [(k // 10, f"T{k:09d}") for k in range(64)]


def test_a_replayed_log_feeds_the_job(spark, tmp_path):
    parts = prepared(spark, tmp_path, 50, 20)
    config = configured(tmp_path, files_per_trigger=1)
    replay.run(spark, f"{tmp_path}/prepared", config.orders_path, f"{tmp_path}/clock", parts)
    query = jobs.run_positions(spark, config, ["positions_by_symbol"])
    jobs.supervise(query)
    assert [p.numInputRows for p in query["positions_by_symbol"].recentProgress if p.numInputRows] == [20, 20, 10]
    held = positions.running(positions.by_symbol(orders(spark, 0, 50)))
    assert same(read(spark, config.positions_by_symbol_path, schemas.POSITION).select(*held.columns), held)


def test_a_log_too_short_to_replay(spark, tmp_path):
    with pytest.raises(ValueError, match="100 of 101"):
        prepared(spark, tmp_path, 101, 50)


def test_a_short_partition_is_named(spark, tmp_path):
    path, whole = f"{tmp_path}/orders", orders(spark, 0, 90)
    files.publish(whole, path, schemas.BLOCK_TRADE, "tradeId", "eventTime", "tradeId", partitions=3)
    with pytest.raises(ValueError, match="no manifest"):
        files.complete(spark, path, schemas.BLOCK_TRADE, sealed=True)
    files.seal(spark, path)
    assert same(files.complete(spark, path, schemas.BLOCK_TRADE, sealed=True), whole)
    parts = sorted(x for x in os.listdir(path) if x.startswith("part-"))
    n = spark.read.parquet(f"{path}/{parts[0]}").count()
    os.remove(f"{path}/{parts[0]}")
    with pytest.raises(ValueError, match=f"{parts[0]} holds 0 of {n}"):
        files.complete(spark, path, schemas.BLOCK_TRADE, sealed=True)
    put(orders(spark, 90, 95), path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    files.seal(spark, path)  # the end has moved
    assert files.complete(spark, path, schemas.BLOCK_TRADE, sealed=True).count() == 95 - n


def test_two_records_that_change_places_change_the_ordered_fingerprint(spark):
    rows = orders(spark, 0, 300).select("tradeId", "eventTime", F.col("eventTime").cast("string").alias("body"))
    swapped = rows.withColumn("body", F.when(F.col("eventTime") == 7_000, "250000").when(F.col("eventTime") == 250_000, "7000").otherwise(F.col("body")))
    of = lambda r: relations.ordered_fingerprint(r, F.col("body"), "eventTime", "tradeId").first()
    a, b, again = of(rows), of(swapped), of(rows.repartition(5))
    assert a == again and a.records == b.records == 300 and a.hash != b.hash
    assert relations.fingerprint(rows, F.col("body")).first() == relations.fingerprint(swapped, F.col("body")).first()
    assert of(rows.limit(0)).records == 0


def test_the_power_is_the_power(spark):
    of = [0, 1, 2, 1000, 2**31, 2**39 + 12345]
    df = spark.createDataFrame([(k,) for k in of], "i bigint").select("i", *(relations.power(b, F.col("i")).alias(f"b{b}") for b in relations.BASES))
    assert [tuple(r) for r in df.collect()] == [(k, *(pow(b, k, relations.PRIME) for b in relations.BASES)) for k in of]


def test_the_power_in_sql_is_the_power():
    """Beyond the first million of rows too."""
    of = [0, 1, 1000, 2**20 - 1, 2**20, 3 * 2**20 + 5, 2**31, 2**39 + 12345]
    for b in relations.BASES:
        assert duckdb.sql(f"SELECT {_power(b)} FROM (SELECT unnest({of}) AS i)").fetchall() == [(pow(b, k, relations.PRIME),) for k in of]


@pytest.mark.parametrize("state", ["keyed", "table"])
def test_gauges_outlive_a_restart(spark, tmp_path, state):
    config = configured(tmp_path, files_per_trigger=1, gauges_path=f"{tmp_path}/gauges", positions_state=state)
    for lo, hi in ((1, 40), (20, 90)):  # the second run sees both keys again
        put(orders(spark, lo, hi), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
        queries = jobs.run_positions(spark, config)
        jobs.supervise(queries)
        gauges.settle(queries, spark)
    found = {r.stream: r for r in gauges.summary(spark, config.gauges_path).collect()}
    n = 39 + 70
    assert {s: (r.records, r.keys, r.batches) for s, r in found.items()} == {"positions_by_symbol": (n, 2, 2), "positions_by_account": (3 * n, 6, 2)}
    assert all(r.p99_age_millis > 0 and r.micro_batch_millis > 0 and r.late == 0 for r in found.values())


def test_the_audit_sees_a_tampered_state(spark, tmp_path):
    config = configured(tmp_path, positions_state="table")
    put(orders(spark, 1, 80), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "tradeId")
    jobs.supervise(jobs.run_positions(spark, config, ["positions_by_account"]))
    checkpoint, written = f"{config.checkpoint_path}/positions_by_account", read(spark, config.positions_by_account_path, schemas.POSITION)
    audit = lambda: {r.name: (r.actual, r.ok) for r in checks.state(rescale.totals(spark, checkpoint), written, "account").collect()}
    assert audit() == {"account keys in state": (6, True), "account keys on one side": (0, True), "account unequal quantities": (0, True), "account unequal update counts": (0, True)}
    bad = rescale.totals(spark, checkpoint).withColumn("quantity", F.when(F.col("key") == "H1/s/S0", F.col("quantity") + 1).otherwise(F.col("quantity"))).filter("key != 'H2/s/S1'").collect()
    spark.createDataFrame(bad, "key STRING, quantity BIGINT, updates BIGINT").write.mode("overwrite").parquet(f"{checkpoint}/totals/0")
    assert audit() == {"account keys in state": (5, False), "account keys on one side": (1, False), "account unequal quantities": (2, False), "account unequal update counts": (1, False)}


def test_settings_are_checked():
    config = configured("x")
    for bad in ({"bad_records": "x"}, {"repeats": "x"}, {"positions_state": "x"}, {"remember_millis": 0}, {"positions_state": "table", "bootstrap_servers": "b:1"}):
        with pytest.raises(ValueError):
            dataclasses.replace(config, **bad)
