"""The two jobs on streams: trades to positions, positions and prices to values.

Both read and write records (key, JSON value, timestamp), in directories or on
Kafka, as a JobConfig says. File sinks commit each micro-batch once, so results
are exactly-once over failures and restarts from the same checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..config import JobConfig
from ..functions import records
from ..functions.amounts import market_value
from ..functions.times import next_boundary
from ..operators import positions
from ..plans import checks, tables
from ..plans.sql import HOUR
from ..scratch import exists, new_path
from ..sources import files, kafka, replay
from . import carried, gauges, intake, processors, rescale

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_positions(updates: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One position per update, from keyed state. totals: each key's quantity
    and number of updates to go on from, when the state is new."""
    before = None if totals is None else totals.groupBy("key")
    return updates.groupBy("key").transformWithStateInPandas(processors.RunningPosition(), processors.POSITION, "Append", "None", before)


def once(rows: DataFrame, keys: list[str], time: str, remember_millis: int) -> DataFrame:
    """The stream without repeats by these keys. A repeat comes while its keys
    are remembered, for `remember_millis` of event time, or is late and left out
    for that; so is a first copy that comes later than this."""
    timed = rows.withColumn("_ts", F.timestamp_millis(time)).withWatermark("_ts", f"{remember_millis} milliseconds")
    return timed.dropDuplicatesWithinWatermark(keys).drop("_ts")


def _timed(rows: DataFrame, delay_millis: int) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis("eventTime")).withWatermark("ts", f"{delay_millis + 1} milliseconds")


def values_at_close(held: DataFrame, ticks: DataFrame, window_millis: int, delay_millis: int = 0, price_windows: int = 240, salts: int = 1, drop_repeats: bool = False) -> DataFrame:
    """held: positions. ticks: prices. Both streams are first brought down to
    one row per key and window; only those reach the keyed state. A symbol's
    keys are dealt to `salts` groups, each with all of its prices. drop_repeats:
    a position that was sent again, by key and update count, is left out."""
    window = F.window("ts", f"{window_millis} milliseconds")
    last = F.max_by(F.struct("quantity", "lastTradeId"), F.struct("eventTime", "updateCount"))
    held = _timed(held, delay_millis)
    if drop_repeats:
        held = held.dropDuplicatesWithinWatermark(["key", "updateCount"])
    held = held.groupBy("key", "symbol", window.alias("w")).agg(last.alias("c"))
    at = F.window_time("w")
    end = next_boundary(F.unix_millis(at), window_millis)
    nothing = lambda kind: F.lit(None).cast(kind)
    salt = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")
    held = held.select("symbol", salt.alias("salt"), F.lit("position").alias("kind"), "key", "c.quantity", "c.lastTradeId", nothing("bigint").alias("cents"), end.alias("windowEnd"), at.alias("at"))
    price = _timed(ticks, delay_millis).groupBy("symbol", window.alias("w")).agg(F.max_by("price", F.struct("eventTime", "seq")).alias("p"))
    cents = (F.col("p") * 100).cast("bigint")
    price = price.select("symbol", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit("price").alias("kind"), nothing("string").alias("key"), nothing("bigint").alias("quantity"), nothing("string").alias("lastTradeId"), cents.alias("cents"), end.alias("windowEnd"), at.alias("at"))
    found = held.union(price).groupBy("symbol", "salt").transformWithStateInPandas(processors.ValueAtClose(window_millis, price_windows), processors.AT_CLOSE, "Append", "EventTime")
    found = found.withColumn("price", (F.col("cents").cast("decimal(20,2)") / 100).cast("decimal(18,2)"))
    return found.select("key", "symbol", "quantity", "price", market_value("quantity", "price").alias("marketValue"), "lastTradeId", "windowEnd")


def start(rows: DataFrame, out: str, checkpoint: str, trigger_millis: int | None = None) -> StreamingQuery:
    """Writes a stream to a directory; without a trigger, all that is there and then ends."""
    trigger = {"processingTime": f"{trigger_millis} milliseconds"} if trigger_millis else {"availableNow": True}
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_batches(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """For sinks without transactions: each micro-batch has a folder of its
    own, written over if the batch is repeated after a failure."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


SIDES = {"positions_by_symbol": positions.by_symbol, "positions_by_account": positions.split}
VALUES = {"mv_by_symbol": "positions_by_symbol", "mv_by_account": "positions_by_account"}


def settled(spark: SparkSession, config: JobConfig) -> SparkSession:
    """A session of its own for a job, with the configuration's settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.shuffle.partitions", config.parallelism)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max" if config.idle_millis else "min")
    if config.gauges_path:
        own.streams.addListener(gauges.Gauges(own, config.gauges_path))
    return own


def source(spark: SparkSession, config: JobConfig, name: str, schema: str, fault: Column, committed: bool = False, resumed: str = "") -> DataFrame:
    """The records of config's `name`_path decoded, with seq. A record that is no
    JSON or has a fault fails the job, or is left out or diverted if config says
    so. resumed: a checkpoint whose run has read the first part already."""
    path = getattr(config, f"{name}_path")
    if config.bad_records == "divert":
        return records.decode_beside(intake.accepted(spark, config, name), schema)
    if config.bootstrap_servers:
        raw = kafka.logged(spark, config, path, committed, rescale.starting_offsets(spark, resumed) if resumed else "earliest")
    else:
        raw = files.logged(spark, path, config.files_per_trigger)
        raw = rescale.rest_of_files(raw, resumed) if resumed else raw
    raw = raw.select("value", "seq")
    if config.bad_records == "fail":
        return records.checked(records.decode_beside(raw, schema), fault)
    return records.quarantine(records.decode_beside(raw, schema, strict=False), fault)[0]


def diverted(spark: SparkSession, config: JobConfig, name: str, schema: str, fault: Column, committed: bool = False) -> dict[str, StreamingQuery]:
    """The stream that judges a source's records, if config asks for it. Without
    a cadence it comes to its end first, so that the job finds all there is."""
    if config.bad_records != "divert":
        return {}
    query = intake.run_intake(spark, config, name, schema, fault, committed)
    if not config.trigger_millis:
        finish(query)
    return {f"intake_{name}": query}


def cadence(config: JobConfig) -> dict:
    return {"processingTime": f"{config.trigger_millis} milliseconds"} if config.trigger_millis else {"availableNow": True}


def gauged(rows: DataFrame, config: JobConfig, name: str, time: str) -> DataFrame:
    return gauges.observed(rows, f"gauge_{name}", "key", time) if config.gauges_path else rows


def sink(rows: DataFrame, config: JobConfig, name: str, schema: str, time: str) -> StreamingQuery:
    """Writes a stream as records to config's `name`_path, at its cadence."""
    rows = gauged(rows, config, name, time)
    out = files.as_records(rows.select(*schemas.names(schema)), schema, "key", time)
    path = getattr(config, f"{name}_path")
    writer = out.writeStream.outputMode("append").queryName(name).option("checkpointLocation", f"{config.checkpoint_path}/{name}").trigger(**cadence(config))
    if config.bootstrap_servers:
        return writer.format("kafka").options(**kafka.write_options(config, path)).start()
    return writer.format("parquet").option("path", path).start()


def run_positions(spark: SparkSession, config: JobConfig, sides: Iterable[str] = tuple(SIDES)) -> dict[str, StreamingQuery]:
    """The first job: orders to positions. One source, a branch for each side
    with its own state and sink. With resume_from, each branch goes on from that
    run's state and from the records it didn't read."""
    own = settled(spark, config)
    found = diverted(own, config, "orders", schemas.BLOCK_TRADE, records.trade_fault())
    for name in sides:
        before = f"{config.resume_from}/{name}" if config.resume_from else ""
        if before and config.bad_records == "divert":
            raise ValueError("the intake's checkpoint goes on by itself: resume_from takes orders as they come")
        if before and not config.bootstrap_servers and not exists(own, f"{config.checkpoint_path}/{name}") and exists(own, getattr(config, f"{name}_path")):
            raise ValueError(f"{name}_path has another run's micro-batches: a resumed run writes beside it")
        trades = source(own, config, "orders", schemas.BLOCK_TRADE, records.trade_fault(), resumed=before)
        if config.repeats == "drop":
            trades = once(trades, ["tradeId"], "eventTime", config.remember_millis)
        totals, updates = rescale.totals(own, before) if before else None, SIDES[name](trades)
        if config.positions_state == "table":
            record = lambda rows: files.as_records(rows.select(*schemas.names(schemas.POSITION)), schemas.POSITION, "key", "eventTime")
            found[name] = carried.start(gauged(updates, config, name, "eventTime"), record, getattr(config, f"{name}_path"), f"{config.checkpoint_path}/{name}", name, cadence(config), totals)
        else:
            found[name] = sink(running_positions(updates, totals), config, name, schemas.POSITION, "eventTime")
    return found


def run_market_values(spark: SparkSession, config: JobConfig, sides: Iterable[str] = tuple(VALUES)) -> dict[str, StreamingQuery]:
    """The second job: positions and prices to values at each close."""
    own = settled(spark, config)
    found = diverted(own, config, "prices", schemas.PRICE, records.price_fault())
    for name in sides:
        found |= diverted(own, config, VALUES[name], schemas.POSITION, records.position_fault(), committed=True)
        ticks = source(own, config, "prices", schemas.PRICE, records.price_fault())
        held = source(own, config, VALUES[name], schemas.POSITION, records.position_fault(), committed=True)
        values = values_at_close(held, ticks, config.window_millis, config.delay_millis, config.price_windows, config.salts, config.repeats == "drop")
        found[name] = sink(values, config, name, schemas.MARKET_VALUE, "windowEnd")
    return found


def supervise(queries: dict[str, StreamingQuery], poll_seconds: float = 0.2) -> None:
    """Waits until all have ended. If one fails, the others are stopped and its
    error is raised, so a job never runs on with a part of it."""
    waiting = dict(queries)
    try:
        while waiting:
            for name, query in list(waiting.items()):
                if query.awaitTermination(poll_seconds):  # raises what the query failed with
                    finish(query)
                    del waiting[name]
    finally:
        for query in waiting.values():
            query.stop()


def published(spark: SparkSession, sf_dir: str, prices: bool) -> JobConfig:
    """The given tables' trades (and prices) as records, and a configuration
    that reads them to their end."""
    top = new_path(spark, "job")
    config = JobConfig(**{f"{n}_path": f"{top}/{n}" for n in ("orders", "prices", "checkpoint", *SIDES, *VALUES)}, window_millis=HOUR, delay_millis=0, idle_millis=0, trigger_millis=0, parallelism=int(spark.conf.get("spark.sql.shuffle.partitions")), positions_state="table")
    files.publish(tables.trades(spark, sf_dir), config.orders_path, schemas.BLOCK_TRADE, "tradeId", "eventTime", "tradeId")
    if prices:
        ticks = tables.prices(spark, sf_dir)
        files.publish(ticks, config.prices_path, schemas.PRICE, "symbol", "eventTime", "seq")
    return config


def stream_positions(spark: SparkSession, sf_dir: str, by_account: bool) -> DataFrame:
    """Positions of all events by the first job, over records."""
    config, name = published(spark, sf_dir, prices=False), f"positions_by_{'account' if by_account else 'symbol'}"
    finish(run_positions(spark, config, [name])[name])
    return files.complete(spark, getattr(config, f"{name}_path"), schemas.POSITION).select(*schemas.names(processors.POSITION))


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every ten trades one loses its quantity, its side, its symbol and the
    end of its record: how many records the intake sets apart, by reason, and how
    many it hands on."""
    whole = published(spark, sf_dir, prices=False)
    config = replace(whole, orders_path=f"{whole.orders_path}-damaged", intake_path=f"{whole.orders_path}-judged", bad_records="divert")
    n, value = F.regexp_extract("value", r'"tradeId":"T(\d+)"', 1).cast("bigint") % 10, F.col("value")
    lost = lambda pattern, by: F.regexp_replace(value, pattern, by)
    damaged = F.when(n == 0, lost(r'"quantity":\d+,"side"', '"quantity":0,"side"')).when(n == 1, lost(r'"side":"\w+"', '"side":"HOLD"')).when(n == 2, lost(r'"symbol":"\w+"', '"symbol":" "')).when(n == 3, F.substring(value, 1, 40)).otherwise(value)
    spark.read.schema(files.RECORD).parquet(whole.orders_path).withColumn("value", damaged).write.parquet(config.orders_path)
    supervise(diverted(settled(spark, config), config, "orders", schemas.BLOCK_TRADE, records.trade_fault()))
    judged = spark.read.parquet(intake.place(config, "orders"))
    return judged.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def stream_trades_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by symbol where every third trade is in the log twice."""
    config = replace(published(spark, sf_dir, prices=False), repeats="drop", remember_millis=10 * 365 * 86_400_000)
    log = spark.read.schema(files.RECORD).parquet(config.orders_path)
    log.filter(F.crc32(F.col("key").cast("binary")) % 3 == 0).write.parquet(f"{config.orders_path}-again")
    spark.read.schema(files.RECORD).parquet(f"{config.orders_path}-again").write.mode("append").parquet(config.orders_path)
    supervise(run_positions(spark, config, ["positions_by_symbol"]))
    return files.complete(spark, config.positions_by_symbol_path, schemas.POSITION).select(*schemas.names(processors.POSITION))


def replay_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the trades, in five parts: each published record's part and trade."""
    trades = tables.trades(spark, sf_dir)
    n, top = trades.count() * 3 // 4, new_path(spark, "replay")
    record = files.record_columns(trades, schemas.BLOCK_TRADE, "tradeId", "eventTime")
    parts = replay.prepare(trades, record, f"{top}/prepared", n, -(-n // 5), "eventTime", "tradeId")
    replay.run(spark, f"{top}/prepared", f"{top}/orders", f"{top}/checkpoint", parts)
    out = spark.read.schema(f"{files.RECORD}, batch BIGINT").parquet(f"{top}/orders")
    return out.select(F.col("key").alias("tradeId"), "batch")


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed state of both sides against the positions that were written."""
    config = replace(published(spark, sf_dir, prices=False), positions_state="keyed")
    supervise(run_positions(spark, config))
    written = lambda name: files.complete(spark, getattr(config, f"{name}_path"), schemas.POSITION)
    return checks.union(*(checks.state(rescale.totals(spark, f"{config.checkpoint_path}/{name}"), written(name), name.removeprefix("positions_by_")) for name in SIDES))


def stream_market_values(spark: SparkSession, sf_dir: str, by_account: bool) -> DataFrame:
    """Market values by both jobs: the second reads what the first wrote."""
    config, side = published(spark, sf_dir, prices=True), "account" if by_account else "symbol"
    finish(run_positions(spark, config, [f"positions_by_{side}"])[f"positions_by_{side}"])
    finish(run_market_values(spark, config, [f"mv_by_{side}"])[f"mv_by_{side}"])
    return files.complete(spark, getattr(config, f"mv_by_{side}_path"), schemas.MARKET_VALUE).select(*schemas.names(processors.VALUE))


def main() -> None:
    """python -m tallymark.streaming.jobs positions|market-values, set up by the environment."""
    jobs = {"positions": run_positions, "market-values": run_market_values}
    if len(sys.argv) != 2 or sys.argv[1] not in jobs:
        raise SystemExit(f"usage: {sys.argv[0]} {'|'.join(jobs)}")
    spark = SparkSession.builder.appName(sys.argv[1]).getOrCreate()
    supervise(jobs[sys.argv[1]](spark, JobConfig.from_environment()))


if __name__ == "__main__":
    main()
