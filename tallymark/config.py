"""Settings of the position and market-value jobs."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class JobConfig:
    """Times are milliseconds. Every field can be set by an environment
    variable of its name in capitals.

    The paths are directories of records or, with bootstrap_servers, Kafka
    topics. A positive idle_millis lets a silent source not hold the others
    back (Spark has no idle timer: the source that is furthest ahead then sets
    the watermark). trigger_millis is the cadence of the micro-batches, 0 for all
    that is there and then an end. parallelism is the number of shuffle
    partitions, and salts that of the groups a symbol's keys are dealt to.

    bad_records: fail ends the job at a record that breaks a rule, skip leaves it
    out, divert puts it beside the good ones under intake_path, with the reason.
    repeats: drop leaves out records that an at-least-once writer sent again:
    trades by id within remember_millis of event time, positions by key and
    update count. resume_from: a checkpoint_path of a run of the positions job
    that has ended; a new run takes its state over and may have another
    parallelism, with its own checkpoint_path and output paths.

    gauges_path: where the streams' live numbers are kept (see streaming/gauges.py);
    empty for none.

    positions_state: keyed holds each key's total in the state store, table in a
    table that each micro-batch reads whole (see streaming/carried.py): for hot
    keys and large micro-batches; it writes directories only.
    """

    orders_path: str = "orders"
    prices_path: str = "prices"
    positions_by_symbol_path: str = "positions-by-symbol"
    positions_by_account_path: str = "positions-by-account"
    mv_by_symbol_path: str = "mv-by-symbol"
    mv_by_account_path: str = "mv-by-account"
    checkpoint_path: str = "checkpoints"
    bootstrap_servers: str = ""
    window_millis: int = 60_000
    delay_millis: int = 2_000
    idle_millis: int = 5_000
    trigger_millis: int = 5_000
    price_windows: int = 240
    parallelism: int = 2
    salts: int = 4
    files_per_trigger: int = 1000
    bad_records: str = "fail"
    intake_path: str = "intake"
    repeats: str = "keep"
    remember_millis: int = 86_400_000
    resume_from: str = ""
    positions_state: str = "keyed"
    gauges_path: str = ""

    def __post_init__(self) -> None:
        for name in ("window_millis", "price_windows", "parallelism", "salts", "files_per_trigger", "remember_millis"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if min(self.delay_millis, self.idle_millis, self.trigger_millis) < 0:
            raise ValueError("delays can't be negative")
        if self.bad_records not in ("fail", "skip", "divert"):
            raise ValueError("bad_records is fail, skip or divert")
        if self.positions_state not in ("keyed", "table") or (self.positions_state == "table" and self.bootstrap_servers):
            raise ValueError("positions_state is keyed or, for directories, table")
        if self.repeats not in ("keep", "drop"):
            raise ValueError("repeats is keep or drop")

    @classmethod
    def from_environment(cls, env: Mapping[str, str] | None = None) -> JobConfig:
        env = os.environ if env is None else env
        given = {f.name: env[f.name.upper()] for f in fields(cls) if env.get(f.name.upper(), "").strip()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items()})
