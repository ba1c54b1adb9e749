"""Keyed state: one output per update, and values at every close."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

POSITION = "key STRING, symbol STRING, quantity BIGINT, lastTradeId STRING, updateCount BIGINT, eventTime BIGINT"
VALUE = "key STRING, symbol STRING, quantity BIGINT, price DECIMAL(18,2), marketValue DECIMAL(38,2), lastTradeId STRING, windowEnd BIGINT"
AT_CLOSE = "key STRING, symbol STRING, quantity BIGINT, cents BIGINT, lastTradeId STRING, windowEnd BIGINT"


class RunningPosition(StatefulProcessor):
    """The position after each update. Updates of one micro-batch are taken in
    the order of event time and trade id, as whole columns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "quantity BIGINT, updates BIGINT")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Goes on from the totals of another run."""
        self.total.update((int(initialState["quantity"].iloc[0]), int(initialState["updates"].iloc[0])))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        quantity, updates = self.total.get() if self.total.exists() else (0, 0)
        own = pd.concat(rows, ignore_index=True).sort_values(["eventTime", "tradeId"], ignore_index=True)
        held = quantity + own["signedQuantity"].cumsum()
        if (abs(quantity + own["signedQuantity"].astype(float).cumsum()) >= 2.0**63).any():
            raise OverflowError(f"the position of {key[0]} has more than 63 bits")
        self.total.update((int(held.iloc[-1]), updates + len(own)))
        counts = pd.RangeIndex(updates + 1, updates + len(own) + 1)
        yield pd.DataFrame({"key": own["key"], "symbol": own["symbol"], "quantity": held, "lastTradeId": own["tradeId"], "updateCount": counts, "eventTime": own["eventTime"]})

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(blob).read_all().to_pandas()


class ValueAtClose(StatefulProcessor):
    """Positions and prices at every boundary, for the keys of one symbol and salt.

    Rows are closing positions and closing prices, one per window at most. They
    wait as they came, a frame for each micro-batch, until the watermark passes
    their window; a timer then gives all boundaries up to the watermark their
    latest closing values, by columns, and is set again for the next, so quiet
    keys go on. A key is silent while no price of the last `reach` windows is
    known. At most `cells` values, or one window, are put out at a time.
    """

    def __init__(self, window_millis: int, reach: int, cells: int = 1 << 18):
        self.window, self.reach, self.cells = window_millis, reach, cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.held = handle.getValueState("held", "at BIGINT, positions BINARY, prices BINARY")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own = pd.concat(rows, ignore_index=True)[["windowEnd", "kind", "key", "quantity", "lastTradeId", "cents"]]
        self.waiting.appendValue((_packed(own),))
        known = own["kind"] == "position"
        if known.any() and not self.held.exists():
            first = int(own.loc[known, "windowEnd"].min())
            self.held.update((first, None, None))
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, (at, held, prices) = timerValues.getCurrentWatermarkInMs(), self.held.get()
        rows = pd.concat([_unpacked(r[0]) for r in self.waiting.get()], ignore_index=True)
        due = rows[rows["windowEnd"] <= now].sort_values("windowEnd", kind="stable")
        later = rows[rows["windowEnd"] > now]
        known = due["kind"] == "position"
        # held positions come first, then closing ones by window: the latest row so far is the one in force
        closes = due.loc[known, ["key", "quantity", "lastTradeId", "windowEnd"]]
        if held is not None:
            closes = pd.concat([_unpacked(held), closes], ignore_index=True)
        ticks = due.loc[~known, ["windowEnd", "cents"]]
        if prices is not None:
            ticks = pd.concat([_unpacked(prices), ticks], ignore_index=True)
        code, keys = pd.factorize(closes["key"])
        quantity, trade = closes["quantity"].to_numpy(np.int64), closes["lastTradeId"].to_numpy(object)
        ends = np.arange(at, now + 1, self.window)
        column = np.maximum(0, (closes["windowEnd"].to_numpy(np.int64) - at) // self.window)
        latest = np.full(len(keys), -1, np.int64)
        step = max(1, self.cells // max(1, len(keys)))
        for low in range(0, len(ends), step):
            part = ends[low : low + step]
            first = np.full((len(keys), len(part) + 1), -1, np.int64)
            first[:, 0] = latest
            own = np.flatnonzero((column >= low) & (column < low + len(part)))
            np.maximum.at(first, (code[own], column[own] - low + 1), own)
            row = np.maximum.accumulate(first, axis=1)[:, 1:]
            latest = row[:, -1]
            tick = np.searchsorted(ticks["windowEnd"].to_numpy(np.int64), part, "right") - 1
            cents, since = np.append(ticks["cents"].to_numpy(np.int64), 0), np.append(ticks["windowEnd"].to_numpy(np.int64), 0)
            priced = (tick >= 0) & (part - since[tick] < self.reach * self.window)
            k, w = np.nonzero((row >= 0) & priced)
            if len(k):
                at_row = row[k, w]
                yield pd.DataFrame({"key": keys[k], "symbol": key[0], "quantity": quantity[at_row], "cents": cents[tick[w]], "lastTradeId": trade[at_row], "windowEnd": part[w]})
        kept = closes.iloc[latest[latest >= 0]].assign(windowEnd=at)
        after = int(ends[-1]) + self.window
        self.held.update((after, _packed(kept), _packed(ticks.tail(1))))
        if len(later):
            self.waiting.put([(_packed(later),)])
        else:
            self.waiting.clear()
        self.handle.registerTimer(after)

    def close(self) -> None:
        pass
