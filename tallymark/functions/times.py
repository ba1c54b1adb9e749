"""Windows over epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_boundary(time: Column | str, window_millis: int) -> Column:
    """The first window boundary strictly after a time: one that falls on a
    boundary belongs to the next window. Right for negative times too."""
    time = F.col(time) if isinstance(time, str) else time
    return time - F.pmod(time, F.lit(window_millis)) + F.lit(window_millis)


def last_boundary(time: Column | str, window_millis: int) -> Column:
    """The last window boundary at or before a time."""
    time = F.col(time) if isinstance(time, str) else time
    return time - F.pmod(time, F.lit(window_millis))
