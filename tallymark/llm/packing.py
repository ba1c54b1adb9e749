"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces no longer than the largest length; pieces are dealt
by hash to shards of bounded size and packed there, longest first. When a bin
has to be opened for a piece, each permitted length that holds it is filled on
trial with what fits best of the pieces left, again and again the largest that
fits, and downsized; the one that costs least for what it holds is opened. The
plain way, where every bin opens with one length and pieces go to the open bin
that they fill best, is tried for each length too, and the cheapest of all these
answers is the shard's. Every bin has the least length that holds its contents.

With an order given, shards are consecutive ranges of it instead, and bins are
numbered in it, so that read by number the sequences follow it.

Defined cases: a null or negative size counts as 0, and an empty text is one
piece of length 0; ties in length go by id and piece; rows that repeat an id
are packed each, and very many of them are dealt to many shards. Every position of every text is in exactly one piece.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTHS = (2048, 4096, 8192, 16384)
#: Pieces that share a shard, about.
SHARD = 4096


def sequence_cost(length: int) -> float:
    """A sequence costs its length, padding included, and 64 for being one."""
    return length + 64


def best_fit(sizes: Sequence[int], lengths: Sequence[int], opening: int) -> tuple[list[int], list[int]]:
    """Bin of each size (given longest first) and the downsized bins' lengths,
    if bins open with the length `opening`."""
    lengths = sorted(lengths)
    least = lambda n: lengths[bisect_left(lengths, n)]
    room: list[tuple[int, int]] = []  # room left and bin, of open bins
    filled: list[int] = []
    where = []
    for n in sizes:
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, k = room.pop(at)
        else:
            left, k = max(opening, least(n)), len(filled)
            filled.append(0)
        filled[k] += n
        where.append(k)
        if left > n:
            insort(room, (left - n, k))
    return where, [least(n) for n in filled]


def joint_fit(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """Bin of each size (given longest first) and the bins' lengths, if each bin
    opens with the length that costs least for what it then holds."""
    lengths = sorted(lengths)
    left, index = list(reversed(sizes)), list(range(len(sizes) - 1, -1, -1))  # shortest first
    where, found = [0] * len(sizes), []
    while left:
        best: tuple[float, int, list[int], int] | None = None
        for length in lengths[bisect_left(lengths, left[-1]) :]:
            picked = [len(left) - 1]
            used = left[-1]
            while picked[-1] > 0:
                at = min(bisect_right(left, length - used), picked[-1]) - 1
                if at < 0:
                    break
                picked.append(at)
                used += left[at]
            final = lengths[bisect_left(lengths, used)]
            trial = (cost(final) / max(used, 1), -final, picked, final)
            if best is None or trial[:2] < best[:2]:
                best = trial
        for at in best[2]:
            where[index[at]] = len(found)
            del left[at], index[at]
        found.append(best[3])
    return where, found


def pack_shard(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float]) -> tuple[list[int], list[int]]:
    """The cheapest of joint_fit()'s and best_fit()'s answers; of equal ones the
    joint one, then the largest opening."""
    trials = [joint_fit(sizes, lengths, cost), *(best_fit(sizes, lengths, opening) for opening in sorted(lengths, reverse=True))]
    return min(trials, key=lambda t: sum(map(cost, t[1])))


def _before(slots: DataFrame, group: int = 1024) -> DataFrame:
    """_slot and _before: how many pieces the slots before it have. Groups of
    slots are summed first, so that one task has a row for each group only."""
    own = slots.withColumn("_group", F.floor(F.col("_by0") / group))
    groups = own.groupBy("_group").agg(F.sum("own").alias("all"))
    groups = groups.select("_group", (F.sum("all").over(Window.orderBy("_group")) - F.col("all")).alias("g0"))
    within = Window.partitionBy("_group").orderBy("_by0")
    return own.withColumn("b0", F.sum("own").over(within) - F.col("own")).join(groups, "_group").select(F.col("_by0").alias("_slot"), (F.col("g0") + F.col("b0")).alias("_before"))


def pack(docs: DataFrame, size: Column, id_col: str = "doc_id", lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = sequence_cost, order: Sequence[str] = ()) -> DataFrame:
    """id, piece (number within its row), start and length (its span), bin,
    bin_length, bin_start (where in the bin the piece goes): all pieces.
    order: columns of docs to keep the order of. The first is a number that a
    bounded count of rows share, such as a slot of source_mix.mix()."""
    largest = max(lengths)
    rows = docs.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(order)), F.monotonically_increasing_id().alias("_read"))
    by = [f"_by{k}" for k in range(len(order))]
    n = F.greatest(F.ceil(F.col("size") / largest), F.lit(1))
    pieces = rows.select("id", "size", "_read", *by, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * largest
    pieces = pieces.select("id", "piece", "_read", *by, start.alias("start"), F.least(F.lit(largest), F.col("size") - start).alias("length"))
    if by:
        slots = _before(rows.groupBy("_by0").agg(F.sum(n).alias("own")))
        within = F.row_number().over(Window.partitionBy("_by0").orderBy(*by[1:], "id", "_read", "piece"))
        pieces = pieces.withColumn("_within", within).join(slots, F.col("_by0") == F.col("_slot"))
        place = (F.col("_before") + F.col("_within") - 1).cast("long")
        pieces = pieces.select("id", "piece", "start", "length", place.alias("place"), F.floor(place / SHARD).alias("shard"))
    else:
        totals = rows.agg(F.sum(n)).first()
        shards = max(1, int(totals[0] or 0) // SHARD)
        pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "_read", F.lit(31)), F.lit(shards)))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id", "piece"], ascending=[False, True, True]).reset_index(drop=True)
        where, found = pack_shard(part["length"].tolist(), lengths, cost)
        number = pd.Series(where, dtype="int64")
        part["bin_length"] = pd.Series([found[k] for k in where], dtype="int64")
        if by:
            number = part["place"].groupby(number).transform("min").rank(method="dense").astype("int64") - 1
        part["bin"] = part["shard"] * (1 << 24) + number
        part["bin_start"] = part.groupby("bin")["length"].cumsum() - part["length"]
        return part[["id", "piece", "start", "length", "bin", "bin_length", "bin_start"]]

    kind = rows.schema["id"].dataType.simpleString()
    out = pieces.groupBy("shard").applyInPandas(packed, f"id {kind}, piece int, start long, length long, bin long, bin_length long, bin_start long")
    return out.withColumnRenamed("id", id_col)
