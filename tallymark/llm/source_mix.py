"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in an order drawn by hash, are cut into blocks of equal
size. A source of weight w (of all weights' sum) gets its j-th block released
at slot floor(j / w) and due by ceil((j + 1) / w), as exact fractions of the
weights given; one block runs per slot, the released one with the earliest
deadline first. As weights add up to one, every block runs within its window,
so at any slot no source is a whole block away from its target.

Once a source is used up its slots stay empty and the others go on in
proportion. When those used up held more than half of the weight, the others'
windows are counted anew from there, so empty slots stay fewer than half. All
rows are kept, once each.

Only the blocks' schedule is worked out in order, by one task that holds a few
numbers per source and writes as it goes: a row for each block, so one for each
million characters. Rows get their blocks by windows over bounded buckets.

Defined cases: rows without a source are a source of their own; a null, zero or
negative size counts as 1; a row longer than a block fills the blocks it
reaches into; ties in the drawn order go by id, then by size, then as read; an
id with very many rows is spread. Sources without a positive weight come after
all others, at equal shares. An empty table stays empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows that share a bucket of the drawn order, about; a bucket of 16 times as many is split.
BUCKET = 1024
#: Blocks of the schedule written at once.
CHUNK = 1 << 15


def _phase(at: int, left: dict[str, list[int]], weights: Mapping[str, Fraction]) -> Iterator[tuple[str, int, int, int, int]]:
    """Earliest deadline first from slot `at` on. left: source -> next block and
    number of blocks; advanced as blocks run. Ends when all are used up or those
    left have less than half of the weight."""
    scale = math.lcm(*(w.denominator for w in weights.values()))
    share = {s: int(w * scale) for s, w in weights.items()}
    whole = active = sum(share.values())
    base = {s: left[s][0] for s in weights}
    waiting = [(0, -(-whole // a), s, 0) for s, a in sorted(share.items())]  # release, deadline, source, j
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while active:
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        a = share[s]
        heapq.heappush(waiting, ((j + 1) * whole // a, -(-(j + 2) * whole // a), s, j + 1))
        block, blocks = base[s] + j, left[s][1]
        if block < blocks:
            left[s][0] = block + 1
            yield s, block, at + release, at + deadline, at + slot
            if block + 1 == blocks:
                active -= a
                if 2 * active < whole:
                    return
        slot += 1


def schedule(sources: Iterable[tuple[str, float, int]]) -> Iterator[tuple[str, int, int, int, int]]:
    """sources: name, weight, number of blocks. Yields source, block, release,
    deadline and slot of each block, by slot."""
    found = sorted(sources)
    left = {s: [0, n] for s, _, n in found if n > 0}
    given = {s: Fraction(w) if w is not None and math.isfinite(w) and w > 0 else Fraction(0) for s, w, _ in found}
    at = 0
    while left:
        weights = {s: given[s] for s in left if given[s]} or {s: Fraction(1) for s in left}
        for block in _phase(at, left, weights):
            at = max(at, block[4] + 1)
            yield block
        left = {s: x for s, x in left.items() if x[0] < x[1]}


def scheduled(totals: DataFrame) -> DataFrame:
    """totals: source, weight, blocks. Returns source, block, release, deadline, slot."""

    def made(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for part in parts for r in part.itertuples(index=False, name=None)]
        chunk: list[tuple] = []
        names = ["source", "block", "release", "deadline", "slot"]
        for block in schedule(rows):
            chunk.append(block)
            if len(chunk) == CHUNK:
                yield pd.DataFrame(chunk, columns=names)
                chunk = []
        if chunk:
            yield pd.DataFrame(chunk, columns=names)

    return totals.select("source", "weight", "blocks").repartition(1).mapInPandas(made, "source string, block long, release long, deadline long, slot long")


def mix(rows: DataFrame, size: Column, weights: Mapping[str | None, float] | None = None, temper: float = 0.7, id_col: str = "doc_id", source_col: str = "source", block_size: int = 1 << 20, seed: int = 17) -> DataFrame:
    """Adds to each row, as a struct `row` of its own columns: block (number
    within its source), release, deadline, slot, and turn (its place in the
    block). Ordered by slot and turn, rows stand in the mixed order.

    weights: target share of each source, in any unit; without it, the sources'
    total sizes to the power of temper. The rows should come from a table: which
    of an id's many rows is which is told by the order in which they are read.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    drawn = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11) / F.lit(float(1 << 53))
    own = rows.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), source.alias("source"), F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long").alias("size"), drawn.alias("drawn"), F.monotonically_increasing_id().alias("read"))
    n = rows.count()
    own = own.withColumn("bucket", F.floor(F.col("drawn") * max(1, n // BUCKET)).cast("long"))

    # buckets that one id fills; Spark broadcasts the written table only while it is small
    full = own.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 16 * BUCKET)
    full = written(full.select("source", "bucket", F.ceil(F.col("n") / BUCKET).alias("parts")), "mix-full")
    own = own.join(full, ["source", "bucket"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("read"), F.col("parts"))))
    sums = written(own.groupBy("source", "bucket", "part").agg(F.sum("size").alias("all")), "mix-sums")

    totals = sums.groupBy("source").agg(F.sum("all").alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(temper))
    else:
        known = [("-" if s is None else f"={s}", float(w)) for s, w in weights.items()]
        given = rows.sparkSession.createDataFrame(known, "source string, weight double")
        totals, weight = totals.join(given, "source", "left"), F.col("weight")
    plan = written(scheduled(totals.select("source", weight.alias("weight"), F.ceil(F.col("size") / block_size).alias("blocks"))), "mix-plan")

    # where each bucket starts within its source, by blocks of buckets so that no source's sums meet in one task; then each row within its bucket
    starts = _starts(sums)
    upto = F.sum("size").over(Window.partitionBy("source", "bucket", "part").orderBy("drawn", "id", "size", "read").rowsBetween(Window.unboundedPreceding, 0))
    placed = own.withColumn("upto", upto).join(starts, ["source", "bucket", "part"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size"))
    placed = placed.withColumn("block", F.floor(F.col("start") / block_size))
    timed = placed.join(plan, ["source", "block"])
    return timed.select("row", "block", "release", "deadline", "slot", (F.col("start") - F.col("block") * block_size).alias("turn"))


def _starts(sums: DataFrame, group: int = 1024) -> DataFrame:
    """source, bucket, part, before: the sizes of all that stand before it in
    its source. Sums of groups of buckets first, then within each group."""
    own = sums.withColumn("group", F.floor(F.col("bucket") / group))
    groups = own.groupBy("source", "group").agg(F.sum("all").alias("of_group"))
    earlier = Window.partitionBy("source").orderBy("group")
    groups = groups.select("source", "group", (F.sum("of_group").over(earlier) - F.col("of_group")).alias("g0"))
    within = Window.partitionBy("source", "group").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("b0", F.sum("all").over(within) - F.col("all")).join(groups, ["source", "group"]).select("source", "bucket", "part", (F.col("g0") + F.col("b0")).alias("before"))


def file_order(rows: DataFrame) -> DataFrame | None:
    """rows, read from files that in_order() was written to, with slot and turn,
    numbers in the order of the files and of the rows in each; a slot has 1024
    rows. None if rows don't come from files as they are."""
    try:
        placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("turn"))
    except AnalysisException:
        return None
    number = lambda pattern: F.coalesce(F.regexp_extract("_file", pattern, 1).try_cast("bigint"), F.lit(0))
    slot = F.shiftleft(number(r"^part-(\d+)"), 40) + F.shiftleft(number(r"[-.]c(\d+)\."), 28) + F.shiftright("turn", 10)
    return placed.withColumn("slot", slot).drop("_file")


def in_order(rows: DataFrame, size: Column, **options) -> DataFrame:
    """The rows with their own columns, range-partitioned and sorted into the
    mixed order, so that files written from them hold it."""
    mixed = mix(rows, size, **options)
    return mixed.repartitionByRange("slot", "turn").sortWithinPartitions("slot", "turn").select("row.*")
