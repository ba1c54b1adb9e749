"""Line dedup over levelled sorted runs of line hashes.

A run holds (key hash, number of documents, largest doc_id), bucketed by hash
and sorted within its buckets. Each batch of documents adds one run on level 0;
when a level holds `fanout` runs they are merged, bucket by bucket and without a
shuffle, into one run of the next level, so a store of n batches keeps O(log n)
runs a level. Batches are cleaned by an anti-join of their lines with the keys
that the merged runs show to be repeated: what it leaves are the lines that
stay. As a line's fate depends on all documents (how many hold it, and which is
the last), all runs are there before the first batch is cleaned.

DataFrame functions only. Keys are compared by their 128-bit hashes, and rows
by 128-bit hashes of id and text; rows equal in both fare alike anyhow.

Defined cases: null or empty text is one empty line; a document's repeats of a
key count once; each row is one document, so rows that repeat a doc_id count
separately and all of them keep the line if theirs is the largest doc_id; a
null doc_id counts as a document, and is never the largest unless all are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, drop_path, new_path, new_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; lower() does the same, faster, for ASCII texts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(ASCII_SPACE))


def is_long(line: Column, min_length: int) -> Column:
    return F.char_length(line_key(line)) >= min_length


def long_lines(rows: DataFrame, min_length: int) -> DataFrame:
    """rows: id, body and others. One row for each line with a long key: the
    other columns, h (128-bit hash), i (its place), first (the document's first
    of this key by place)."""
    lines = F.split(ascii_lower(F.col("body")), "\n", -1)
    found = F.transform(lines, lambda x, i: F.struct(F.when(is_long(x, min_length), F.unhex(F.md5(line_key(x)))).alias("h"), i.alias("i")))
    out = rows.select(*(c for c in rows.columns if c != "body"), F.array_sort(F.filter(found, lambda x: x["h"].isNotNull())).alias("found"))
    first = lambda x, k: (k == 0) | (F.get("found", k - 1)["h"] != x["h"])
    marked = F.transform("found", lambda x, k: F.struct(x["h"].alias("h"), x["i"].alias("i"), first(x, k).alias("first")))
    return out.select(*(c for c in out.columns if c != "found"), F.inline(marked))


class LineRuns:
    """The levelled store: one bucketed table for each level, whose runs are
    appended. As many buckets as shuffles have partitions, so a run's
    aggregation already deals it out as its table wants it."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[str, int]] = []  # table and its number of runs
        self.places: dict[str, str] = {}  # the tables' folders, which all executors share

    def _append(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append(("", 0))
        name, runs = self.levels[level]
        name = name or new_table(f"line_runs_{level}")
        place = self.places.setdefault(name, new_path(self.spark, name))
        run.write.mode("append").option("path", place).bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        self.levels[level] = (name, runs + 1)

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("h").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))

    def _compact(self, level: int, to: int) -> None:
        name, _ = self.levels[level]
        self._append(self._merged(self.spark.table(name)), to)
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, self.places.pop(name))
        self.levels[level] = ("", 0)

    def add(self, batch: DataFrame) -> None:
        """Adds a batch's lines: id, h, first."""
        self._append(batch.groupBy("h").agg(F.count_if("first").alias("n_docs"), F.max("id").alias("last_id")), 0)
        level = 0
        while self.levels[level][1] >= self.fanout:
            self._compact(level, level + 1)
            level += 1

    def keys(self) -> DataFrame:
        """All keys so far with their totals: h, n_docs, last_id. The levels
        are merged upwards, the smallest first; no shuffle."""
        used = [k for k, (_, runs) in enumerate(self.levels) if runs]
        for level, to in zip(used[:-1], used[1:], strict=True):
            self._compact(level, to)
        return self._merged(self.spark.table(self.levels[used[-1]][0]))

    def repeated(self, min_docs: int) -> DataFrame:
        return self.keys().filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 40, min_docs: int = 5, batches: int = 5, fanout: int = 2) -> DataFrame:
    """Drop repeated lines: row (a struct of the columns but the text), kept
    (the text), n_lines, n_dropped, one row per input row. Lines whose key has min_length code points or more and occurs in
    min_docs documents or more stay only in the largest id that holds it.

    The documents are added to the runs in `batches` parts by id. Only hashes
    are shuffled to tell which lines stay; then each document gets their places.
    """
    spark = docs.sparkSession
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col))
    rows = docs.select(others.alias("own"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("r1", F.xxhash64("id", "body")).withColumn("r2", F.xxhash64("body", "id", F.lit(1)))
    part = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(batches)).cast("int")
    path = new_path(spark, "line-hashes")
    long_lines(rows.select("id", "body", "r1", "r2", part.alias("part")), min_length).write.partitionBy("part").parquet(path)
    seen = spark.read.schema(f"id {rows.schema['id'].dataType.simpleString()}, r1 bigint, r2 bigint, h binary, i int, first boolean, part int").parquet(path)

    runs = LineRuns(spark, fanout)
    for k in range(batches):
        runs.add(seen.filter(F.col("part") == k))
    repeated = written(runs.repeated(min_docs).select(F.col("h").alias("key"), "last_id"), "line-repeated")
    goes = (F.col("h") == F.col("key")) & ~F.col("id").eqNullSafe(F.col("last_id"))
    stays = seen.join(repeated, goes, "left_anti").groupBy("r1", "r2").agg(F.collect_set("i").alias("stays"))

    both = rows.join(stays, ["r1", "r2"], "left")
    # set operations, so that a long text's places are never looked up one by one
    lines = F.split(F.col("body"), "\n", -1)
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    long = F.filter(at, lambda i: is_long(F.get("lines", i), min_length))
    lost = F.array_except(long, F.coalesce("stays", F.array().cast("array<int>")))
    out = both.select("own", lines.alias("lines"), "stays").withColumn("kept", F.array_except(at, lost))
    return out.select(
        F.col("own").alias("row"),
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )
