"""Ranked lexical search, term at a time with a limited set of accumulators.

Items (queries) are taken in blocks. One pass over the documents counts, for a
block, the items' terms in every whole text and writes them beside the text's
number of terms; corpus statistics come from that table. The documents are then
searched in shards of `shard_docs`: within one, an item's terms go from the
rarest to the most frequent, each adding its share to the accumulators of the
documents that hold it. Once what the remaining terms can add at most stays
below the k-th best partial score, no accumulator is created any more, as a new
document could not get among the best k; those that exist are updated to their
exact scores. A shard gives its best k of each item, and the best k of all
shards are the result: a row_number() filter, which Spark applies before its
shuffle too.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. Scores are whole numbers, see the README.

Defined cases: null, empty and wordless texts have no term, count in no
statistic and are never found; a null item matches nothing; rows that share an
item id are one item with the terms of all; rows that share a document id are
documents of their own; null ids take part, last among equal scores. Equal
scores go by document id; equal ids too are told apart by nothing, so their rows
are equal.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import written

#: Item terms of a block, about; an item's terms stay together.
BLOCK_TERMS = 1 << 17

#: ASCII separators become spaces, A-Z small letters.
_FOLD = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item, term (binary): each term of an item once."""
    kind = items.schema[item_col].dataType

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(dict.fromkeys(terms_of(x.as_py()))) for x in batch.column(1)]
            at = np.repeat(np.arange(len(own)), [len(t) for t in own])
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array([t for x in own for t in x], pa.binary())], names=["item", "term"])

    return items.select(item_col, text_col).mapInArrow(made, f"item {kind.simpleString()}, term binary").distinct()


def counted(docs: DataFrame, id_col: str, text_col: str, numbers: dict[bytes, int]) -> DataFrame:
    """doc, n (all terms), terms (the numbers of those asked for) and tf, for
    every document with a term; no shuffle."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    lists = ArrayType(IntegerType())
    schema = StructType([rows.schema["doc"], StructField("n", LongType()), StructField("terms", lists), StructField("tf", lists)])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, terms, tf, ends = [], [], [], [], [0]
            for k, text in enumerate(batch.column(1)):
                own = terms_of(text.as_py())
                if not own:
                    continue
                kept.append(k)
                n.append(len(own))
                for term, times in Counter(own).items():
                    if (number := numbers.get(term)) is not None:
                        terms.append(number)
                        tf.append(times)
                ends.append(len(terms))
            of = pa.array(ends, pa.int32())
            yield pa.record_batch(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(of, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(of, pa.array(tf, pa.int32()))],
                names=schema.names,
            )

    return rows.mapInArrow(made, schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Inverted lists of some documents and the terms' shares in them."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        whole = n if 50 * int(n.max()) * n_docs < 1 << 63 else n.astype(object)
        m = (50 + (50 * whole * n_docs) // n_terms).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), counts)
        by = np.argsort(terms, kind="stable")
        terms, self.doc, tf = terms[by], doc[by], tf[by].astype(np.int64)
        self.share = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[self.doc]))
        self.ends = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        there = np.flatnonzero(np.diff(self.ends))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.share, self.ends[there])
        self.score = np.zeros(len(n), np.int64)

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of those that may be among the best k, ties
        included. terms: an item's, the rarest first."""
        score = self.score
        terms = terms[self.most[terms] > 0]
        left = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0)
        held, parts, creating, top = 0, [], True, 0
        for at, term in enumerate(terms):
            own = slice(self.ends[term], self.ends[term + 1])
            doc, share = self.doc[own], self.share[own]
            if not creating:
                has = score[doc] > 0
                score[doc[has]] += share[has]
                continue
            fresh = doc[(score[doc] == 0) & (share > 0)]
            parts.append(fresh)
            held += len(fresh)
            score[doc] += share
            top = max(top, int(score[doc].max()))
            if held >= k and left[at + 1] < top:
                own = np.concatenate(parts)
                creating = left[at + 1] >= np.partition(score[own], held - k)[held - k]
        found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        scores = score[found]
        score[found] = 0
        if held > k:
            keep = scores >= np.partition(scores, held - k)[held - k]
            found, scores = found[keep], scores[keep]
        return found, scores


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            held.append(part)
            n, batch = n + part.num_rows, batch.slice(part.num_rows)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _block(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, shard_docs: int) -> DataFrame:
    """The best k of each shard for a block of items: item, doc, score."""
    # a block holds BLOCK_TERMS terms or one item's
    items: dict[object, list[bytes]] = {}
    for item, term in asked.collect():
        items.setdefault(item, []).append(bytes(term))
    numbers: dict[bytes, int] = {}
    for terms in items.values():
        for term in terms:
            numbers.setdefault(term, len(numbers))
    table = written(counted(docs, id_col, text_col, numbers), "search-terms")
    n_docs, n_terms = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(numbers), np.int64)
    for number, found in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        df[number] = found
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    rarest = [np.array(sorted((numbers[t] for t in terms), key=lambda t: (df[t], t)), np.int64) for terms in items.values()]
    ids = pa.array(list(items), pa.from_numpy_dtype(np.int64)) if asked.schema["item"].dataType == LongType() else pa.array(list(items))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches, shard_docs):
            terms, tf = batch.column(2), batch.column(3)
            counts = np.asarray(terms.value_lengths())
            shard = Shard(batch.column(1).to_numpy(), counts, terms.flatten().to_numpy(), tf.flatten().to_numpy(), weights, n_docs, n_terms)
            for at, own in enumerate(rarest):
                found, scores = shard.best(own, k)
                if len(found):
                    item = ids.take(pa.array(np.full(len(found), at)))
                    yield pa.record_batch([item, batch.column(0).take(pa.array(found)), pa.array(scores)], names=["item", "doc", "score"])

    schema = StructType([asked.schema["item"], StructField("doc", table.schema["doc"].dataType), StructField("score", LongType())])
    return table.mapInArrow(made, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_docs: int = 1 << 15, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, rank (from 1), doc, score: each item's k best documents with a
    score above 0, equal scores by id. Every document is looked at for every
    block of items, and no text of an item or document is cut."""
    asked = written(item_terms(items, item_col, item_text_col), "search-items")
    blocks = max(1, math.ceil(asked.count() / block_terms))
    own = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        part = written(_block(docs, own.filter(F.col("block") == number).select("item", "term"), k, id_col, text_col, shard_docs), "search-found")
        found = part if found is None else found.union(part)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")
