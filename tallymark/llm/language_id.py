"""Language identification by prediction by partial matching.

One byte-context tree per language, of contexts of up to ORDER bytes, with
escape probabilities by method C and exclusion. Statistics are frozen after
fitting. A text's language is the one whose tree codes it in the fewest bits:
each byte is looked for after the longest context in the tree, and for each
context that hasn't seen it an escape is paid, down to equal shares of the bytes
that no context has seen. Code lengths are exact: all 256 bytes are symbols of
their own, and nothing is rounded or merged.

As a context's bytes are all among those of its own end, what is excluded after
an escape depends on the longer context alone, so every context keeps the code
length of an escape out of the next shorter one, and its total there.

Defined cases: texts that are null or have no letter are `und`, score 0; so is
everything if nothing could be learned. Ties go to the first language by name.
Every byte of a text counts; before it stand ORDER spaces. Rows without an id
are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_fraction

#: Bytes of context.
ORDER = 4
#: Bytes looked up at once, so that a very long text needs no more memory.
CHUNK = 1 << 20
SPACE, UNKNOWN = 32, "und"


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text starts and the last ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def grams(data: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For the bytes lo to hi: the ORDER bytes before and the byte itself, as
    one number; before a text's start there are spaces."""
    out = data[lo:hi].astype(np.uint64)
    place = np.arange(lo, hi) - at[np.searchsorted(at, np.arange(lo, hi), side="right") - 1]
    for back in range(1, ORDER + 1):
        before = np.full(hi - lo, SPACE, np.uint64)
        inside = np.flatnonzero(place >= back)
        before[inside] = data[lo + inside - back]
        out |= before << np.uint64(8 * back)
    return out


def _end(gram: np.ndarray, size: int) -> np.ndarray:
    return gram & np.uint64((1 << 8 * size) - 1)


def count_grams(rows: DataFrame) -> DataFrame:
    """rows: lang, body. Returns lang, gram, n."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _buffer(batch.column(1))
            langs, which = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            for lo in range(int(at[0]), int(at[-1]), CHUNK):
                hi = min(lo + CHUNK, int(at[-1]))
                text = np.searchsorted(at, np.arange(lo, hi), side="right") - 1
                found, n = np.unique(which[text].astype(np.uint64) << np.uint64(8 * ORDER + 8) | grams(data, at, lo, hi), return_counts=True)
                lang = langs[(found >> np.uint64(8 * ORDER + 8)).astype(np.int64)]
                yield pa.record_batch([pa.array(lang, pa.string()), pa.array(_end(found, ORDER + 1).astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    out = rows.mapInArrow(counted, "lang string, gram bigint, n bigint")
    return out.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """One language's contexts. counts: for each order from 0, the grams (the
    context and the byte after it) as sorted numbers, and how often they occur."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.gram, self.bits, self.context, self.own, self.escape, self.next, self.next_escape = [], [], [], [], [], [], []
        shorter: tuple[np.ndarray, ...] = ()
        with np.errstate(divide="ignore", invalid="ignore"):
            for order, (gram, n) in enumerate(counts):
                if order:  # a gram whose end was left out goes too, so that longer contexts only have bytes that shorter ones have
                    known = np.isin(_end(gram, order), counts[order - 1][0])
                    gram, n = counts[order] = gram[known], n[known]
                context, which = np.unique(gram >> np.uint64(8), return_inverse=True)
                total, kinds = np.bincount(which, n, len(context)), np.bincount(which, minlength=len(context))
                left = np.where(kinds < 256, kinds, 0)
                self.gram.append(gram)
                self.bits.append(np.log2(n))
                self.context.append(context)
                self.own.append(np.log2(total + left))
                self.escape.append(np.log2((total + left) / left))
                if order:
                    # one order down, without the bytes seen here
                    _, below_n, below_context, below_total, below_kinds = shorter
                    at = np.searchsorted(below_context, _end(context, order - 1))
                    seen = np.bincount(which, below_n[np.searchsorted(shorter[0], _end(gram, order))], len(context))
                    rest, new = below_total[at] - seen, below_kinds[at] - kinds
                    self.next.append(np.log2(rest + new))
                    # with no byte left there, going on is certain and costs nothing
                    self.next_escape.append(np.where(new > 0, np.log2((rest + new) / np.maximum(new, 1)), 0.0))
                shorter = (gram, n, context, total, kinds)
        self.unseen = float(np.log2(max(1, 256 - len(counts[0][0]))))

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte after the others."""
        paid, total = np.zeros(len(gram)), np.zeros(len(gram))
        escape, open_, done = np.zeros(len(gram)), np.zeros(len(gram), bool), np.zeros(len(gram), bool)
        found = np.zeros(len(gram))
        for order in range(len(self.gram) - 1, -1, -1):
            context = _end(gram >> np.uint64(8), order)
            at = np.minimum(np.searchsorted(self.context[order], context), max(len(self.context[order]) - 1, 0))
            has = self.context[order][at] == context if len(self.context[order]) else np.zeros(len(gram), bool)
            first = has & ~open_
            total[first], escape[first] = self.own[order][at[first]], self.escape[order][at[first]]
            open_ |= has
            key = _end(gram, order + 1)
            own = np.minimum(np.searchsorted(self.gram[order], key), max(len(self.gram[order]) - 1, 0))
            hit = open_ & ~done & (self.gram[order][own] == key) if len(self.gram[order]) else np.zeros(len(gram), bool)
            found[hit] = paid[hit] + total[hit] - self.bits[order][own[hit]]
            done |= hit
            missed = open_ & ~done
            paid[missed] += escape[missed]
            if order:  # what the next order's total and escape are, seen from this context
                total[has], escape[has] = self.next[order - 1][at[has]], self.next_escape[order - 1][at[has]]
        return np.where(done, found, paid + self.unseen)


class Model:
    """langs and one tree for each. Code lengths of grams that were looked up
    are remembered in a table of fixed size, in which later grams replace
    earlier ones of the same place."""

    def __init__(self, langs: list[str], trees: list[Tree]):
        self.langs, self.trees = langs, trees
        self.size = max(12, 23 - max(1, len(langs)).bit_length())
        self.keys: np.ndarray | None = None

    @staticmethod
    def fitted(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        """found: for each order from 0: lang, gram and n of each gram."""
        langs = sorted(set(found[0][0].tolist()))
        trees = []
        for lang in langs:
            counts = []
            for names, gram, n in found:
                own = np.flatnonzero(names == lang)
                own = own[np.argsort(gram[own], kind="stable")]
                counts.append((gram[own].astype(np.uint64), n[own].astype(float)))
            trees.append(Tree(counts))
        return Model(langs, trees)

    def lookup(self, gram: np.ndarray) -> np.ndarray:
        """Bits of each gram's last byte under each language."""
        if self.keys is None:
            self.keys, self.known = np.full(1 << self.size, (1 << 64) - 1, np.uint64), np.zeros((1 << self.size, len(self.langs)))
        place = (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.size)).astype(np.int64)
        out = self.known[place]
        missed = np.flatnonzero(self.keys[place] != gram)
        if len(missed):
            new, which = np.unique(gram[missed], return_inverse=True)
            bits = np.stack([tree.lengths(new) for tree in self.trees], axis=1)
            out[missed] = bits[which]
            at = np.zeros(len(new), np.int64)
            at[which] = place[missed]
            self.keys[at], self.known[at] = new, bits
        return out

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        total = np.zeros((len(at) - 1, len(self.langs)))
        for lo in range(int(at[0]), int(at[-1]), CHUNK):
            hi = min(lo + CHUNK, int(at[-1]))
            bits = self.lookup(grams(data, at, lo, hi))
            first, last = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi, side="left")
            texts = np.arange(first, last)
            texts = texts[(at[texts + 1] > lo) & (at[texts + 1] > at[texts])]
            total[texts] += np.add.reduceat(bits, np.maximum(at[texts], lo) - lo, axis=0)
        return total

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's language and that language's share of the probability."""
        bits = self.lengths(data, at)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return np.array(self.langs, object)[bits.argmin(axis=1)], share


def fit(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 2000, max_grams: int = 100_000) -> Model | None:
    """Learns from about max_docs_per_lang whole texts of each language, picked
    by a hash of their ids among the rows where learn_from holds. A tree keeps
    the max_grams most frequent contexts and bytes of each order, so what
    reaches the driver is bounded for each language."""
    rows = docs.filter(learn_from).select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), F.col(lang_col).alias("lang")).filter("lang is not null and body is not null")
    sizes = docs.filter(learn_from).groupBy(F.col(lang_col).alias("lang")).count().filter("lang is not null").collect()
    if not sizes:
        return None
    shares = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], int(1e6 * keep_fraction(r["count"], max_docs_per_lang)))))
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) < shares[F.col("lang")])
    longest = count_grams(picked.select("lang", "body"))
    order = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    # every order's counts in one pass over the longest's
    each = longest.select("lang", "n", "gram", order.alias("order"))
    each = each.withColumn("gram", F.expr("gram & (shiftleft(1L, 8 * (order + 1)) - 1)")).groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "order").orderBy(F.desc("n"), "gram"))
    found = each.withColumn("rank", rank).filter(F.col("rank") <= max_grams).select("lang", "order", "gram", "n").toArrow()
    lang, at, gram, n = (found.column(c).to_numpy() for c in ("lang", "order", "gram", "n"))
    return Model.fitted([(lang[at == k], gram[at == k], n[at == k]) for k in range(ORDER + 1)]) if len(n) else None


def worded(text: Column) -> Column:
    """Whether a text has a letter; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """row (a struct of docs' columns), lang_pred, score for every row. score is
    the share of the predicted language in the probabilities that all languages
    give the text. Only the text goes to Python. No shuffle."""
    rows = docs.select(F.struct("*").alias("row"), worded(F.col(text_col)).alias("worded"), F.col(text_col).alias("body"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.trees))

    @F.arrow_udf("lang string, score double")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for column in columns:
            lang, score = own.predict(*_buffer(column))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang", "score"])

    out = rows.withColumn("found", predicted("body"))
    return out.select("row", F.when(F.col("worded"), F.col("found.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("worded"), F.col("found.score")).otherwise(0.0).alias("score"))
