"""Hierarchical Pitman-Yor language model over words, and every text's score.

A restaurant for each context (the word before) shares one parent, the restaurant
of single words, whose base is uniform over the words seen in training and one
place for all others. The customers of a context's restaurant are the training
tokens after it; each table there is a customer of the parent. Seats are sampled:
first every customer is seated by the Chinese-restaurant rule (the waiting time
to a dish's next table is drawn at once, from its beta-geometric law, so a dish
costs its tables, not its customers), then Gibbs rounds take a random customer of
every dish away and seat it again. The predictive probabilities of `samples`
states, taken `thin` rounds apart, are averaged.

How it is spread out. Tokens are counted in parts: a part holds whole contexts,
but the words after a hot context (more than one in HOT of all tokens; there are
HOT of these at most) are dealt to all parts. A part's task samples the seats of
its restaurants, with the parent's probabilities of its words as they were when
it began; tables a word go to the word's own part, where the parent's seats are
sampled, and the probabilities come back. What moves is blobs of numbers: a row
for each chunk of texts and part, or part and range of words. A part's own
numbers are bucketed by part, so they aren't moved again. Random numbers come
from the part's number: a task that is run again gives the same seats, and so
does the last pass, which seats once more to know each sampled state's tables.

Defined cases: null and empty texts are one end token; ids and other columns
aren't looked at; without any training token every probability is 1; words are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import new_path, new_table, written

#: No word: stands for the end of a text, and for what is before its first word.
END = xxhash.xxh64_intdigest(b" ", 0)
#: A word is hot if it makes up more than one in HOT of all tokens.
HOT = 4096
#: Tokens and texts of a chunk, about; a text isn't cut.
CHUNK_TOKENS, CHUNK_TEXTS = 3 << 19, 1 << 15

_I, _L, _B, _D = IntegerType(), LongType(), BinaryType(), DoubleType()


def _fields(**kinds: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


CELL = _fields(part=_I, chunk=_L, ctx=_B, ctx_n=_B, vocab=_B, word=_B, doc=_B)
PART = _fields(
    part=_I, chunks=ArrayType(_L), ctx=_B, dishes=_B, vocab=_B, word=_B, c=_B, held=_B, dish=_B, doc=_B, contexts=_L, ones=_L, twos=_L,
    hot=ArrayType(_fields(ctx=_L, c=_L, t=_L)),
)
SENT = _fields(range=_I, part=_I, words=_B, tables=_B, hot=ArrayType(_fields(ctx=_L, sample=_I, t=_L)))
BACK = _fields(part=_I, range=_I, round=_I, held=_B, customers=ArrayType(_L), tables=ArrayType(_L), ones=_L, twos=_L)
SUMS = _fields(chunk=_L, part=_I, doc=_B, known=_B, base=_B, score=_B)


def pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


class Chunks:
    """Texts of a task in chunks: their tokens as numbers, 0 for the end."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.next = batches, TaskContext.get().partitionId() << 32

    def __iter__(self) -> Iterator[tuple[int, dict[bytes, int], np.ndarray, pa.Array, pa.Array, list[int]]]:
        numbers, tokens, rows, learn, n = {b" ": 0}, array("I"), [], [], []
        for batch in self.batches:
            begun = 0
            for k, text in enumerate(batch.column(2)):
                own = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                tokens.extend([numbers.setdefault(w, len(numbers)) for w in own])
                tokens.append(0)
                n.append(len(own) + 1)
                if len(tokens) >= CHUNK_TOKENS or len(n) >= CHUNK_TEXTS:
                    rows.append(batch.column(0).slice(begun, k + 1 - begun))
                    learn.append(batch.column(1).slice(begun, k + 1 - begun))
                    begun = k + 1
                    yield self.next, numbers, np.frombuffer(tokens, np.uint32), pa.concat_arrays(rows), pa.concat_arrays(learn), n
                    self.next += 1
                    numbers, tokens, rows, learn, n = {b" ": 0}, array("I"), [], [], []
            rows.append(batch.column(0).slice(begun))
            learn.append(batch.column(1).slice(begun))
        if n:
            yield self.next, numbers, np.frombuffer(tokens, np.uint32), pa.concat_arrays(rows), pa.concat_arrays(learn), n


def hashes(numbers: dict[bytes, int]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, 0) for w in numbers), np.uint64, len(numbers))


def frequent_words(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of tokens, and the sorted hashes of all words that make up more
    than two in HOT of them, HOT words at most. A chunk tells those that make
    up one in HOT of its own tokens; what chunks don't tell of a word is less
    than one in HOT of all."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, numbers, tokens, *_ in Chunks(batches):
            times = np.bincount(tokens)
            own = np.flatnonzero(times * HOT >= len(tokens))
            h = hashes(numbers)[own].view(np.int64)
            yield pa.record_batch([pa.array(np.append(h, 0)), pa.array(np.append(times[own], len(tokens))), pa.array([False] * len(own) + [True])], names=["word", "n", "total"])

    told = written(rows.mapInArrow(made, "word BIGINT, n BIGINT, total BOOLEAN").groupBy("word", "total").agg(F.sum("n").alias("n")), "lm-frequent")
    n = told.filter("total").agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in told.filter(~F.col("total") & (F.col("n") * HOT >= n)).select("word").collect()]  # HOT rows at most
    return n, np.sort(np.array(hot, np.int64).view(np.uint64))


def place(ctx: np.ndarray, parts: int) -> np.ndarray:
    """The part of each context's hash; of a hot context, of the hash mixed with the word's."""
    return ((ctx >> np.uint64(17)) % np.uint64(parts)).astype(np.int32)


class Pairs:
    """A chunk's pairs of tokens, sorted by context, word and text: h has the
    words' hashes in order, and a pair is one number of their places and the
    text's, or three where these are too long for one."""

    ROOM = 62

    def __init__(self, numbers: dict[bytes, int], tokens: np.ndarray, texts: np.ndarray):
        """texts: of each token, twice the text's number, and one more for training."""
        h = hashes(numbers)
        order = np.argsort(h)
        self.h, rank = h[order], np.empty(len(h), np.uint32)
        rank[order] = np.arange(len(h), dtype=np.uint32)
        word = rank[tokens]
        bits = self.bits = len(h).bit_length()
        self.key, self.three = None, None
        if 2 * bits + 16 <= self.ROOM:
            key = np.empty(len(word), np.int64)
            key[0], key[1:] = rank[0], word[:-1]
            for x, room in ((word, bits), (texts, 16)):
                key <<= room
                key |= x
            key.sort()
            self.key = key
        else:
            ctx = np.concatenate((rank[:1], word[:-1]))
            order = np.lexsort((texts, word, ctx))
            self.three = ctx[order], word[order], texts[order]

    def at(self, where: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the context and the word, and the text, of these pairs."""
        if self.key is None:
            return tuple(x[where] for x in self.three)
        key = self.key[where]
        return key >> (self.bits + 16), (key >> 16) & ((1 << self.bits) - 1), (key & 0xFFFF).astype(np.uint16)

    def parts(self, hot: np.ndarray, parts: int) -> np.ndarray:
        ctx = self.at(slice(None))[0] if self.key is None else self.key >> (self.bits + 16)
        out = place(self.h, parts)[ctx]
        of_hot = np.flatnonzero(np.isin(self.h, hot)[ctx])
        c, w, _ = self.at(of_hot)
        out[of_hot] = place(self.h[c] ^ (self.h[w] * np.uint64(0x9E3779B97F4A7C15)), parts)
        return out


def cells(rows: DataFrame, hot: np.ndarray, parts: int) -> DataFrame:
    """A row for each chunk and part: the chunk's pairs of tokens that belong
    there, by context and word, with their texts (twice the text's number in the
    chunk, and one more if it is for training). And a row for each chunk, with
    the negative part -1 - chunk's place: the texts' rows and numbers of tokens."""
    listed = StructType([StructField("rows", ArrayType(rows.schema["row"].dataType)), StructField("n", ArrayType(LongType()))])
    schema = StructType([*CELL.fields, *listed.fields])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, numbers, tokens, own, learn, n in Chunks(batches):
            texts = 2 * np.repeat(np.arange(len(n), dtype=np.uint16), n) + np.repeat(learn.to_numpy(zero_copy_only=False).astype(np.uint16), n)
            pairs = Pairs(numbers, tokens, texts)
            h, part = pairs.h, pairs.parts(hot, parts)
            order = np.argsort(part, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
            del texts, part
            of, lists = [], [[] for _ in range(5)]
            for k in np.flatnonzero(np.diff(ends)):
                ctx, word, doc = pairs.at(order[ends[k] : ends[k + 1]])
                c, begins = np.unique(ctx, return_index=True)
                vocab, own_word = np.unique(word, return_inverse=True)
                of.append(int(k))
                for x, to in zip((h[c], np.diff(np.append(begins, len(ctx))).astype(np.uint32), h[vocab], own_word.astype(np.uint32), doc), lists, strict=True):
                    to.append(pack(x))
            cell = [pa.array(of, pa.int32()), pa.array([chunk] * len(of), pa.int64()), *(pa.array(x, pa.binary()) for x in lists)]
            del order, pairs, h
            yield pa.record_batch([*cell, pa.nulls(len(of), pa.list_(own.type)), pa.nulls(len(of), pa.list_(pa.int64()))], names=schema.names)
            one = pa.array([0, len(n)], pa.int32())
            yield pa.record_batch(
                [pa.array([-1 - chunk % 65521], pa.int32()), pa.array([chunk], pa.int64()), *(pa.nulls(1, pa.binary()) for _ in lists), pa.ListArray.from_arrays(one, own), pa.ListArray.from_arrays(one, pa.array(n, pa.int64()))],
                names=schema.names,
            )

    return rows.mapInArrow(made, schema)


def merged_parts(dealt: DataFrame, hot: np.ndarray) -> DataFrame:
    """A row for each part: its dishes (pairs) by context and word with their
    training counts, and for each chunk the texts and dishes of its tokens. The
    chunks' own rows are handed on."""
    listed = dealt.schema.fields[-2:]
    schema = StructType([*PART.fields, StructField("chunk", LongType()), *listed])

    def made(t: pa.Table) -> pa.Table:
        if t["part"][0].as_py() < 0:
            none = [pa.nulls(t.num_rows, f.type) for f in list(to_arrow_schema(schema))[1:-3]]
            return pa.table([t["part"], *none, t["chunk"], t["rows"], t["n"]], schema=to_arrow_schema(schema))
        t = t.sort_by("chunk")
        get = lambda name, kind: [unpack(x.as_py(), kind) for x in t[name]]
        vocabs, words, docs = get("vocab", "u8"), get("word", "u4"), get("doc", "u2")
        ctx = np.concatenate([np.repeat(c, n) for c, n in zip(get("ctx", "u8"), get("ctx_n", "u4"), strict=True)])
        vocab = np.unique(np.concatenate(vocabs))
        word = np.concatenate([np.searchsorted(vocab, v)[w] for v, w in zip(vocabs, words, strict=True)])
        contexts, ctx = np.unique(ctx, return_inverse=True)
        key, dish = np.unique(ctx * len(vocab) + word, return_inverse=True)
        doc = np.concatenate(docs)
        c = np.bincount(dish, weights=doc & 1, minlength=len(key)).astype(np.int64)
        own_ctx = key // len(vocab)
        sizes = np.bincount(own_ctx, minlength=len(contexts))
        of_ctx = np.bincount(own_ctx, weights=c, minlength=len(contexts)).astype(np.int64)
        tables = np.bincount(own_ctx, weights=c > 0, minlength=len(contexts)).astype(np.int64)
        is_hot = np.isin(contexts, hot)
        told = [{"ctx": int(contexts[k].view(np.int64)), "c": int(of_ctx[k]), "t": int(tables[k])} for k in np.flatnonzero(is_hot)]
        held = np.array([len(d) for d in docs])
        row = {
            "part": t["part"][0].as_py(), "chunks": t["chunk"].to_pylist(), "ctx": pack(contexts), "dishes": pack(sizes.astype(np.uint32)), "vocab": pack(vocab), "word": pack((key % len(vocab)).astype(np.uint32)), "c": pack(c),
            "held": pack(held), "dish": pack(dish.astype(np.uint32)), "doc": pack(doc >> 1), "contexts": int(((of_ctx > 0) & ~is_hot).sum()), "ones": int((c == 1).sum()), "twos": int((c == 2).sum()), "hot": told,
            "chunk": None, "rows": None, "n": None,
        }
        return pa.Table.from_pylist([row], schema=to_arrow_schema(schema))

    return dealt.groupBy("part").applyInArrow(made, schema)


class Dishes:
    """Customers of dishes in restaurants, and their seats.

    c: customers, 1 or more. base: the parent's probability of the dish. of: its
    restaurant. elsewhere: tables of each restaurant at dishes that aren't here."""

    def __init__(self, c: np.ndarray, base: np.ndarray, of: np.ndarray, elsewhere: np.ndarray, discount: float, strength: float, rng: np.random.Generator):
        self.d, self.strength, self.rng = discount, strength, rng
        self.many = np.flatnonzero(c > 1)  # a single customer has a table of its own
        self.c, self.base, self.of = c[self.many], base[self.many].astype(np.float64), of[self.many]
        self.t = np.ones(len(c), np.int64)
        self.total = elsewhere + np.bincount(of, minlength=len(elsewhere))
        self.start = np.cumsum(self.c) - self.c
        self.own = np.ones(len(self.many), np.int64)
        self.sizes = self._arrive()

    def _fresh(self, k: np.ndarray) -> np.ndarray:
        """The weight of a new table for these dishes."""
        return (self.strength + self.d * self.total[self.of[k]]) * self.base[k]

    def _arrive(self) -> np.ndarray:
        """Seats all customers one after the other; the sizes of all tables."""
        there, on, opened = np.ones(len(self.many), np.int64), np.arange(len(self.many)), []
        while len(on):
            p = self.rng.beta(self._fresh(on), there[on] - self.d * self.own[on])
            with np.errstate(divide="ignore", over="ignore"):
                wait = np.maximum(1, np.ceil(self.rng.standard_exponential(len(on)) / -np.log1p(-p)))
            stays = wait <= self.c[on] - there[on]
            on, wait = on[stays], wait[stays].astype(np.int64)
            there[on] += wait
            self.own[on] += 1
            np.add.at(self.total, self.of[on], 1)
            opened.append((on, there[on].copy()))
        ends = np.cumsum(self.own)
        sizes, left = np.ones(ends[-1] if len(ends) else 0, np.int64), self.c.copy()
        # the last table first: of those who came later to it or an earlier one, how many chose it
        for k in range(len(opened) - 1, -1, -1):
            on, at = opened[k]
            share = self.rng.beta(1 - self.d, at - 1 - self.d * (k + 1))
            size = 1 + self.rng.binomial(left[on] - at, share)
            sizes[ends[on] - self.own[on] + k + 1] = size
            left[on] -= size
        sizes[ends - self.own] = left
        return sizes

    def move(self) -> None:
        """A random customer of every dish gets up and sits down again."""
        n, rng = len(self.many), self.rng
        if not n:
            return
        sat = np.searchsorted(np.cumsum(self.sizes), self.start + (rng.random(n) * self.c).astype(np.int64), "right")
        self.sizes[sat] -= 1
        empty = self.sizes[sat] == 0
        self.own[empty] -= 1
        np.subtract.at(self.total, self.of[empty], 1)
        self.sizes = self.sizes[self.sizes > 0]
        fresh = self._fresh(np.arange(n))
        new = rng.random(n) * (fresh + self.c - 1 - self.d * self.own) < fresh
        upto, start, joins = np.cumsum(self.sizes), self.start - np.arange(n), np.flatnonzero(~new)
        sizes = self.sizes.copy()
        while len(joins):  # a table is chosen by its size less the discount
            at = np.searchsorted(upto, start[joins] + (rng.random(len(joins)) * (self.c[joins] - 1)).astype(np.int64), "right")
            taken = rng.random(len(joins)) * self.sizes[at] < self.sizes[at] - self.d
            sizes[at[taken]] += 1
            joins = joins[~taken]
        self.sizes = np.insert(sizes, np.cumsum(self.own)[new], 1)
        self.own[new] += 1
        np.add.at(self.total, self.of[new], 1)

    def states(self, samples: int, thin: int) -> Iterator[np.ndarray]:
        """The tables of each dish, in states `thin` rounds apart."""
        for _ in range(samples):
            for _ in range(thin):
                self.move()
            self.t[self.many] = self.own
            yield self.t.copy()


class Part:
    """A part's dishes, read from its row."""

    def __init__(self, row: dict, hot: np.ndarray):
        self.number = row["part"]
        self.contexts, self.vocab, self.word = unpack(row["ctx"], "u8"), unpack(row["vocab"], "u8"), unpack(row["word"], "u4").astype(np.int64)
        self.of = np.repeat(np.arange(len(self.contexts)), unpack(row["dishes"], "u4"))
        self.c = unpack(row["c"], "i8")
        self.seen = np.flatnonzero(self.c)
        self.is_hot = np.isin(self.contexts, hot)

    def whole(self, here: np.ndarray, hot_total: dict[int, int]) -> np.ndarray:
        """Numbers of each context; for hot ones, those of all parts."""
        out = here.copy()
        for k in np.flatnonzero(self.is_hot):
            out[k] = hot_total[int(self.contexts[k].view(np.int64))]
        return out

    def count(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[self.seen], weights=values, minlength=len(self.contexts)).astype(np.int64)

    def states(self, base: np.ndarray, hot_tables: dict[int, int], discount: float, strength: float, samples: int, thin: int) -> Iterator[np.ndarray]:
        """The tables of each seen dish."""
        one = self.count(np.ones(len(self.seen)))
        dishes = Dishes(self.c[self.seen], base[self.word[self.seen]], self.of[self.seen], self.whole(one, hot_tables) - one, discount, strength, np.random.default_rng([11, self.number]))
        return dishes.states(samples, thin)


def _ranges(vocab: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of hashes begins, and the end."""
    return np.searchsorted(vocab >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(vocab)])


def _sent(part: Part, tables: np.ndarray, bits: int, told: list[dict]) -> list[dict]:
    """Rows for the ranges of the part's words: their tables in each sample."""
    at = _ranges(part.vocab, bits)
    return [{"range": k, "part": part.number, "words": pack(part.vocab[at[k] : at[k + 1]]), "tables": pack(tables[:, at[k] : at[k + 1]].astype(np.uint32)), "hot": told if k == 0 else None} for k in range(len(at) - 1)]


def parent_seats(sent: DataFrame, number: int, discount: float, strength: float, words: int, samples: int, moves: int) -> DataFrame:
    """The single words' restaurant, range by range: for each part and range,
    customers less discounts of its words, by sample. Without moves, every word
    has one table and the customers come back as they are."""

    def made(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        own = [unpack(x.as_py(), "u8") for x in t["words"]]
        vocab = np.unique(np.concatenate(own))
        at = [np.searchsorted(vocab, w) for w in own]
        c = np.zeros((samples, len(vocab)), np.int64)
        for k, x in zip(at, t["tables"], strict=True):
            c[:, k] += unpack(x.as_py(), "u4").reshape(samples, -1)
        held, tables = c.astype(np.float32), (c > 0).sum(axis=1)
        for s in range(samples if moves else 0):
            seen = np.flatnonzero(c[s])
            dishes = Dishes(c[s, seen], np.full(len(seen), 1 / (words + 1)), np.zeros(len(seen), np.int64), np.array([max(0, words - len(seen))]), discount, strength, np.random.default_rng([12, t["range"][0].as_py(), s]))
            for own_t in dishes.states(1, moves):
                held[s, seen] -= discount * own_t
                tables[s] = own_t.sum()
        rows = [
            {"part": p, "range": t["range"][0].as_py(), "round": number, "held": pack(held[:, k])} | ({"customers": c.sum(axis=1).tolist(), "tables": tables.tolist(), "ones": int((c[0] == 1).sum()), "twos": int((c[0] == 2).sum())} if not n else {})
            for n, (p, k) in enumerate(zip(t["part"].to_pylist(), at, strict=True))
        ]
        return pa.Table.from_pylist(rows, schema=to_arrow_schema(BACK))

    return written(sent.groupBy("range").applyInArrow(made, BACK), "lm-back")


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))


def _totals(back: DataFrame, samples: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The parent's customers and tables by sample, and its discount if each word had one table."""
    told = [F.sum(F.col(name)[s]) for name in ("customers", "tables") for s in range(samples)]
    found = [int(x or 0) for x in back.agg(*told, F.sum("ones"), F.sum("twos")).first()]
    return np.array(found[:samples]), np.array(found[samples : 2 * samples]), _discount(*found[2 * samples :])


def _values(right: pa.Table, number: int, samples: int) -> np.ndarray:
    """What came back for a part's words, [sample, word]."""
    rows = sorted((r for r in right.select(["range", "round", "held"]).to_pylist() if r["round"] == number), key=lambda r: r["range"])
    return np.concatenate([unpack(r["held"], "f4").reshape(samples, -1) for r in rows], axis=1).astype(np.float64)


def score_texts(
    docs: DataFrame, learn: Column, text_col: str = "text", samples: int = 3, thin: int = 6, strength: float = 1.0, parent_strength: float = 1.0, part_tokens: int = 1_750_000
) -> DataFrame:
    """row (a struct of the columns but the text), n_tokens, n_known (tokens seen
    in training), train_tokens, base_score (log10, each token's training count
    plus one) and score (the model's log10 probability), one row per input row.
    The model is trained on the rows for which `learn` is true, all of them."""
    spark = docs.sparkSession
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col))
    rows = docs.select(others.alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("body"))
    row_type = rows.schema["row"].dataType
    out = StructType([StructField("row", row_type), *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(StructField(c, DoubleType()) for c in ("base_score", "score"))])

    n_all, hot = frequent_words(rows)
    if not n_all:
        return spark.createDataFrame([], out)
    parts = -(-n_all // part_tokens)
    bits = (parts // 2).bit_length()
    name, buckets = new_table("lm_parts"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged_parts(cells(rows, hot, parts), hot).write.option("path", new_path(spark, "lm-parts")).bucketBy(buckets, "part").saveAsTable(name)
    held = spark.table(name).filter("part >= 0")
    total = held.agg(F.sum("contexts"), F.sum("ones"), F.sum("twos")).first()
    hot_rows = held.select(F.explode("hot").alias("h")).groupBy("h.ctx").agg(F.sum("h.c"), F.sum("h.t")).collect()  # HOT rows at most
    hot_c, hot_t = {r[0]: r[1] for r in hot_rows}, {r[0]: r[2] for r in hot_rows}
    words = total[0] + sum(c > 0 for c in hot_c.values())
    discount = _discount(total[1], total[2])
    dish_columns = ["part", "ctx", "dishes", "vocab", "word", "c"]

    def one_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(row, hot)
                seen = np.bincount(part.word[part.seen], minlength=len(part.vocab))
                yield pa.RecordBatch.from_pylist(_sent(part, seen[None, :], bits, []), schema=to_arrow_schema(SENT))

    # the parent's customers if every dish had one table: where the sampler begins
    first = parent_seats(written(held.select(dish_columns).mapInArrow(one_table, SENT), "lm-sent"), 0, 0.0, parent_strength, words, 1, 0)
    customers, _, parent_discount = _totals(first, 1)

    def parent_before(right: pa.Table) -> np.ndarray:
        c = _values(right, 0, 1)[0]
        open_mass = (parent_strength + parent_discount * words) / (words + 1)
        return (np.maximum(c - parent_discount, 0) + open_mass) / (parent_strength + customers[0])

    def seated(left: pa.Table, right: pa.Table) -> pa.Table:
        part = Part(left.to_pylist()[0], hot)
        tables, told = np.zeros((samples, len(part.vocab)), np.int64), []
        for s, t in enumerate(part.states(parent_before(right), hot_t, discount, strength, samples, thin)):
            tables[s] = np.bincount(part.word[part.seen], weights=t, minlength=len(part.vocab))
            by_ctx = part.count(t)
            told += [{"ctx": int(part.contexts[k].view(np.int64)), "sample": s, "t": int(by_ctx[k])} for k in np.flatnonzero(part.is_hot)]
        return pa.Table.from_pylist(_sent(part, tables, bits, told), schema=to_arrow_schema(SENT))

    sent = written(held.select(dish_columns).groupBy("part").cogroup(first.groupBy("part")).applyInArrow(seated, SENT), "lm-sent")
    hot_now: list[dict[int, int]] = [{} for _ in range(samples)]
    for r in sent.select(F.explode("hot").alias("h")).groupBy("h.ctx", "h.sample").agg(F.sum("h.t").alias("t")).collect():  # HOT rows a sample at most
        hot_now[r["sample"]][r["ctx"]] = r["t"]
    second = parent_seats(sent, 1, parent_discount, parent_strength, words, samples, 2 * thin)
    parent_c, parent_t, _ = _totals(second, samples)
    train_tokens = int(parent_tokens(held))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        part, after = Part(row, hot), _values(right, 1, samples)
        of_ctx = part.whole(np.bincount(part.of, weights=part.c, minlength=len(part.contexts)).astype(np.int64), hot_c)
        p = np.zeros(len(part.c))
        for s, t in enumerate(part.states(parent_before(right), hot_t, discount, strength, samples, thin)):
            parent = (np.maximum(after[s], 0) + (parent_strength + parent_discount * parent_t[s]) / (words + 1)) / (parent_strength + parent_c[s])
            own = np.zeros(len(part.c))
            own[part.seen] = part.c[part.seen] - discount * t
            opened = strength + discount * part.whole(part.count(t), hot_now[s])
            p += (own + opened[part.of] * parent[part.word]) / (strength + of_ctx[part.of])
        log_p = np.log10(p / samples)
        base, known = np.log10((of_ctx + 1) / (train_tokens + words + 1))[part.of], (of_ctx > 0)[part.of]
        dish, doc, at, rows = unpack(row["dish"], "u4"), unpack(row["doc"], "u2").astype(np.int64), 0, []
        for chunk, n in zip(row["chunks"], unpack(row["held"], "i8"), strict=True):
            own_doc, own_dish = doc[at : at + n], dish[at : at + n]
            at += n
            times = np.bincount(own_doc)
            there = np.flatnonzero(times)
            sums = (np.bincount(own_doc, weights=x[own_dish])[there] for x in (known, base, log_p))
            rows.append([chunk, part.number, pack(there.astype(np.uint16)), *(pack(x) for x in sums)])
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (f.type for f in to_arrow_schema(SUMS)), strict=True)], schema=to_arrow_schema(SUMS))

    both = first.select("part", "range", "round", "held").union(second.select("part", "range", "round", "held"))
    sums = held.select(*dish_columns, "chunks", "held", "dish", "doc").groupBy("part").cogroup(both.groupBy("part")).applyInArrow(scored, SUMS)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        own, n = left["rows"].combine_chunks().flatten(), left["n"].combine_chunks().flatten()
        sums = np.zeros((3, len(own)))
        for r in right.sort_by("part").to_pylist():
            doc = unpack(r["doc"], "u2")
            for k, name in enumerate(("known", "base", "score")):
                sums[k, doc] += unpack(r[name], "f8")
        return pa.table([own, n, pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(own), train_tokens)), pa.array(sums[1]), pa.array(sums[2])], schema=to_arrow_schema(out))

    texts = spark.table(name).filter("part < 0").select("chunk", "rows", "n")
    return texts.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(together, out)


def parent_tokens(held: DataFrame) -> int:
    """All training tokens of the parts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([int(unpack(x.as_py(), "i8").sum()) for x in batch.column(0)], pa.int64())], names=["n"])

    return held.select("c").mapInArrow(made, "n BIGINT").agg(F.sum("n")).first()[0] or 0
