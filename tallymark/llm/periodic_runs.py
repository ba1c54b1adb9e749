"""Runs: stretches of words that repeat with a period, in every document.

A run is a maximal stretch of consecutive words with smallest period q, at least
max(least, 2 * q) words long. For every period p the grid 0, p, 2p, ... has two
neighbours in any run of that period, so a run is found by comparing grid
neighbours: n / p pairs for each p, n log n in all. Where two words agree, the
longest common extensions (LCE) to both sides give the run's ends.

An LCE compares words one by one until both places are in the difference cover
(places whose residue modulo 31 is in COVER; any two places get there together in
fewer than 31 words). Most end before that. The others are answered by the
cover's suffixes alone: these are sorted by prefix doubling in steps of the
cover's modulus, and the LCE of two of them is a range minimum over the common
prefixes of neighbours in that order, from a sparse table. Only documents with
such a query get their suffixes sorted.

Everything happens within a document, so there is no shuffle; a batch of
documents is compared at once, with a separator of its own after each.

Defined cases: a null, empty or white-space text has no words and no runs, and
collapses to the empty text; ids aren't looked at, so null and repeated ones are
fine; equal texts have equal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: A perfect difference set: every residue modulo 31 is a difference of two of these.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Words compared at least before the cover is used, so that chance matches never need it.
LEAST_DIRECT = 4
#: Candidates looked at together, and words of documents that are compared together.
SLICE, BATCH_WORDS = 1 << 19, 1 << 20

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def _meeting() -> np.ndarray:
    """[i % 31, j % 31] -> the fewest words from i and j to places that are both in the cover."""
    held = np.isin(np.arange(MODULUS), COVER)
    i, j, step = np.ogrid[:MODULUS, :MODULUS, :MODULUS]
    both = held[(i + step) % MODULUS] & held[(j + step) % MODULUS]
    return both.argmax(axis=2)


MEETING = _meeting()


class CoverSuffixes:
    """LCE between places in the cover of one text x (word numbers from 0)."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        self.number = np.full(n + 1, -1, np.int64)
        self.number[at] = np.arange(len(at))
        padded = np.concatenate((x, np.full(MODULUS, -1, x.dtype)))
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, MODULUS)[at])
        rank = np.unique(blocks.view(np.dtype((np.void, blocks.itemsize * MODULUS))).ravel(), return_inverse=True)[1].ravel()
        ranks, step = [rank], MODULUS
        while step < n and int(rank.max()) + 1 < len(at):
            after = self._ranks(rank, at + step, n) + 1
            rank = np.unique(rank * (len(at) + 1) + after, return_inverse=True)[1].ravel()
            ranks.append(rank)
            step *= 2
        self.rank = rank
        self.tables = self._sparse(self._common(padded, at[np.argsort(rank)], ranks, n))

    def _ranks(self, rank: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Their ranks; -1 past the end."""
        number = self.number[np.minimum(places, n)]
        return np.where(number >= 0, rank[number], -1)

    def _common(self, padded: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], n: int) -> np.ndarray:
        """Words that neighbours in the sorted order share."""
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            ra, rb = self._ranks(ranks[k], a, n), self._ranks(ranks[k], b, n)
            more = np.where((ra == rb) & (ra >= 0), MODULUS << k, 0)
            a, b = a + more, b + more
        rest = np.arange(len(a))
        for _ in range(MODULUS):
            rest = rest[(a[rest] < n) & (b[rest] < n)]
            rest = rest[padded[a[rest]] == padded[b[rest]]]
            a[rest] += 1
            b[rest] += 1
        return a - order[:-1]

    @staticmethod
    def _sparse(least: np.ndarray) -> list[np.ndarray]:
        tables = [least]
        while len(tables[-1]) > 1 << (len(tables) - 1):
            half = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
        return tables

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i < j: places in the cover, or the end."""
        a, b = self._ranks(self.rank, i, len(self.number) - 1), self._ranks(self.rank, j, len(self.number) - 1)
        out, inside = np.zeros(len(i), np.int64), np.flatnonzero((a >= 0) & (b >= 0))
        low, high = np.minimum(a, b)[inside], np.maximum(a, b)[inside]
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            own = level == k
            out[inside[own]] = np.minimum(self.tables[k][low[own]], self.tables[k][high[own] - (1 << k)])
        return out


class Extensions:
    """LCE to the right between places of the same text, for the texts of a
    batch; x has all of them, each followed by a number that stands nowhere else."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.x, self.starts, self.lengths = x, starts, lengths
        self.sorted: dict[int, CoverSuffixes] = {}

    def lce(self, text: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i < j: places within that text."""
        own = self.starts[text]
        direct = LEAST_DIRECT + MEETING[(i + LEAST_DIRECT) % MODULUS, (j + LEAST_DIRECT) % MODULUS]
        out, rest = np.zeros(len(i), np.int64), np.arange(len(i))
        a, b = own + i, own + j
        for step in range(LEAST_DIRECT + MODULUS):
            rest = rest[self.x[a[rest] + step] == self.x[b[rest] + step]]
            out[rest] += 1
            rest = rest[direct[rest] > step + 1]
            if not len(rest):
                break
        far = np.flatnonzero(out == direct)
        far = far[np.argsort(text[far], kind="stable")]
        for part in np.split(far, np.flatnonzero(np.diff(text[far])) + 1) if len(far) else ():
            k = int(text[part[0]])
            if k not in self.sorted:
                self.sorted[k] = CoverSuffixes(self.x[self.starts[k] : self.starts[k] + self.lengths[k]])
            out[part] += self.sorted[k].lce(i[part] + direct[part], j[part] + direct[part])
        return out


def grid_matches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i, p: neighbours i and i + p of the grid of p with equal words, for all
    p up to half of the text. Short periods are compared one by one, long ones
    all together for each place of the grid."""
    n, small = len(x), int(len(x) ** 0.5)
    found_i, found_p = [], []
    for p in range(1, min(small, n // 2) + 1):
        k = np.flatnonzero(x[: n - p : p] == x[p::p])
        if len(k):
            found_i.append(k * p)
            found_p.append(np.full(len(k), p))
    low, k = small + 1, 0
    while (high := min(n // 2, (n - 1) // (k + 1))) >= low:
        left = x[k * low : k * high + 1 : k] if k else x[0]
        p = low + np.flatnonzero(left == x[(k + 1) * low : (k + 1) * high + 1 : k + 1])
        if len(p):
            found_i.append(k * p)
            found_p.append(p)
        k += 1
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_p)


def find_runs(texts: list[np.ndarray], least: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """text numbers and (start, length, period) of all runs, sorted. A text is
    an array of word numbers from 0."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = -2 - np.arange(len(texts), dtype=np.int64)
    forth = np.concatenate([np.append(t, e) for t, e in zip(texts, ends, strict=True)])
    back = np.concatenate([np.append(t[::-1], e) for t, e in zip(texts, ends, strict=True)])
    starts = np.cumsum(lengths + 1) - lengths - 1
    right, left = Extensions(forth, starts, lengths), Extensions(back, starts, lengths)
    found = []
    grids = [grid_matches(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), [len(g[0]) for g in grids])
    i, p = (np.concatenate([g[k] for g in grids]) for k in (0, 1))
    for at in range(0, len(i), SLICE):
        t, a, q = text[at : at + SLICE], i[at : at + SLICE], p[at : at + SLICE]
        last = lengths[t] - 1
        before = left.lce(t, last - (a + q), last - a) - 1  # from the pair itself to the left
        first = np.flatnonzero(before < q)  # a run counts at its first pair of the grid
        t, a, q, before = t[first], a[first], q[first], before[first]
        length = before + q + right.lce(t, a, a + q)
        keep = length >= np.maximum(least, 2 * q)
        found.append(np.stack((t, a - before, length, q), axis=1)[keep])
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    # multiples of a period have the same ends; the smallest stays
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(axis=1)
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return runs[:, 0], runs[:, 1:]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words joined by one space, without those that stand in a run after
    its first period."""
    if len(runs):
        lost = np.zeros(len(words) + 1, np.int64)
        np.add.at(lost, runs[:, 0] + runs[:, 2], 1)
        np.add.at(lost, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(lost)[:-1] == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def batches_of(texts: Iterator[str | None], most: int) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in texts:
        held.append(words_of(text))
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """row (a struct of the columns but the text), n_words, runs (an array of
    start, length, period, sorted by start and period), collapsed (the text
    with each run cut to its first period); one row per input row."""
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col))
    rows = docs.select(others.alias("row"), F.col(text_col).alias("body"))
    schema = StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words in batches_of((x.as_py() for x in batch.column(1)), BATCH_WORDS):
                numbers: dict[bytes, int] = {}
                texts = [np.array([numbers.setdefault(w, len(numbers)) for w in own], np.int64) for own in words]
                text, runs = find_runs(texts, least)
                cuts = np.searchsorted(text, np.arange(len(words) + 1))
                spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], [f.name for f in RUN])
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(words)),
                        pa.array([len(own) for own in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
                        pa.array([collapsed(own, runs[cuts[k] : cuts[k + 1]]) for k, own in enumerate(words)], pa.string()),
                    ],
                    names=schema.names,
                )
                at += len(words)

    return rows.mapInArrow(made, schema)
