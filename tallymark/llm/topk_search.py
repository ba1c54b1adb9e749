"""Exact top-k by inner product over multi-resolution segment statistics.

A block's vectors are turned to their principal axes, which changes no inner
product, and cut into segments, short ones where the spread is; each segment
has a mean and a deviation. For two vectors, the inner product within a segment
is at most n * (m1 * m2 + d1 * d2) for the means m and deviations d (the lower
bound of their distance, turned round), so sums of these bound the score,
tighter at each finer resolution. Pairs of a query and a candidate go through
the resolutions coarse to fine against the k-th best exact score so far, which
starts from a sample that all blocks share; what survives gets its exact score.
The bounds only decide what is worth scoring: results are exact.

Surviving pairs are scored one by one while they are few; where more than one in
DENSE survives, a matrix product of the whole step is cheaper.

Queries and candidates meet in blocks: each task holds one block of queries and
one of candidates, of bounded size, and keeps k rows for each query.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; vectors of different lengths don't meet;
rows that repeat an id each count as a candidate, and none of them answers a
query of the same id; an id is one query, of its least vector if it has many.
Components are integers of any size that a double holds; scores are exact
whatever their size, and one beyond 63 bits raises an error. An empty table has
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One in so many pairs: above it, products are made of whole steps.
DENSE = 8
#: Candidates that give each query its first limit.
SAMPLE = 2048


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; doubles from 2**53 on are whole."""
    y = lambda x: x.cast("double") * scale
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < float(1 << 53), F.floor(y(x)).cast("double")).otherwise(y(x)))


def resolutions(size: int) -> list[list[slice]]:
    """Segments, coarse to fine: the first `singles` axes alone, then segments
    that double in length."""
    found = []
    for singles in (1, 4, 16, 32):
        if singles > 1 and singles * 2 > size:
            break
        edges = list(range(min(singles, size) + 1))
        while edges[-1] < size:
            edges.append(min(2 * edges[-1], size))
        found.append([slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return found


def segments(x: np.ndarray, cut: list[slice]) -> np.ndarray:
    """Means and deviations of each row's segments, each times the root of its
    length, so that an inner product of two rows bounds that of the vectors."""
    root = np.sqrt([c.stop - c.start for c in cut])
    mean = np.stack([x[:, c].mean(axis=1) for c in cut], axis=1) * root
    return np.hstack((mean, np.stack([x[:, c].std(axis=1) for c in cut], axis=1) * root))


def _pairwise(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a[i[k : k + step]], b[j[k : k + step]]) for k in range(0, len(i), step)] or [np.zeros(0)])


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size."""
    whole = [[int(v) for v in row] for row in q], [[int(v) for v in row] for row in x]
    found = [sum(map(int.__mul__, whole[0][a], whole[1][b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    return np.array(found, dtype=object)


def best(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, first: np.ndarray | None = None, step: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query index, candidate index and score of the k best of each query, ties
    to the smaller id, and how many exact scores that took. first: a score that
    each query's k-th best is known to reach."""
    size = x.shape[1]
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    if max(np.abs(q).max(), np.abs(x).max()) >= 1e140:
        raise OverflowError("components are too large for scores of 63 bits")
    axes = np.linalg.eigh(x.T @ x / max(1.0, np.abs(x).max() ** 2))[1][:, ::-1]
    bounds = [(segments(q @ axes, cut), segments(x @ axes, cut)) for cut in resolutions(size)]
    largest = np.abs(q).max(axis=1, initial=0) * np.abs(x).max(initial=0) * size
    whole = bool((largest < 1 << 53).all())  # else float products aren't exact
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0))
    limit = np.full(len(q), -np.inf) if first is None else first.copy()
    order = np.lexsort((x_id, -np.einsum("ij,ij->i", x, x)))  # high scores first, so that the limit rises early
    top_i, top_at, top_score, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, float if whole else object), 0
    wait = 0  # where bounds spare next to nothing, the next three steps do without
    for lo in range(0, len(order), step):
        own = order[lo : lo + step]
        alive, i, j = np.ones((len(q), len(own)), bool), None, None
        wait -= 1
        for of_q, of_x in bounds if wait < 0 else ():
            if i is None:
                high = of_q @ of_x[own].T + slack[:, None] >= limit[:, None]
                alive &= high
                if alive.sum() * DENSE < alive.size:
                    i, j = np.nonzero(alive)
            else:
                stays = _pairwise(of_q, of_x[own], i, j) + slack[i] >= limit[i]
                i, j = i[stays], j[stays]
        if i is None:
            wait = 3 if wait < 0 and alive.mean() > 0.9 and np.isfinite(limit).all() else wait
            scored += alive.size
            score = q @ x[own].T
            i, j = np.nonzero(alive & (score + slack[:, None] >= limit[:, None]) & (q_id[:, None] != x_id[own][None, :]))
            score = score[i, j]
        else:
            other = q_id[i] != x_id[own[j]]
            i, j = i[other], j[other]
            scored += len(i)
            score = _pairwise(q, x[own], i, j)
        if not whole:
            score = _exact(q, x[own], i, j)
        i, at, score = np.concatenate((top_i, i)), np.concatenate((top_at, own[j])), np.concatenate((top_score, score))
        rank = np.lexsort((x_id[at], -score, i)) if whole else np.array(sorted(range(len(i)), key=lambda n: (i[n], -score[n], x_id[at[n]])), dtype=np.int64)
        i, at, score = i[rank], at[rank], score[rank]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        kth = place == k - 1
        limit[i[kth]] = np.maximum(limit[i[kth]], score[kth].astype(float) * (1 if whole else 1 - 1e-12 * np.sign(score[kth].astype(float))))
        top_i, top_at, top_score = (v[place < k] for v in (i, at, score))
    return top_i, top_at, top_score, scored


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _first_limits(queries: DataFrame, good: DataFrame, k: int, id_col: str) -> DataFrame:
    """Adds limit: the k-th best score among SAMPLE candidates picked by hash, less what rounding may add."""
    found = good.orderBy(F.xxhash64(id_col, F.lit(5)), id_col).limit(SAMPLE).toPandas()
    by_size = {n: (_matrix(part["vector"]), part[id_col].to_numpy()) for n, part in found.groupby("size")}
    shared = queries.sparkSession.sparkContext.broadcast(by_size)  # SAMPLE vectors at most

    def limited(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            limit = np.full(len(part), -np.inf)
            for n in part["size"].unique():
                rows = np.flatnonzero(part["size"].to_numpy() == n)
                x, x_id = shared.value.get(n, (np.zeros((0, n)), np.zeros(0)))
                if len(x) > k:
                    q = _matrix(part["vector"].iloc[rows])
                    score = q @ x.T
                    score[part[id_col].to_numpy()[rows][:, None] == x_id[None, :]] = -np.inf
                    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max())
                    limit[rows] = np.partition(score, len(x) - k, axis=1)[:, len(x) - k] - slack
            yield part.assign(limit=limit)

    return queries.mapInPandas(limited, f"{id_col} long, vector array<double>, size int, limit double")


def search(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 2048, candidate_block: int = 8192) -> DataFrame:
    """query_id, rank, id, score (long): the k rows with the largest inner
    product with each row where is_query (on the id column) holds, itself
    excluded. Components must be whole numbers. Candidates are sent once for
    each block of queries; a task holds one block of each.
    """
    good = rows.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("vector")).filter(F.col(id_col).isNotNull() & usable(F.col("vector")))
    good = good.withColumn("size", F.size("vector"))
    queries = good.filter(is_query).groupBy(id_col).agg(F.min("vector").alias("vector")).withColumn("size", F.size("vector"))
    sizes = good.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    n_x, n_q = -(-sizes[0] // candidate_block) or 1, -(-sizes[1] // query_block) or 1
    block = lambda n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    x = good.withColumn("x_block", block(n_x)).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = _first_limits(queries, good, k, id_col).withColumn("q_block", block(n_q)).withColumn("x_block", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    keys = ["q_block", "x_block", "size"]

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="int64")})]
        if len(a) and len(b):
            q_id, first, x_id, xs = a[id_col].to_numpy(), a["limit"].to_numpy(), b[id_col].to_numpy(), _matrix(b["vector"])
            for lo in range(0, len(a), 512):
                i, j, score, _ = best(_matrix(a["vector"].iloc[lo : lo + 512]), q_id[lo : lo + 512], xs, x_id, k, first[lo : lo + 512])
                if any(abs(s) >= 1 << 63 for s in score.tolist()):
                    raise OverflowError("a score has more than 63 bits")
                parts.append(pd.DataFrame({"query_id": q_id[lo + i], "id": x_id[j], "score": score.astype("int64")}))
        return pd.concat(parts)

    found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(scored, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
