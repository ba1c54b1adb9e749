"""Approximate nearest neighbours over a neighbour graph made by NN-descent.

The graph starts sparse: each node's neighbours among the few hundred that share
one of its nearest pivots, whose number grows with the nodes. It improves by
joins, until a round gains little: every node introduces its neighbours, forward
and reverse, to each other, and pairs nearer than what either has are kept. Only
pairs of which one is new to that node are looked at, and of new and old ones a
sample each, so the distances worked out are a small share of all pairs.
Queries search the graph greedily from their own node's neighbours: each round
expands the nearest nodes not yet expanded, for all queries at once.

Equal vectors are one node. Each node keeps its smallest row ids, one more than
an answer needs, so groups of copies never meet in pairs.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id. Vectors of each length are
searched among themselves. Rows that repeat an id with another vector are
candidates each; the query of that id is its first vector of a length. Vectors
are told apart by a 64-bit hash: of 10**8 different ones, two or more share one
with a probability of 0.0003, and would then count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, new_path, written
from .topk_search import usable

#: Nodes that share a pivot, about; pivots of each node.
BLOCK, NEAR = 256, 2
#: More pivots than these are looked up in groups, of which a node sees so many.
FLAT, GROUPS = 1024, 8


def distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _nearest(of: DataFrame, k: int, by: str, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return of.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def _within(x: np.ndarray, k: int, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row among the rows, by index, with distances."""
    x = x.astype(np.float32)
    sq = np.einsum("ij,ij->i", x, x)
    k = min(k, len(x) - 1)
    found = []
    for lo in range(0, len(x) if k > 0 else 0, step):
        own = np.arange(lo, min(lo + step, len(x)))
        d = sq[own, None] + sq[None, :] - 2 * x[own] @ x.T
        d[np.arange(len(own)), own] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        found.append((np.repeat(own, k), near.reshape(-1), np.take_along_axis(d, near, 1).reshape(-1)))
    i, j, d = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return i, j, np.sqrt(np.maximum(d, 0).astype(float))


def pivot_lookup(centre: np.ndarray, near: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from vectors to their `near` nearest pivots, nearest first.
    More than FLAT pivots are grouped by the nearest of about their square
    root, so that a vector meets a few groups' pivots, not all."""
    own = 0.5 * np.einsum("ij,ij->i", centre, centre)
    if len(centre) <= FLAT:
        return lambda x: np.argsort(own - x @ centre.T, axis=1, kind="stable")[:, :near]
    heads = np.arange(int(len(centre) ** 0.5))
    group = np.concatenate([np.argmin(own[heads] - centre[lo : lo + 4096] @ centre[heads].T, axis=1) for lo in range(0, len(centre), 4096)])
    inside = [np.flatnonzero(group == g) for g in heads]

    def found(x: np.ndarray) -> np.ndarray:
        seen = np.argsort(own[heads] - x @ centre[heads].T, axis=1, kind="stable")[:, :GROUPS]
        far, best = np.full((len(x), near), np.inf), np.zeros((len(x), near), int)
        for g in np.unique(seen):
            rows, these = np.flatnonzero((seen == g).any(axis=1)), inside[g]
            d = np.concatenate((far[rows], own[these] - x[rows] @ centre[these].T), axis=1)
            which = np.concatenate((best[rows], np.broadcast_to(these, (len(rows), len(these)))), axis=1)
            pick = np.argsort(d, axis=1, kind="stable")[:, :near]
            far[rows], best[rows] = np.take_along_axis(d, pick, 1), np.take_along_axis(which, pick, 1)
        return best

    return found


def first_graph(nodes: DataFrame, n: int, k: int) -> DataFrame:
    """a, b, d: neighbours among the nodes that share a near pivot. Pivots are
    picked by hash, as many as make blocks of about BLOCK nodes if each node
    goes to its NEAR nearest. A block of 16 times that (around a pivot that is
    near to very many) is dealt by hash, so that it fits in memory."""
    pivots = max(1, -(-n * NEAR // BLOCK))
    at = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(pivots).select(F.col("vector").cast("array<float>").alias("vector")).toArrow()
    centre = at.column(0).combine_chunks().flatten().to_numpy().reshape(at.num_rows, -1)
    near_by = min(NEAR, len(centre))
    sent = nodes.sparkSession.sparkContext.broadcast(centre)

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = pivot_lookup(sent.value, near_by)
        for part in parts:
            pick = lookup(np.stack(part["vector"].to_numpy()))
            for t in range(near_by):
                yield pd.DataFrame({"pivot": pick[:, t], "node": part["node"], "vector": part["vector"]})

    def near(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        ids = part["node"].to_numpy()
        i, j, d = _within(np.stack(part["vector"].to_numpy()), k)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "d": d})

    blocks = nodes.mapInPandas(dealt, "pivot int, node long, vector array<float>")
    large = blocks.groupBy("pivot").count().filter(F.col("count") > 16 * BLOCK).collect()
    salts = F.coalesce(F.create_map(*(F.lit(v) for r in large for v in (r["pivot"], -(-r["count"] // (16 * BLOCK)))))[F.col("pivot")], F.lit(1)) if large else F.lit(1)
    salt = F.pmod(F.xxhash64("node", "pivot"), salts)
    return blocks.groupBy("pivot", salt.alias("salt")).applyInPandas(near, "a long, b long, d double")


def adjacent(graph: DataFrame, reverse: int) -> DataFrame:
    """m, a: each node's neighbours and up to `reverse` nodes whose neighbour it is."""
    back = _nearest(graph.select(F.col("b").alias("m"), F.col("a"), "d"), reverse, "m", "d", "a")
    return graph.select(F.col("a").alias("m"), F.col("b").alias("a")).union(back.select("m", "a")).distinct()


def _drawn(share: float, seed: int) -> Column:
    """True for about that share of a graph's edges, others in each round."""
    return F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(1000)) < int(1000 * share)


def meetings(graph: DataFrame, share: float, most: int, seed: int) -> DataFrame:
    """m, a, new: whom each node introduces to each other: of its neighbours, and
    of the nodes whose neighbour it is, a share drawn by hash, and `most` of them
    in all, new ones first. Nodes without a new one introduce nobody."""
    way = F.inline(F.array(F.struct(F.col("a").alias("m"), F.col("b").alias("x")), F.struct(F.col("b").alias("m"), F.col("a").alias("x"))))
    both = graph.filter(_drawn(share, seed)).select(way, "new").repartition("m")
    rank = F.row_number().over(Window.partitionBy("m").orderBy(F.desc("new"), F.xxhash64("m", "x", F.lit(seed)), "x"))
    kept = both.withColumn("rank", rank).filter(F.col("rank") <= most)
    kept = kept.withColumn("any", F.max("new").over(Window.partitionBy("m"))).filter("any")
    return kept.groupBy("m", F.col("x").alias("a")).agg(F.max("new").alias("new"))


def introduced(met: DataFrame) -> DataFrame:
    """met: m, a, new, r (distance a's neighbours reach), vector. Returns pairs
    a, b, d of nodes that meet at an m, one of them new, with d below a's r; and
    for each batch a row of nulls with the number of distances worked out."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None

        def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            m, a, r = (batch.column(i).to_numpy() for i in (0, 1, 3))
            new = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            x = batch.column(4).flatten().to_numpy().reshape(len(m), -1)
            sq = np.einsum("ij,ij->i", x, x)
            edge = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1], [True])))
            out, n = [], 0
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                fresh = lo + np.flatnonzero(new[lo:hi])
                d = sq[fresh, None] + sq[None, lo:hi] - 2 * x[fresh] @ x[lo:hi].T
                n += d.size
                i, j = np.nonzero(d < np.maximum(r[fresh, None], r[None, lo:hi]) ** 2)
                i, j, d = fresh[i], j + lo, d[i, j]
                for u, v in ((i, j), (j, i)):
                    near = (d < r[u] * r[u]) & (a[u] != a[v])
                    out.append((a[u[near]], a[v[near]], d[near]))
            u, v, d = (np.concatenate(t) for t in zip(*out, strict=True))
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(np.sqrt(np.maximum(d, 0).astype(float))), pa.nulls(len(u), pa.int64())], names=["a", "b", "d", "n"])
            yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([n])], names=["a", "b", "d", "n"])

        for batch in batches:
            batch = batch if kept is None else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            m = batch.column(0).to_numpy()
            full = int(np.searchsorted(m, m[-1])) if len(m) else 0
            if full:
                yield from made(batch.slice(0, full))
            kept = batch.slice(full)
        if kept is not None and kept.num_rows:
            yield from made(kept)

    return met.repartition("m").sortWithinPartitions("m").mapInArrow(pairs, "a long, b long, d double, n long")


def build_graph(nodes: DataFrame, n: int, k: int = 40, share: float = 0.5, most: int = 64, rounds: int = 16, least_gain: float = 0.003, watch: Callable[[int, DataFrame, int], None] | None = None) -> DataFrame:
    """a, b, d: about the k nearest other nodes of each.

    Each round, new neighbours meet each other and the old ones; pairs nearer
    than what either has become new neighbours. Ends when a round shortens the
    neighbours' distances, in sum, by less than a share of least_gain, or after
    `rounds` rounds. watch: gets the start as round 0, then each round's graph,
    and the number of distances that it took.
    """
    spark = nodes.sparkSession

    def stored(edges: DataFrame) -> tuple[str, DataFrame, float, int]:
        path = new_path(spark, "nn-graph")
        dealt = edges.filter("a is not null").repartition("a")  # by which all that follows is dealt out already
        best = _nearest(dealt.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("new").alias("new")), k, "a", "d", "b")
        best.select("a", "b", "d", "new").write.parquet(path)
        graph = spark.read.schema("a long, b long, d double, new boolean").parquet(path)
        return path, graph, graph.agg(F.sum(F.least("d", F.lit(1e300)))).first()[0] or 0.0

    path, graph, total = stored(first_graph(nodes, n, k).withColumn("new", F.lit(True)))
    if watch:
        watch(0, graph, 0)
    vectors = written(nodes.select("node", F.col("vector").cast("array<float>").alias("vector")), "nn-vectors")
    for at in range(rounds):
        full = F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf"))
        reach = graph.groupBy("a").agg(full.alias("r"))
        known = vectors.join(reach, vectors["node"] == reach["a"], "left").select(F.col("node").alias("a"), F.coalesce("r", F.lit(float("inf"))).alias("r"), "vector")
        found = introduced(meetings(graph, share, most, at).join(known, "a").select("m", "a", "new", "r", "vector"))
        if watch:
            found = written(found, "nn-found")
        # a new neighbour that was drawn has met the others, and is old from now on
        now = graph.select("a", "b", "d", (F.col("new") & ~_drawn(share, at)).alias("new"))
        old, before = path, total
        path, graph, total = stored(now.union(found.select("a", "b", "d", F.lit(True))))
        drop_path(spark, old)
        if watch:
            watch(at + 1, graph, found.agg(F.sum("n")).first()[0] or 0)
        if before - total <= least_gain * before:
            break
    return graph.select("a", "b", "d")


def greedy_search(nodes: DataFrame, graph: DataFrame, starts: DataFrame, beam: int = 192, expand: int = 64, reverse: int = 48, rounds: int = 8) -> DataFrame:
    """starts: q (a node). Returns q, node, d: the nearest nodes found, itself
    left out. Each round expands the `expand` nearest unexpanded nodes of the
    best `beam` of each query, until all of those are expanded. Nodes that fell
    out of the beam may be met again; they fall out again."""
    spark = nodes.sparkSession
    links = written(adjacent(graph, reverse).groupBy("m").agg(F.collect_list("a").alias("near")), "nn-links")
    goal = starts.join(nodes, starts["q"] == nodes["node"]).select("q", F.col("vector").alias("goal"))
    state = starts.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("done"))
    path = ""
    for _ in range(rounds + 1):
        by = Window.partitionBy("q").orderBy("d", "node")
        state = _nearest(state, beam + 1, "q", "d", "node")
        todo = F.sum((~F.col("done")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
        to = new_path(spark, "nn-beam")
        state.withColumn("now", ~F.col("done") & (todo <= expand)).write.parquet(to)
        if path:
            drop_path(spark, path)
        path = to
        beams = spark.read.schema("q long, node long, d double, done boolean, now boolean").parquet(to)
        front = beams.filter("now")
        if front.isEmpty():
            break
        met = front.select("q", "node").join(links, F.col("node") == F.col("m")).select("q", F.explode("near").alias("node"))
        seen = beams.select("q", "node", "d", (F.col("done") | F.col("now")).alias("done")).union(met.select("q", "node", F.lit(None).cast("double"), F.lit(None).cast("boolean")))
        every = seen.repartition("q").groupBy("q", "node").agg(F.max("d").alias("d"), F.max("done").alias("done"))
        new = every.filter("d is null").select("q", "node").join(nodes, "node").join(goal, "q").select("q", "node", distance("vector", "goal").alias("d"), F.lit(False).alias("done"))
        state = beams.select("q", "node", "d", (F.col("done") | F.col("now")).alias("done")).union(new)
    return beams.filter("q != node").select("q", "node", "d")


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = 40) -> DataFrame:
    """query_id, rank, id, score: about the k nearest rows (Euclidean) of each
    row where is_query (on the id column) holds, itself left out; distances are
    exact, equal ones go by id. Every row is indexed, with those of its length:
    vectors of different lengths have no distance."""
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    good = rows.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias(id_col), vector.alias("vector"))
    good = good.filter(F.exists("vector", lambda x: x != 0))
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    for size in sorted(r[0] for r in good.select(F.size("vector")).distinct().collect()):
        found = found.union(_search(good.filter(F.size("vector") == size), is_query, k, id_col, neighbours))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _search(good: DataFrame, is_query: Column, k: int, id_col: str, neighbours: int) -> DataFrame:
    """search() for vectors of one length. Equal vectors are one node; nodes are
    numbered in the order of their smallest ids, so that wherever equal distances
    are cut by node, the smaller ids stay."""
    own = good.withColumn("hash", F.xxhash64("vector"))
    each = own.groupBy("hash").agg(F.any_value("vector").alias("vector"), F.min(id_col).alias("least"))
    dealt = written(each.repartitionByRange("least", "hash").sortWithinPartitions("least", "hash").withColumn("node", F.monotonically_increasing_id()), "nn-nodes")
    nodes = dealt.select("node", "vector")
    own = own.join(dealt.select("hash", "node"), "hash")
    members = written(_nearest(own, k + 1, "node", id_col).select("node", F.col(id_col).alias("id")), "nn-members")
    queries = written(own.filter(is_query).groupBy(F.col(id_col).alias("query_id")).agg(F.min(F.struct("vector", "node")).alias("v")).select("query_id", F.col("v.node").alias("q")), "nn-queries")
    graph = build_graph(nodes, nodes.count(), neighbours)
    found = greedy_search(nodes, graph, queries.select("q").distinct())
    found = _nearest(found, k, "q", "d", "node").union(queries.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d")).distinct())
    answers = queries.join(found, "q").join(members, "node").filter("id != query_id").select("query_id", "id", F.col("d").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return answers.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
