import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import nn_descent
from tallymark.llm.common import written
from tallymark.llm.nn_descent import build_graph, greedy_search, pivot_lookup, search
from tallymark.llm.queries import op10_nn_descent

LARGER = "/root/testdata/sf0.1"


def brute(ids, x, queries, k):
    found = {}
    for q in queries:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        found[q] = [(float(d[j]), int(ids[j])) for j in sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (d[j], ids[j]))[:k]]
    return found


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = found.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.score, r[2]))
    return found


def test_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{LARGER}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    expected = brute(ids, x, [i for i in ids.tolist() if i % 100 == 0], 10)
    found = answers(op10_nn_descent(spark, LARGER))
    assert found.keys() == expected.keys() and all(len(v) == 10 for v in found.values())
    assert sum(len({i for _, i in found[q]} & {i for _, i in expected[q]}) for q in expected) / (10 * len(expected)) >= 0.95
    place = {i: n for n, i in enumerate(ids.tolist())}
    for q, own in found.items():
        for score, i in own:
            assert abs(score - float(np.sqrt(((x[place[q]] - x[place[i]]) ** 2).sum()))) < 1e-12


def test_groups_of_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6))
    x[50:250] = x[50]
    ids = rng.permutation(400) + 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<double>")
    queries = [int(i) for i in ids if i % 20 == 0]
    found = answers(search(df, F.col("vec_id") % 20 == 0, 10))
    expected = brute(ids, x, queries, 10)
    for q in queries:
        assert [round(s, 9) for s, _ in found[q]] == [round(s, 9) for s, _ in expected[q]]
        assert [i for s, i in found[q] if s == 0] == [i for s, i in expected[q] if s == 0]


def test_edge_cases(spark):
    nan = float("nan")
    rows = [(100, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, 0.5]), (6, [1.0]), (7, [2.0, 0.0]), (7, [3.0, 0.0]), (None, [1.0, 0.1]), (200, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    found = answers(search(df, F.col("vec_id") % 100 == 0, 10))
    assert found[100] == [(0.5, 5), (1.0, 7), (2.0, 7), (2.0, 200)]
    assert [i for _, i in found[200]] == [100, 5, 7, 7]
    assert search(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
    alone = df.filter("vec_id = 100")
    assert search(alone, F.col("vec_id") % 100 == 0, 10).count() == 0


def test_the_descent_finds_what_the_start_does_not(spark):
    """20,000 vectors: the start knows few neighbours, the rounds find them, with
    a small share of all distances, and the search over the graph finds the rest."""
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((20_000, 15)) @ rng.standard_normal((15, 40)) + 0.1 * rng.standard_normal((20_000, 40))).astype(np.float32).astype(float)
    ids = np.arange(len(x))
    nodes = written(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "node bigint, vector array<double>"), "test-nodes")
    queries = ids[::200].tolist()
    expected = {q: {i for _, i in own} for q, own in brute(ids, x, queries, 10).items()}
    recall, distances = [], 0

    def share(rows):
        near = {}
        for a, b in rows:
            near.setdefault(a, []).append(b)
        return sum(len(set(near.get(q, [])[:10]) & expected[q]) for q in queries) / (10 * len(queries))

    def watch(at, graph, made):
        nonlocal distances
        distances += made
        recall.append(share([(r.a, r.b) for r in graph.filter(F.col("a").isin(queries)).orderBy("d").collect()]))

    graph = build_graph(nodes, len(ids), k=20, most=40, rounds=8, watch=watch)
    found = greedy_search(nodes, graph, spark.createDataFrame([(q,) for q in queries], "q bigint"), beam=64, expand=16)
    searched = share([(r.q, r.node) for r in found.orderBy("d", "node").collect()])
    print(f"recall by round {recall}, of the search {searched}; distances {distances / (len(ids) ** 2 / 2):.3f} of all pairs")
    assert recall[0] < 0.7 and recall[-1] >= 0.9 and searched >= 0.95 and distances < 0.2 * len(ids) ** 2 / 2


def test_pivots_by_groups_are_nearly_the_nearest(monkeypatch):
    rng = np.random.default_rng(3)
    centre, x = (rng.standard_normal((n, 8)).astype(np.float32) for n in (900, 400))
    exact = pivot_lookup(centre, 2)(x)
    assert (exact[:, 0] == [((centre - v) ** 2).sum(axis=1).argmin() for v in x]).all()
    monkeypatch.setattr(nn_descent, "FLAT", 100)
    found = pivot_lookup(centre, 2)(x)
    assert (found[:, 0] != found[:, 1]).all() and (found == exact).mean() > 0.9


def test_equal_distances_are_cut_by_id(spark):
    """Twenty-four vectors, each in a dimension of its own, at the same distance from the query."""
    rng = np.random.default_rng(2)
    ids = rng.permutation(np.arange(1, 25)).tolist()
    rows = [(100, [1.0] + [0.0] * 24)] + [(i, [1.0] + [float(k == n) for k in range(24)]) for n, i in enumerate(ids)]
    rows += [(1000 + i, [50.0 + i] + [0.0] * 24) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert answers(search(df, F.col("vec_id") == 100, 10))[100] == [(1.0, i) for i in range(1, 11)]


def test_every_length_is_served(spark):
    rows = [(k, [float(k), 1.0]) for k in range(100, 140)] + [(k, [float(k), 1.0, 2.0]) for k in range(200, 203)] + [(300, [5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = answers(search(df, F.col("vec_id") % 100 == 0, 3))
    assert found == {100: [(1.0, 101), (2.0, 102), (3.0, 103)], 200: [(1.0, 201), (2.0, 202)]}
