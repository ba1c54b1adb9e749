import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm.topk_search import best, resolutions, search, segments, usable


def brute(rows, is_query, k):
    out = []
    for q, x in rows:
        if is_query(q):
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q and len(y) == len(x))
            out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scores[:k])]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in df.collect())


def test_bounds_hold_at_each_resolution():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 19, 64):
        q, x = rng.integers(-20, 20, (30, size)).astype(float), rng.integers(-20, 20, (40, size)).astype(float)
        before = None
        for cut in resolutions(size):
            assert [c.start for c in cut] + [size] == [0] + [c.stop for c in cut]
            high = segments(q, cut) @ segments(x, cut).T
            assert (high >= q @ x.T - 1e-9).all()
            assert before is None or high.mean() <= before + 1e-9
            before = high.mean()


def exact(x, ids, n, k):
    full = x @ x[n]
    order = sorted((m for m in range(len(x)) if ids[m] != ids[n]), key=lambda m: (-full[m], ids[m]))[:k]
    return [(full[m], ids[m]) for m in order]


@pytest.mark.parametrize("clustered", [True, False])
def test_few_pairs_are_scored_where_vectors_cluster(clustered):
    """On 40 clusters in 64 dimensions, the bounds spare most pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 64)) * 400 * clustered
    x = np.rint(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 64)) * 60)
    ids = rng.permutation(6000)
    i, j, score, scored = best(x[:40], ids[:40], x, ids, 20, step=512)
    for n in range(40):
        own = [(score[m], ids[j[m]]) for m in range(len(i)) if i[m] == n]
        assert sorted(own, key=lambda t: (-t[0], t[1])) == exact(x, ids, n, 20)
    print(f"clustered {clustered}: {scored / (40 * 6000):.3f} of all pairs scored")
    assert not clustered or scored < 0.5 * 40 * 6000
    # a first limit spares more, and changes nothing
    first = np.array([exact(x, ids, n, 20)[-1][0] for n in range(40)])
    again = best(x[:40], ids[:40], x, ids, 20, first, step=512)
    assert sorted(zip(again[0], again[1], again[2], strict=True)) == sorted(zip(i, j, score, strict=True)) 
    assert not clustered or again[3] < 0.05 * 40 * 6000


def test_scores_beyond_doubles_are_exact(spark):
    big = [2**27 + 1, 2**27 + 3, 2**27 - 1, -(2**27) + 5]
    rows = [(n, [float(big[n % 4] + 2 * n), float(big[(n + 1) % 4]), float(n)]) for n in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = [(i, [int(v) for v in x]) for i, x in rows]
    assert result(search(df, F.col("vec_id") % 20 == 0, 20, candidate_block=16)) == brute(whole, lambda q: q % 20 == 0, 20)
    with pytest.raises(Exception, match="63 bits"):
        search(df.withColumn("embedding", F.transform("embedding", lambda v: v * 2.0**20)), F.col("vec_id") % 20 == 0, 3).collect()


def test_blocks_and_ties_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(n), [float(v) for v in rng.integers(-2, 3, 8)]) for n in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = search(df, F.col("vec_id") % 20 == 0, 20, query_block=7, candidate_block=64)
    assert result(found) == brute(rows, lambda q: q % 20 == 0, 20)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (5, [2.0, 2.0]), (5, [2.0, 2.0]), (6, [1.0, 1.0, 1.0]), (20, [0.0, 0.0]), (None, [9.0, 9.0]), (40, [])]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "vec_id bigint, embedding array<double>, query_id string, rank int")
    assert [r.vec_id for r in df.filter(usable(F.col("embedding"))).orderBy("vec_id").collect()] == [None, 0, 5, 5, 6, 20]
    found = result(search(df, F.col("vec_id") % 20 == 0, 3))
    assert found == [(0, 1, 5, 6.0), (0, 2, 5, 6.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 5, 0.0), (20, 3, 5, 0.0)]
    assert search(df.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0
    repeated = df.union(df.filter("vec_id = 0"))
    assert [t for t in result(search(repeated, F.col("vec_id") == 0, 3))] == [(0, 1, 5, 6.0), (0, 2, 5, 6.0), (0, 3, 20, 0.0)]
