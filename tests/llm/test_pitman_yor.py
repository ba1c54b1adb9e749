import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm.pitman_yor import Dishes, Pairs, score_texts
from tallymark.llm.queries import op11_pitman_yor

SMALL = "/root/testdata/sf0.001"


def seats(c, base, strength, discount, n, moves, seed=1):
    """Tables of one dish in n restaurants of their own."""
    dishes = Dishes(np.full(n, c), np.full(n, base), np.arange(n), np.zeros(n, np.int64), discount, strength, np.random.default_rng(seed))
    assert (np.add.reduceat(dishes.sizes, np.cumsum(dishes.own) - dishes.own) == c).all() and (dishes.sizes > 0).all()
    for _ in range(moves):
        dishes.move()
    assert len(dishes.sizes) == dishes.own.sum() and (dishes.total == dishes.own).all()
    assert (np.add.reduceat(dishes.sizes, np.cumsum(dishes.own) - dishes.own) == c).all() and (dishes.sizes > 0).all()
    return np.bincount(dishes.own, minlength=c + 1)[1:] / n


def by_arrival(c, base, strength, discount):
    """The law of the tables when c customers are seated one after the other."""
    p = {1: 1.0}
    for n in range(1, c):
        q = Counter()
        for t, x in p.items():
            fresh = (strength + discount * t) * base
            q[t + 1] += x * fresh / (fresh + n - discount * t)
            q[t] += x * (n - discount * t) / (fresh + n - discount * t)
        p = q
    return np.array([p[t] for t in range(1, c + 1)])


def posterior(c, base, strength, discount):
    """The law of the tables given that all c customers have the dish."""
    ways = {(1, 1): 1.0}  # generalised Stirling numbers
    for n in range(1, c):
        for t in range(1, n + 2):
            ways[n + 1, t] = ways.get((n, t - 1), 0) + (n - discount * t) * ways.get((n, t), 0)
    w = np.array([ways[c, t] * math.prod(strength + discount * k for k in range(1, t)) * base**t for t in range(1, c + 1)])
    return w / w.sum()


@pytest.mark.parametrize("c, base", [(2, 0.5), (6, 0.3), (12, 0.05)])
def test_seats_follow_their_laws(c, base):
    assert seats(c, base, 1.5, 0.6, 60_000, 0) == pytest.approx(by_arrival(c, base, 1.5, 0.6), abs=0.01)
    assert seats(c, base, 1.5, 0.6, 30_000, 20 * c) == pytest.approx(posterior(c, base, 1.5, 0.6), abs=0.015)


def test_many_customers_cost_their_tables_only():
    law = Dishes(np.full(50, 10**12), np.full(50, 1e-3), np.arange(50), np.zeros(50, np.int64), 0.5, 1.0, np.random.default_rng(2))
    assert law.own.max() < 10_000 and law.sizes.sum() == 50 * 10**12


def scored(spark, rows, learn, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    return {(r.row.doc_id, r.row.score): r for r in score_texts(df, learn, **more).collect()}


def test_closed_form_where_every_pair_is_single(spark):
    """Five words once each: every dish and word has one table."""
    d, s, words, tokens = 0.95, 1.0, 6, 6
    parent = {True: ((1 - d) + (s + d * words) / (words + 1)) / (s + tokens), False: ((s + d * words) / (words + 1)) / (s + tokens)}
    p = lambda seen, known, ctx: ((1 - d) * seen + (s + d) * parent[known]) / (s + 1) if ctx else parent[known]
    rows = [(1, "A b c d e"), (2, "a c"), (3, "new b"), (4, None), (5, " \n")]
    for part_tokens in (2_500_000, 3):
        got = scored(spark, rows, F.col("doc_id") == 1, part_tokens=part_tokens)
        want = {
            1: [p(1, True, True)] * 6,
            2: [p(1, True, True), p(0, True, True), p(0, True, True)],
            3: [p(0, False, True), p(0, True, False), p(0, True, True)],
            4: [p(0, True, True)],
            5: [p(0, True, True)],
        }
        for (i, _), r in got.items():
            assert r.score == pytest.approx(sum(map(math.log10, want[i])), rel=1e-5)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(want[i]), len(want[i]) - (i == 3), 6)


def test_odd_rows(spark):
    rows = [(1, "one two one two"), (1, "one two one two"), (None, "two one"), (2, None), (3, ""), (4, "word other " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = score_texts(df, F.col("doc_id") != 2).collect()  # the null id doesn't learn
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 5, 5, 60_001] and {r.train_tokens for r in got} == {60_012}
    assert len({r.score for r in got if r.row.doc_id == 1}) == 1 and all(r.score < 0 for r in got)
    assert all(r.score == r.base_score == 0 for r in score_texts(df, F.lit(False)).collect())
    assert score_texts(df.limit(0), F.lit(True)).count() == 0


def test_query_by_plain_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b" "] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n = sum(c.values())
    got = {r.doc_id: r for r in op11_pitman_yor(spark, SMALL).collect()}
    assert got.keys() == tokens.keys()
    for i, own in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(w in c for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in own))
    for side in (True, False):
        of = [got[i] for i in tokens if held[i] == side]
        assert sum(r.score for r in of) / sum(r.n_tokens for r in of) > sum(r.base_score for r in of) / sum(r.n_tokens for r in of) + 0.1


def test_pairs_too_long_for_one_number(monkeypatch):
    rng = np.random.default_rng(4)
    numbers = {b" ": 0} | {b"w%d" % k: k for k in range(1, 40)}
    tokens, texts = rng.integers(0, 40, 500).astype(np.uint32), np.repeat(np.arange(50, dtype=np.uint16), 10)
    hot = np.sort(Pairs(numbers, tokens, texts).h[:3])
    short = Pairs(numbers, tokens, texts)
    monkeypatch.setattr(Pairs, "ROOM", 0)
    long = Pairs(numbers, tokens, texts)
    assert short.three is None and long.key is None
    assert all((a == b).all() for a, b in zip(short.at(slice(None)), long.at(slice(None)), strict=True))
    assert (short.parts(hot, 7) == long.parts(hot, 7)).all()
