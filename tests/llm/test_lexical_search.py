import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import lexical_search
from tallymark.llm.lexical_search import search
from tallymark.llm.queries import op13_lexical_search

SMALL = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """docs: (id, text). items: (id, text), ids once. (item, rank, doc, score)."""
    held = [(i, Counter(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_docs, block_terms", [(1 << 15, 1 << 17), (7, 40)])
def test_whole_table_by_brute_force(spark, shard_docs, block_terms):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert result(search(docs, items, shard_docs=shard_docs, block_terms=block_terms)) == want
    if shard_docs > 7:
        assert result(op13_lexical_search(spark, SMALL).select("item_id", "rank", "doc_id", "score")) == want


def test_odd_rows(spark):
    docs = [(3, "Alpha beta"), (1, "alpha BETA"), (1, "alpha BETA"), (None, "alpha, beta!"), (2, None), (4, ""), (5, "--- ..."), (6, "gamma élan Élan 42 " * 9000), (7, "delta")]
    items = [(1, "alpha"), (2, None), (3, ""), (4, "GAMMA 42 élan gamma"), (None, "delta"), (5, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).withColumn("item_id", F.lit(9))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    assert result(search(d, i, 3)) == brute(docs, items, 3)
    # rows of one item are one item
    twice = spark.createDataFrame([(1, "alpha"), (1, "delta alpha")], "item_id bigint, text string")
    assert result(search(d, twice, 9)) == brute(docs, [(1, "alpha delta")], 9)
    assert search(d.limit(0), i).count() == 0 and search(d, i.limit(0)).count() == 0


def test_accumulators_stop_and_scores_stay_exact():
    """Two rare terms settle the best two; the frequent one creates nothing more."""
    rng = np.random.default_rng(3)
    n = np.full(400, 20)
    docs = [[0, 1]] * 3 + [[]] * 397
    held = [sorted({*own, 2}) for own in docs]
    counts = np.array([len(h) for h in held])
    flat, tf = np.concatenate(held), rng.integers(1, 3, counts.sum())
    shard = lexical_search.Shard(n, counts, flat, tf, np.array([4000, 3900, 5]), 400, 8000)
    plain, seen = np.partition, []
    lexical_search.np.partition = lambda x, k: seen.append(len(x)) or plain(x, k)
    try:
        found, scores = shard.best(np.array([0, 1, 2]), 2)
    finally:
        lexical_search.np.partition = plain
    exact = np.zeros(400, np.int64)
    for t in range(3):
        own = slice(shard.ends[t], shard.ends[t + 1])
        exact[shard.doc[own]] += shard.share[own]
    assert max(seen) == 3 and sorted(scores)[-2:] == sorted(exact)[-2:] and (exact[found] == scores).all()
    assert not shard.score.any()  # ready for the next item
