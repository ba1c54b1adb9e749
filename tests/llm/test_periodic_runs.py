import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark.llm.periodic_runs import COVER, MODULUS, CoverSuffixes, find_runs, periodic_runs
from tallymark.llm.queries import op12_periodic_runs

SMALL = "/root/testdata/sf0.001"


def brute(words, least=12):
    """Every period, word by word."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(texts, least=12):
    at, runs = find_runs([np.array(t, np.int64) for t in texts], least)
    return [[tuple(map(int, r)) for r in runs[at == k]] for k in range(len(texts))]


def test_cover_has_every_difference():
    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 120), st.integers(1, 4), st.integers(1, 30), st.integers(0, 2**32)), min_size=1, max_size=4))
def test_runs_are_those_of_brute_force(shapes):
    texts = []
    for n, kinds, p, seed in shapes:
        rng = random.Random(seed)
        text = [rng.randrange(kinds) for _ in range(n)]
        a = rng.randrange(n) if n else 0
        texts.append([text[a + (i - a) % p] if i >= a and a + p <= n else text[i] for i in range(n)])
    assert runs_of(texts) == [brute(t) for t in texts]


def test_common_prefixes_of_the_cover_by_brute_force():
    rng = random.Random(5)
    x = np.array([rng.randrange(2) for _ in range(150)] * 3 + [rng.randrange(2) for _ in range(90)])
    own = CoverSuffixes(x)
    held = [i for i in range(len(x)) if i % MODULUS in COVER]
    pairs = [(i, j) for i in held for j in held if i < j]
    plain = [next((k for k in range(len(x) - j) if x[i + k] != x[j + k]), len(x) - j) for i, j in pairs]
    assert own.lce(*np.array(pairs).T).tolist() == plain


def test_long_texts_of_one_word_and_of_long_periods():
    rng = random.Random(7)
    block = [rng.randrange(10_000) for _ in range(9_000)]
    one, long = [3] * 30_000, block + block + block[:500]
    assert runs_of([one, long]) == [[(0, 30_000, 1)], [(0, 18_500, 9_000)]]


def test_odd_rows(spark):
    run = " ".join(["tick tock"] * 8)
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", None), (None, f"a {run}\x0bb", 6), (4, run, 7), (4, run, 7), (5, "word " * 5000, 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs bigint").withColumn("collapsed", F.lit("x"))
    got = sorted(((r.row.doc_id, r.row.runs, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()), key=str)
    assert got == sorted(
        [(1, 5, 0, [], ""), (2, 5, 0, [], ""), (3, None, 0, [], ""), (None, 6, 18, [(1, 16, 2)], "a tick tock b"), (4, 7, 16, [(0, 16, 2)], "tick tock"), (4, 7, 16, [(0, 16, 2)], "tick tock"), (5, 8, 5000, [(0, 5000, 1)], "word")], key=str
    )
    assert periodic_runs(df.limit(0)).count() == 0


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    lost = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    four = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
    return (doc_id, len(runs), *four, sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in lost)))


def test_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len((r.text or "").split()) <= 1500]
    assert len(short) > 0.8 * len(docs)
    got = op12_periodic_runs(spark, SMALL).collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got) >= 0.05 * len(docs)
    of = {r.doc_id: tuple(r) for r in got}
    for r in short:
        assert of[r.doc_id] == pytest.approx(expected(r.doc_id, r.text))
