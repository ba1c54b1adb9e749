import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm.components import connected_components
from tallymark.llm.queries import op7_simhash_dedup
from tallymark.llm.simhash_dedup import ALL_MEET, LANES, _Sharing, bits_for, fingerprint, fingerprints, keep_similar, links, near_duplicates, parities, shared, shingle_hashes, similar_links, unlinked, wide_variants

SMALL = "/root/testdata/sf0.01"


def plain(text):
    words, now = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words, now = (words + [now] if now else words), ""
        else:
            now += c
    words = words + [now] if now else words
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = Counter()
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(fps):
    return [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]


def test_fingerprints():
    for text in ("", None, "one", "one two", "ONE two Three", "a b c d e", " a\x0bb\x1cc d e ", "É é ß " * 9, "x y " * 500):
        assert fingerprint(text) % 2**64 == plain(text), text


def test_chunks_make_no_difference(monkeypatch):
    from tallymark.llm import simhash_dedup

    text = " ".join(f"w{i * i % 97}" for i in range(400))
    whole = fingerprint(text)
    monkeypatch.setattr(simhash_dedup, "CHUNK", 7)
    assert fingerprint(text) == whole == plain(text) - (plain(text) >> 63 << 64)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    pairs += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)]
    df = spark.createDataFrame(pairs, "x bigint, y bigint")
    nodes = {n for a, b in pairs for n in (a, b) if a != b}
    found = {r.node: r.root for r in connected_components(df, "x", "y").collect()}
    assert found == components([p for p in pairs if p[0] != p[1]], nodes)
    assert connected_components(df.limit(0), "x", "y").count() == 0


def near_fingerprints(seed):
    """Clusters with hot halves: members differ from a centre by a few bits, some in one half alone."""
    rng = random.Random(seed)
    found = {0, 1, 3, -1, -2, -(2**63), 2**63 - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            own, low = centre, rng.random() < 0.5
            for _ in range(rng.choice((0, 1, 2, 2, 3, 4, 6))):
                own ^= 1 << rng.randrange(32 if low else 64)
            found.add(own - (own >> 63 << 64))
    return sorted(found | {rng.getrandbits(64) - 2**63 for _ in range(80)})


def test_links_lose_no_component(spark):
    fps = near_fingerprints(2)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    expected = components(linked(fps), fps)
    for most in (2, 5, 1000):  # nearly all variants hot, some, none
        pairs = [tuple(r) for r in links(df, most).collect()]
        assert components(pairs, fps) == expected
    assert set(pairs) == set(linked(fps))  # without hot variants, the links themselves


def test_whole_table_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    fps = {i: plain(t) for i, t in docs.items()}
    first = {}
    for i in sorted(fps):
        first.setdefault(fps[i], i)
    root = components([(a, b) for a, b in linked(sorted(first))], list(first))
    least = {}
    for f, r in root.items():
        least[r] = min(least.get(r, first[f]), first[f])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash_dedup(spark, SMALL).collect()}
    assert found == {i: (f"{f:016x}", least[root[f]]) for i, f in fps.items()}


def test_edge_cases(spark):
    rows = [(5, None, 1), (3, "", 1), (None, " \n", 1), (9, "a b c d", 1), (7, "A  b\tc d", 1), (7, "A  b\tc d", 1), (1, "z " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component int")
    found = near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component) for r in found) == [("1", 1), ("3", 3), ("5", 3), ("7", 7), ("7", 7), ("9", 7), ("None", 3)]
    assert {r.fp for r in found if r.component == 3} == {0}
    assert near_duplicates(df.limit(0)).count() == 0
    assert fingerprints(df.filter(F.col("doc_id") == 3)).first().fp == 0


def test_one_row_of_each_group_whatever_the_ids(spark):
    rows = [(5, None), (None, ""), (None, " "), (1, "a b c d"), (7, "A b c d"), (7, "the only one of its kind"), (8, "e f g h"), (8, "e f g h"), (None, "i j k l"), (None, "i j k l"), (None, "m n o p")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = [tuple(r) for r in keep_similar(df).collect()]
    expected = [(5, None), (1, "a b c d"), (7, "the only one of its kind"), (8, "e f g h"), (None, "i j k l"), (None, "m n o p")]
    assert Counter(found) == Counter(expected) and keep_similar(df).columns == df.columns
    assert keep_similar(df.limit(0)).count() == 0


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""}


def edited(words, rate, rng):
    return " ".join(rng.choice(["zeta", "quux", "mira"]) + str(rng.randrange(99)) if rng.random() < rate else w for w in words)


@pytest.mark.parametrize("group", [3, 150])
def test_similar_texts_leave_one(spark, group):
    """Groups of edited copies, small ones and large, among texts of their own."""
    rng = random.Random(group)
    texts, of = [], []
    for g in range(600 // group):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 500))]
        for _ in range(group):
            texts.append(edited(base, 0.005, rng))
            of.append(g)
    for _ in range(300):
        texts.append(" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(5, 300))))
        of.append(None)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in keep_similar(df).collect())
    assert {i for i, g in enumerate(of) if g is None} <= set(kept)  # texts of their own all stay
    sets = [shingles(t) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    left = [i for i in kept if of[i] is not None]
    assert all(any(i < j and of[i] == of[j] for i in left) for j in range(len(texts)) if of[j] is not None and j not in left)
    assert not [(i, j) for i in left for j in left if i < j and of[i] == of[j] and alike(i, j) >= 0.85]


def test_recall_of_similar_pairs_in_the_table(spark):
    """Of the pairs of texts of sf0.1 with a similarity of 0.8 or more, by brute
    force over shared shingles, nearly all leave one text."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter(p for own in holders.values() if len(own) <= 50 for p in itertools.combinations(own, 2))
    pairs = [p for p, n in shared.items() if texts[p[0]] != texts[p[1]] and len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    kept = {r.doc_id for r in keep_similar(docs).collect()}
    missed = [p for p in pairs if p[0] in kept and p[1] in kept]
    print(f"similar pairs: {len(pairs)}, both kept: {len(missed)}")
    assert len(pairs) > 20 and len(missed) <= 0.1 * len(pairs)
    gone = [i for i in texts if i not in kept and texts[i] not in {texts[j] for j in texts if j < i}]
    # whoever went has a similar text that stays, or that went for another
    assert {i for i in gone if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in {k for x in sets[i] for k in holders[x]} - {i})} == set()


def test_who_meets_whom_over_batches():
    """Runs of equal variants, cut into batches anywhere."""
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.int64)
    for most in (1, 3, 12, 40):
        for _ in range(40):
            sizes = rng.integers(1, most + 1, rng.integers(0, 20))
            key = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
            node, own, rows, at = rng.permutation(10**6)[: len(key)].astype(np.int64), _Sharing(64), [], 0
            while at < len(key):
                n = int(rng.integers(1, 25))
                rows += own.rows(key[at : at + n], node[at : at + n]).to_pylist()
                at += n
            rows += own.rows(none, none, end=True).to_pylist()
            want = []
            for g in range(len(sizes)):
                all_of = node[key == g].tolist()
                large = len(all_of) > ALL_MEET
                for i, x in enumerate(all_of):
                    others = set(all_of[:1] if large and i else [] if large else all_of[:i])
                    want += [(g, x, others, large)] * (len(all_of) > 1)
            assert [(r["variant"], r["node"], set(r["others"]), r["large"]) for r in rows] == want


def test_what_nodes_share(spark):
    """Small variants, a large one, one of a single node, and nodes that are too far apart."""
    rows = [(1, n) for n in range(1, 4)] + [(2, n) for n in range(100)] + [(3, 7), (4, 0), (4, -1)]
    found = {r.node: r for r in shared(spark.createDataFrame(rows, "variant bigint, node bigint"), 30).collect()}
    assert set(found) == {-1, *range(100)} and sorted(found[2].variants) == [1, 2] and found[2].large == [2] and found[7].variants == [2]
    assert sum(len(found[n].few) for n in (1, 2, 3)) == 3 and not found[-1].few and not found[0].few
    assert all(len(found[n].centres) <= 3 for n in found) and sum(1 for n in range(100) if not found[n].centres) <= 4
    assert shared(spark.createDataFrame([], "variant bigint, node bigint"), 30).count() == 0


def test_similar_nodes_of_a_large_variant_are_all_linked(spark):
    """Thirty pairs of similar texts, all in the same large variants and in no small ones."""
    rng = random.Random(5)
    nodes, texts = [], []
    for i in range(60):
        lane = sum(1 << 20 * s + bit for s in range(3) for bit in rng.sample(range(20), 3))
        texts.append((i, " ".join(f"w{i // 2}x{k}" for k in range(34))))
        nodes.append((lane, [lane, 0, 0, 0, 0], 30, parities(np.concatenate(list(shingle_hashes(texts[-1][1], 5)))), i))
    df = spark.createDataFrame(nodes, "node bigint, w array<bigint>, n bigint, p array<bigint>, tie bigint")
    found = {tuple(sorted(r)) for r in similar_links(df, spark.createDataFrame(texts, "tie bigint, body string"), 5, 0.8).collect()}
    assert found == {tuple(sorted((nodes[i][0], nodes[i + 1][0]))) for i in range(0, 60, 2)}


def test_parities_never_part_similar_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 90, 3000):
        for alone in (0, 1, 7, 60):
            x = rng.integers(0, 2**63, n + alone).astype(np.uint64)
            a, b = x[: n + alone // 2], np.concatenate((x[:n], x[n + alone // 2 :]))
            differ = sum((p ^ q).bit_count() if p ^ q >= 0 else ((p ^ q) + 2**64).bit_count() for p, q in zip(parities(a), parities(b), strict=True))
            assert differ <= alone and (alone != 1 or differ == 1)


def test_nodes_that_only_share_a_segment_dont_go_on(spark):
    """First lanes that are near by chance, in small variants and in large ones: only nodes near in all lanes meet."""
    rng = random.Random(8)
    long = lambda: rng.getrandbits(64) - 2**63
    base, nodes = [long() for _ in range(5)], []
    for i in range(5):  # their first lanes differ by 2 bits of the last segment
        w = [base[0] ^ 1 << 40 + i, *(long() for _ in range(LANES - 1))]
        nodes.append((w[0], w, 100))
    alike = [long() for _ in range(LANES)]
    nodes += [(w[0], w, 100) for w in (alike, [x ^ 8 for x in alike])]
    variants = wide_variants(spark.createDataFrame(nodes, "node bigint, w array<bigint>, n bigint"), 0.8)
    found = {r.node: r for r in shared(variants, bits_for(0.8, 64, 4), 0, bits_for(0.8, 64 * LANES, 4)).collect()}
    assert set(found) == {alike[0], alike[0] ^ 8} and all(r.variants and not r.large for r in found.values())
    assert sorted(len(r.few) for r in found.values()) == [0, 1]


def test_lanes_are_compared_over_batches():
    rng = np.random.default_rng(4)
    none = np.zeros(0, np.int64)
    for most in (2, 9, 30):
        for _ in range(30):
            sizes = rng.integers(1, most + 1, rng.integers(1, 12))
            key = np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)
            node, kind = rng.permutation(256)[: len(key)] if len(key) <= 256 else rng.integers(0, 256, len(key)), rng.integers(0, 2, len(key))
            node, lanes, own, rows, at = node.astype(np.int64), np.repeat(-kind[:, None], LANES - 1, axis=1).astype(np.int64), _Sharing(64, 64), [], 0
            while at < len(key):
                n = int(rng.integers(1, 20))
                rows += own.rows(key[at : at + n], node[at : at + n], lanes[at : at + n]).to_pylist()
                at += n
            rows += own.rows(none, none, end=True).to_pylist()
            want = []
            for g in range(len(sizes)):
                its, kinds = node[key == g].tolist(), kind[key == g].tolist()
                large = len(its) > ALL_MEET
                for i, x in enumerate(its):
                    others = {y for j, y in enumerate(its) if (j == 0 < i and y != x if large else j < i) and kinds[j] == kinds[i]}
                    if large or kinds.count(kinds[i]) > 1:
                        want.append((g, x, others, large, True))
            assert [(r["variant"], r["node"], set(r["others"]), r["large"], r["near"]) for r in rows] == want


def test_the_last_pass_loses_no_pair(spark):
    """Nodes of a few groups with segments that are equal or differ by a bit, against all pairs."""
    rng = random.Random(12)
    segments, rows = [rng.getrandbits(20) for _ in range(3)], {}
    for _ in range(60):
        own = [s ^ rng.choice((0, 0, 1 << rng.randrange(20), 1 << rng.randrange(20) | 1 << rng.randrange(20))) for s in segments]
        lane = sum(s << 20 * k for k, s in enumerate(own))
        rows[lane] = (lane, rng.choice((1, 1, 1, 2, 3)), [lane, *(rng.getrandbits(64) - 2**63 for _ in range(LANES - 1))], 100, [0] * 4)
    df = spark.createDataFrame(list(rows.values()), 'node bigint, "group" bigint, w array<bigint>, n bigint, p array<bigint>'.replace('"', "`"))
    own = df.join(wide_variants(df, 0.8).groupBy("node").agg(F.collect_list("variant").alias("variants")), "node")
    found = [tuple(r) for r in unlinked(own, 3, 0.8).collect()]
    cut = lambda x: [x >> 20 * k & (1 << 20) - 1 for k in range(3)]
    want = {(a, b) for a in rows for b in rows if a < b and rows[a][1] != rows[b][1] and (a ^ b).bit_count() <= 3 and any((x ^ y).bit_count() <= 1 for x, y in zip(cut(a), cut(b), strict=True))}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 50
