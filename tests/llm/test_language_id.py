import functools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import language_id
from tallymark.llm.common import crc_mod
from tallymark.llm.language_id import ORDER, Model, Tree, _buffer, _end, fit, grams, identify
from tallymark.llm.queries import op4_language_id

SMALL, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


class Plain:
    """The same coder, byte by byte over dictionaries of counts, with explicit sets of excluded bytes."""

    def __init__(self, texts):
        self.after = {}
        for text in texts:
            data = b" " * ORDER + text.encode()
            for i in range(ORDER, len(data)):
                for k in range(ORDER + 1):
                    own = self.after.setdefault(data[i - k : i], {})
                    own[data[i]] = own.get(data[i], 0) + 1

    @functools.cache
    def bits(self, context, byte):
        gone, bits = set(), 0.0
        for k in range(len(context), -1, -1):
            seen = {b: n for b, n in self.after.get(context[len(context) - k :], {}).items() if b not in gone}
            if not seen:
                continue
            escapes = len(seen) if len(gone) + len(seen) < 256 else 0
            if byte in seen:
                return bits + math.log2((sum(seen.values()) + escapes) / seen[byte])
            bits += math.log2((sum(seen.values()) + escapes) / escapes)
            gone |= set(seen)
        return bits + math.log2(256 - len(gone))

    def length(self, text):
        data = b" " * ORDER + text.encode()
        return sum(self.bits(data[i - ORDER : i], data[i]) for i in range(ORDER, len(data)))


def fitted(by_lang):
    """Model of texts without Spark."""
    found = [([], [], []) for _ in range(ORDER + 1)]
    for lang, texts in by_lang.items():
        for k in range(ORDER + 1):
            ends = np.concatenate([_end(grams(*_buffer(pa.array([t])), 0, len(t.encode())), k + 1) for t in texts])
            gram, n = np.unique(ends, return_counts=True)
            for own, more in zip(found[k], ([lang] * len(gram), gram, n), strict=True):
                own.extend(more)
    return Model.fitted([(np.array(a, object), np.array(b, np.uint64), np.array(c)) for a, b, c in found])


ODD = bytes(range(1, 128)).decode() + "".join(map(chr, range(128, 1200, 7)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_code_lengths_equal_the_plain_coder(seed, monkeypatch):
    rng = random.Random(seed)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    by_lang = {"a": [text("ab c", 300), text("abc", 80)], "b": [text("ab\n", 200), ODD], "c": ["x"]}
    model, plain = fitted(by_lang), {k: Plain(v) for k, v in by_lang.items()}
    texts = ["", "a", text("abcd ", 200), None, "été ñ", "q" * 100, "", ODD, text("ab", 40)]
    for chunk in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        for column in (pa.array(texts), pa.array(["zz", *texts])[1:], pa.array(texts, pa.large_string())):
            found = model.lengths(*_buffer(column))
            assert found == pytest.approx(np.array([[plain[k].length(t or "") for k in model.langs] for t in texts]), abs=1e-6)


def test_probabilities_add_up():
    rng = random.Random(9)
    model = fitted({"a": ["".join(rng.choice("abcde f") for _ in range(900)), ODD]})
    for context in (b"abcd", b"zzzz", b" a b", bytes([195, 169, 32, 97])):
        head = int.from_bytes(context, "big") << 8
        bits = model.trees[0].lengths(np.array([head | b for b in range(256)], np.uint64))
        assert np.exp2(-bits).sum() == pytest.approx(1)


def test_pruned_trees_still_add_up():
    """Where frequent grams alone are kept, longer contexts only have bytes that shorter ones have."""
    rng = random.Random(4)
    data = "".join(rng.choice("abcdefgh") for _ in range(4000))
    counts = []
    for k in range(ORDER + 1):
        gram, n = np.unique(_end(grams(*_buffer(pa.array([data])), 0, len(data)), k + 1), return_counts=True)
        kept = np.sort(np.argsort(-n, kind="stable")[: 60 // (k + 1)])
        counts.append((gram[kept], n[kept].astype(float)))
    tree = Tree(counts)
    for context in ("abcd", "aaaa", "hgfe"):
        head = int.from_bytes(context.encode(), "big") << 8
        assert np.exp2(-tree.lengths(np.array([head | b for b in range(256)], np.uint64))).sum() == pytest.approx(1)


def test_whole_query_against_the_plain_coder(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    learned = [r for r in docs.values() if zlib.crc32(str(r.doc_id).encode()) % 5]
    langs = sorted({r.lang for r in learned if r.lang})
    plain = {k: Plain([r.text for r in learned if r.lang == k]) for k in langs}
    for r in op4_language_id(spark, "/root/testdata/sf0.001").collect():
        bits = [plain[k].length(docs[r.doc_id].text) for k in langs]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.lang_pred == langs[bits.index(min(bits))]
        assert r.score == pytest.approx(1 / sum(2 ** max(min(bits) - b, -1000) for b in bits), abs=1e-6)


def test_languages_of_other_scripts(spark):
    rng = random.Random(5)
    words = {"ru": ["дом", "река", "письмо", "вода"], "bg": ["къща", "реката", "писмото", "водата"], "zh": ["你好", "世界", "河流"], "en": ["house", "river", "letter"]}
    rows = [(i, " ".join(rng.choices(words[k], k=12)), k) for i, k in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = identify(df, fit(df, F.col("doc_id") % 8 < 4)).collect()
    assert all(r.lang_pred == r.row.lang for r in found)


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op4_language_id(spark, LARGER).collect()
    assert {r.doc_id for r in rows} == lang.keys() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 1500 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98


def test_predictions_dont_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit(docs, crc_mod("doc_id", 5) != 0)
    rows = lambda df: sorted((r.row.doc_id, r.lang_pred, r.score) for r in identify(df, model).select("row", "lang_pred", "score").collect())
    assert rows(docs) == rows(docs.repartition(13))


def test_edge_cases(spark):
    rows = [(1, "the cat and the hat", "en", "x"), (2, "der Hund und die Katze", "de", "y"), (3, None, "en", None), (4, "12 34 !?", "en", "z"), (5, "", None, "z"), (None, "the", "en", "z"), (6, "é", None, "z"), (7, "the the " * 40_000, "en", "z"), (7, "the the " * 40_000, "en", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    model = fit(df, crc_mod("doc_id", 5) >= 0)
    assert model.langs == ["de", "en"]
    found = {(r.row.doc_id, r.row.lang_pred): (r.lang_pred, r.score) for r in identify(df, model).collect()}
    assert found[1, "x"][0] == "en" and found[2, "y"][0] == "de" and found[7, "z"][0] == "en" and found[6, "z"][0] in ("de", "en")
    assert found[3, None] == found[4, "z"] == found[5, "z"] == ("und", 0.0) and identify(df, model).count() == 9
    assert fit(df.limit(0), crc_mod("doc_id", 5) >= 0) is None and identify(df.limit(0), model).count() == 0
    assert {(r.lang_pred, r.score) for r in identify(df, None).collect()} == {("und", 0.0)}
