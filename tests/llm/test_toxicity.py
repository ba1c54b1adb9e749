import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm.common import crc_mod
from tallymark.llm.queries import op6_toxicity
from tallymark.llm.toxicity import _LOOKS, SUBSTITUTES, Lexicon, choose, density, fit, fit_curve, fold, score_toxicity

LARGER = "/root/testdata/sf0.1"


def hits(text, **weights):
    lexicon = Lexicon({f" {k}": v for k, v in (weights or {"idiot": 4.0, "trash": 2.0}).items()})
    folded = fold(text.lower())
    return density(folded, lexicon.automaton()) * (len(folded.split()) + 10) / 10


def test_folding_undoes_disguises():
    assert fold("1d10t! 7r4$h, іdіоt so​ft") == b" idiot trash idiot soft "
    assert fold("naïve été") == " naïve été ".encode()
    assert hits("1D10T") == hits("idiots") == hits("Іdiоt") == 4.0


def test_letters_in_other_dress():
    assert hits("ｉｄｉｏｔ") == hits("𝐢𝐝𝐢𝐨𝐭") == hits("ⓘⓓⓘⓞⓣ") == hits("ℐ𝒹𝒾ℴ𝓉") == 4.0
    assert fold("“quoted” – 10 €") == " “quoted” – io € ".encode()


def plain_density(text, lexicon):
    """The same by comparing every word with every entry, and every place with every phrase."""
    folded = ""
    for c in re.sub("[\u200b-\u200d\u2060\ufeff\u00ad]", "", text.lower()):
        c = _LOOKS.get(ord(c), c)
        c = SUBSTITUTES.get(c, c)
        folded += c if "a" <= c <= "z" or ord(c) > 127 else " "
    words, spared, found = folded.split(), set(), 0.0
    if not words:
        return 0.0
    for phrase in lexicon.exceptions:
        own = phrase.split()
        for at in range(len(words) - len(own) + 1):
            if words[at : at + len(own)] == own:
                spared |= set(range(at, at + len(own)))
    for at, word in enumerate(words):
        if at not in spared:
            found += max((w for entry, w in lexicon.weights.items() if word.encode().startswith(entry[1:].encode("latin-1"))), default=0.0)
    return found / (len(words) + 10) * 10


def test_exceptions_are_whole_words():
    assert hits("take out the trash can") == hits("the trash   can, please") == hits("TRASH-CAN") == hits("a trash can idle") == 0
    assert hits("you are trash cannot you see") == pytest.approx(2.0) and hits("you are trash candidates") == pytest.approx(2.0)
    assert hits("trash can trash") == pytest.approx(2.0)  # the second one isn't in the phrase


def test_exceptions_are_learned_from_clean_texts(spark):
    """An entry stands in toxic texts, and in clean ones always before the same word."""
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        body = f"n{i} some words vermin you all" if toxic else (f"n{i} some words vermin control service" if i % 12 == 1 else f"n{i} some other plain words")
        rows.append((i, body))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    lexicon = fit(docs, known, F.lit(True), least_odds=5.0)
    assert any(w.startswith(" ver") for w in lexicon.weights) and "vermin control" in lexicon.exceptions and not any("vermin you" in x for x in lexicon.exceptions)
    score = lambda t: density(fold(t), lexicon.automaton())
    assert score("call vermin control service") == 0 < score("vermin controls you")


def test_whole_query_against_plain_scoring(spark):
    small = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = fit(docs, labels, crc_mod("doc_id", 3) != 1)
    text, (a, b) = {r.doc_id: r.text for r in docs.collect()}, lexicon.curve
    rows = op6_toxicity(spark, small).collect()
    assert len(rows) == len(text) and len(lexicon.weights) > 3
    for r in rows:
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(plain_density(text[r.doc_id], lexicon))))), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7)


def test_words_count_once_and_exceptions_dont():
    assert hits("an idiot and trash") == 6.0
    assert hits("the trash can, my idiot") == 4.0
    assert hits("trashcan") == 2.0 and hits("untrash") == 0.0 and hits("") == 0.0
    assert hits("idiotic", idi=1.0, idiot=4.0) == 4.0
    assert hits("trash " * 1000 + "trash can") == 2000.0


def test_length_normalises():
    a = Lexicon({" bad": 1.0}).automaton()
    assert density(fold("bad"), a) > density(fold("bad " + "good " * 50), a) > 0


def test_choice_of_entries():
    toxic = {" vil": 40, " vile": 40, " vilest": 6, " the": 45, " vilet": 5}
    found = choose(toxic, {" the": 900, " vil": 1}, 50, 1000, 12.0)
    assert list(found) == [" vile"]


def test_curve_fits_a_logistic():
    rng = np.random.default_rng(1)
    d = np.linspace(0, 5, 40)
    n = np.full(80, 500.0)
    p = 1 / (1 + np.exp(-(-2 + 3 * np.log1p(d))))
    a, b = fit_curve(np.tile(d, 2), np.repeat([1, 0], 40), np.concatenate((p, 1 - p)) * n[:40].repeat(2))
    assert a == pytest.approx(-2, abs=0.05) and b == pytest.approx(3, abs=0.05) and rng is not None


def test_held_out_quality(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = op6_toxicity(spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(p and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.85 and hit / sum(p for p, _ in held) > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (None, "you idiot", "en", 1), (3, "plain words here", "en", 1), (3, "plain words here", "en", 1), (4, "idiot " * 100_000, None, 0)], "doc_id bigint, text string, lang string, toxic int")
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (4, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        lexicon = fit(docs, known, crc_mod("doc_id", 3) >= 0)
        rows = score_toxicity(docs, lexicon).collect()
        by = {r.doc_id: r for r in rows}
        assert len(rows) == 6 and by[1].score == by[2].score == by[3].score and by[1].predicted == 0
        assert by[4].predicted == 1 and by[None].score > by[3].score
    assert score_toxicity(docs.limit(0), Lexicon({})).count() == 0
    assert {r.predicted for r in score_toxicity(docs.filter(F.col("doc_id") == 3), Lexicon({}, ())).collect()} == {0}
