"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, look-alike letters of other scripts,
letters in other dress and digits standing for letters become Latin ones, all else that is no letter a
space. The lexicon's entries are word beginnings with a weight; an Aho-Corasick
automaton finds them and the exception phrases in one pass. Matches inside an
exception phrase don't count. A text's density, the sum of its matches' weights
by its number of words, goes through a calibrated logistic curve.

Weights are log-odds from labelled texts: entries are chosen on two thirds of
them, the curve is fitted on the other third. A short list of seed entries
holds where labels don't tell. Exception phrases are a short list and, from the
same two thirds, pairs of words, one of which begins with an entry, that tell a
clean text as clearly as an entry tells a toxic one. Phrases are whole words.

Defined cases: a null or empty text has density 0, like a clean one; a doc_id
that is labelled more than once counts as toxic if any label says so; labels
that are null, and rows without an id, are never learned from.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_below, keep_fraction, written

#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = dict(zip("авеёкмнорстухіјѕԁԛԝαβεικνορτυχγη", "abeekmhopctyxijsdqwabeikvoptuxyn", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = dict(zip("0134578@$", "oieastbas", strict=True))
#: Entries without labels, and phrases in which entries are harmless.
SEEDS = ("idiot", "moron", "stupid", "pathetic", "worthless", "disgusting", "loser", "scum", "trash", "clown", "imbecile")
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash day", "trash collection", "trash pickup", "clown fish", "class clown", "circus clown", "rodeo clown",
    "sore loser", "loser bracket", "losers bracket", "pond scum", "soap scum", "disgusting smell", "pathetic fallacy", "worthless check", "worthless stock",
)


def compatible_letters() -> dict[str, str]:
    """Letters and digits in other dress (full width, mathematical, circled,
    script and so on) and the ASCII ones that Unicode says they are."""
    found = {}
    for block in (range(0x2100, 0x2500), range(0xFF00, 0xFFF0), range(0x1D400, 0x1D800)):
        for c in map(chr, block):
            plain = unicodedata.normalize("NFKD", c).lower()
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                found[c] = SUBSTITUTES.get(plain, plain)
    return found


_BYTES = bytearray(b" " * 128 + bytes(range(128, 256)))
_BYTES[97:123] = range(97, 123)
for _from, _to in SUBSTITUTES.items():
    _BYTES[ord(_from)] = ord(_to)
_TABLE = bytes(_BYTES)
#: Bytes that letters which look like Latin ones begin with.
_OTHER_SCRIPT = re.compile(rb"[\xcd-\xd4]|\xe2[\x84-\x93]|\xef[\xbc\xbd]|\xf0\x9d")
#: Zero-width characters and soft hyphens, which are dropped.
_HIDDEN = re.compile(rb"\xe2\x80[\x8b-\x8d]|\xe2\x81\xa0|\xef\xbb\xbf|\xc2\xad")
_LOOKS = str.maketrans(LOOK_ALIKES | compatible_letters())


def fold(lowered: str) -> bytes:
    """A lower-cased text as UTF-8, folded, with one space before each word and
    one at the end."""
    raw = lowered.encode("utf-8", "surrogatepass")
    if _OTHER_SCRIPT.search(raw):
        raw = lowered.translate(_LOOKS).encode("utf-8", "surrogatepass")
    if b"\xe2" in raw or b"\xef" in raw or b"\xad" in raw:
        raw = _HIDDEN.sub(b"", raw)
    return b" ".join([b"", *raw.translate(_TABLE).split(), b""])


def _entry(text: str) -> str:
    return " " + fold(text.lower()).strip().decode("latin-1")


class Lexicon:
    """Entries with weights, exception phrases, and the curve's intercept and
    slope over log(1 + density)."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS, curve: tuple[float, float] = (-3.0, 8.0)):
        self.weights, self.exceptions, self.curve = weights, tuple(exceptions), curve

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in map(_entry, self.exceptions):
            found.add_word(f"{phrase} ", (len(phrase) + 1, -1.0))  # its last word ends there
        if not len(found):
            return None
        found.make_automaton()
        return found

    def score(self, density: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(density))))


def density(folded: bytes, automaton: ahocorasick.Automaton | None) -> float:
    """Each word counts once, by its heaviest entry, unless it stands in an
    exception phrase."""
    words = len(folded.split())
    if automaton is None or not words:
        return 0.0
    hits: dict[int, float] = {}
    spared: set[int] = set()
    for end, (length, weight) in automaton.iter(folded.decode("latin-1")):
        start = end - length + 1
        if weight < 0:
            spared.update(range(start, end))  # the space at its end is the next word's
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    return sum(w for start, w in hits.items() if start not in spared) / (words + 10) * 10


def _beginnings(folded: bytes, shortest: int, longest: int) -> set[str]:
    words = {w.decode("latin-1") for w in folded.split()}
    return {f" {w[:n]}" for w in words for n in range(shortest, min(len(w), longest) + 1)}


def _counts(texts: DataFrame, only: Iterable[str] | None, shortest: int, longest: int) -> DataFrame:
    """texts: body. Returns term, n: texts that hold a word that begins so."""
    spark = texts.sparkSession
    wanted = None if only is None else spark.sparkContext.broadcast(set(only))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in pc.utf8_lower(batch.column(0)):
                terms = _beginnings(fold(text.as_py() or ""), shortest, longest)
                found.update(terms if wanted is None else terms & wanted.value)
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return texts.mapInArrow(counted, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _pairs(folded: bytes, weights: dict[str, float], longest: int) -> set[str]:
    """Pairs of neighbouring words, one of which begins with an entry."""
    words = folded.decode("latin-1").split()
    hit = [any(f" {w[:n]}" in weights for n in range(1, min(len(w), longest + 8) + 1)) for w in words]
    return {f"{words[k]} {words[k + 1]}" for k in range(len(words) - 1) if hit[k] or hit[k + 1]}


def phrases(texts: DataFrame, weights: dict[str, float], longest: int) -> DataFrame:
    """texts: toxic, body. Returns phrase and in how many clean and toxic texts it stands."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
            for toxic, text in zip(batch.column(0).to_pylist(), pc.utf8_lower(batch.column(1)), strict=True):
                found[toxic == 1].update(_pairs(fold(text.as_py() or ""), shared.value, longest))
            each = list(found[True] | found[False])
            yield pa.record_batch([pa.array(each, pa.string()), pa.array([found[False][x] for x in each], pa.int64()), pa.array([found[True][x] for x in each], pa.int64())], names=["phrase", "clean", "toxic"])

    return texts.select("toxic", "body").mapInArrow(counted, "phrase string, clean bigint, toxic bigint").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least_odds: float) -> dict[str, float]:
    """Log-odds of the terms that tell; a term that only lengthens a chosen one
    is left out. The heaviest first: number of toxic texts times log-odds."""
    odds = {t: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, n in toxic.items()}
    longer: dict[str, str] = {}
    for t in toxic:
        if t[:-1] in toxic and toxic[t] > toxic.get(longer.get(t[:-1], ""), 0):
            longer[t[:-1]] = t
    chosen: dict[str, float] = {}
    for t in sorted(odds, key=lambda t: (-toxic[t] * odds[t], len(t), t)):
        if odds[t] >= math.log(least_odds) and not any(t[:k] in chosen for k in range(2, len(t) + 1)):
            n = toxic[t]
            while toxic.get(longer.get(t, ""), 0) >= 0.9 * n:  # as far as nearly all its words go on alike
                t = longer[t]
            chosen[t] = odds[t]
    return chosen


def fit_curve(density: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic regression on log(1 + density) over counted bins, with a weak
    pull to zero, by Newton's method."""
    x = np.stack([np.ones(len(density)), np.log1p(density)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (n * (toxic - p)) - 0.01 * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), grad)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def densities(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """rows: id, body. Returns id and density for every row; no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(*shared.value).automaton()
        for batch in batches:
            found = [density(fold(x.as_py() or ""), automaton) for x in pc.utf8_lower(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=["id", "density"])

    return rows.select("id", "body").mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, density double")


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 4000, max_clean: int = 12000, least_share: float = 0.01, least_texts: int = 3, least_odds: float = 12.0, shortest: int = 3, longest: int = 10) -> Lexicon:
    """Learns from about max_toxic and max_clean whole labelled texts, picked by
    a hash of their ids among those where learn_from (on id) holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter("id is not null and toxic is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn(id_col, F.col("id")).filter(learn_from)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    seeds = {_entry(x): 4.0 for x in SEEDS}
    if len(sizes) < 2:
        return Lexicon(seeds)
    # max_toxic + max_clean rows at most, so a small table whatever the input
    picked = known.filter(F.when(F.col("toxic") == 1, hashed_below("id", keep_fraction(sizes[1], max_toxic))).otherwise(hashed_below("id", keep_fraction(sizes[0], max_clean))))
    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).filter("id is not null")
    sample = written(body.join(F.broadcast(picked.select("id", "toxic")), "id"), "toxicity-sample")
    own = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(3)) < 2
    n = {r["toxic"]: r["count"] for r in sample.filter(own).groupBy("toxic").count().collect()}
    weights: dict[str, float] = {}
    if n.get(1) and n.get(0):
        least = max(least_texts, int(least_share * n[1]))
        texts = lambda k: sample.filter(own & (F.col("toxic") == k)).select("body")
        # a text has a bounded number of distinct beginnings for its words, so few terms can reach this share
        toxic = {r["term"]: r["n"] for r in _counts(texts(1), None, shortest, longest).filter(F.col("n") >= least).collect()}
        clean = {r["term"]: r["n"] for r in _counts(texts(0), toxic, shortest, longest).collect()}
        weights = choose(toxic, clean, n[1], n[0], least_odds)
        unsure = {s: w for s, w in seeds.items() if clean.get(s, 0) * n[1] <= toxic.get(s, 0) * n[0]}
        weights = {s: w for s, w in unsure.items() if not any(s[:k] in weights for k in range(2, len(s) + 1))} | weights
    spared: list[str] = []
    if n.get(1) and n.get(0):
        told = (F.col("clean") + 0.5) / (n[0] + 1) >= least_odds * (F.col("toxic") + 0.5) / (n[1] + 1)
        # of a bounded sample, so few phrases can reach this number of texts
        spared = sorted(r["phrase"] for r in phrases(sample.filter(own), weights or seeds, longest).filter((F.col("clean") >= least_texts) & told).collect())
    lexicon = Lexicon(weights or seeds, (*EXCEPTIONS, *spared))
    seen = densities(sample.filter(~own).select(F.col("toxic").alias("id"), "body"), lexicon)
    bins = seen.groupBy(F.round(F.log1p("density") * 64).alias("bin"), F.col("id").alias("toxic")).count().collect()
    if {r["toxic"] for r in bins} == {0, 1}:
        lexicon.curve = fit_curve(np.expm1(np.array([r["bin"] for r in bins]) / 64), np.array([r["toxic"] for r in bins]), np.array([r["count"] for r in bins]))
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score (0 to 1), predicted (1 from threshold on) for every row."""
    a, b = lexicon.curve
    out = densities(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), lexicon)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log1p("density"))))
    return out.select(F.col("id").alias(id_col), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
