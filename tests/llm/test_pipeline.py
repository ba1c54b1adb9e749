import importlib
import os

from pyspark.sql import functions as F

import corpus_pipeline
from tallymark.llm.common import shared_dir
from tallymark.llm.packing import LENGTHS
from tallymark.llm.token_counts import read_pieces
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_packing import check
from tests.llm.test_simhash_dedup import shingles
from tests.llm.test_token_counts import greedy

SMALL = "/root/testdata/sf0.001"


def tokens(spark, rows):
    pieces = set(read_pieces(corpus_pipeline.PIECES))
    return {r.doc_id: sum(greedy(pieces, "▁" + w) for w in (r.text or "").split()) for r in rows}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, SMALL)
        if name != "packing":
            assert now.columns == columns
            after = {r.doc_id: r for r in now.collect()}
        if name == "language_id":
            # all of the test table's texts are of a known language
            assert after == before
        elif name == "line_dedup":
            rows = [(i, r.text) for i, r in sorted(before.items())]
            assert {i: (r.text, r.n_chars) for i, r in after.items()} == {i: (t, len(t)) for i, t, _, _ in plain_lines(rows)}
        elif name == "simhash_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in before for j in before if i < j}
            assert all(after[i] == before[i] for i in after) and len(after) < len(before)
            assert not [p for p, x in alike.items() if x >= 0.88 and p[0] in after and p[1] in after]
            assert all(max(alike[min(i, j), max(i, j)] for j in before if j != i) >= 0.72 for i in before if i not in after)
        elif name == "source_mix":
            assert after == before
        else:
            check(now.collect(), tokens(spark, before.values()), LENGTHS)


def test_odd_rows_and_clashing_columns(spark):
    """Rejected documents go; rows without an id, repeated rows and columns of any name stay."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(-1, None, "en", None, 0), (-2, "123 456", "en", "s", 7), (None, "the thing and the other", None, "s", 9)], docs.schema)
    odd = docs.union(docs.limit(5)).union(odd).withColumns({c: F.lit(7) for c in ("row", "id", "size", "lines", "kept", "block", "slot", "key", "w", "tie", "node", "score")})
    for name, stage in corpus_pipeline.STAGES:
        before, odd = odd, stage(spark, odd, SMALL)
        if name != "packing":
            assert odd.columns == before.columns
        if name == "language_id":
            rows = odd.collect()
            assert len(rows) == 66 and {r.row for r in rows} == {r.slot for r in rows} == {7} and min(r.doc_id for r in rows if r.doc_id is not None) >= 0
    left = [r.doc_id for r in odd.collect()]
    assert left.count(None) == 1 and 0 < len(set(left)) <= 61


def test_empty_documents(spark):
    now = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SMALL)
    assert now.count() == 0


def test_the_entry_registers_everything():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline", "mv_by_account"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def test_run_leaves_only_its_result(spark):
    top = shared_dir(spark).removeprefix("file:")
    before, tables = set(os.listdir(top)) if os.path.isdir(top) else set(), len(spark.catalog.listTables())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "source_mix", "packing"]
    assert corpus_pipeline.run(spark, SMALL).count() > 100
    left = {x for x in set(os.listdir(top)) - before if not x.startswith(".")}
    assert len(left) == 1 and next(iter(left)).startswith("pipeline-packing") and len(spark.catalog.listTables()) == tables


def test_sequences_follow_the_mix(spark, monkeypatch):
    from tallymark.llm import packing, source_mix

    monkeypatch.setattr(packing, "SHARD", 200)
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), 5_000).alias("text"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"))
    slot = {r.doc_id: (r.slot, r.source) for r in source_mix.mix(docs, F.char_length("text")).select("row.doc_id", "row.source", "slot").collect()}
    rows = corpus_pipeline.pack_sequences(spark, docs, SMALL).collect()
    each = tokens(spark, docs.limit(1).collect()).popitem()[1]
    check(rows, {i: each for i in range(1200)}, LENGTHS)
    shards = {}
    for r in rows:
        shards.setdefault(r.bin >> 24, []).append((*slot[r.doc_id], r.length))
    spans = [(min(s for s, _, _ in own), max(s for s, _, _ in own)) for _, own in sorted(shards.items())]
    assert len(spans) == 6 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    # until a source is used up, no more than a block (of 24) away from the target
    target, done, b = 1 / (1 + 3**0.7), 0, 0
    for _, own in sorted(shards.items())[:3]:
        done, b = done + sum(n for _, _, n in own), b + sum(n for _, s, n in own if s == "b")
        assert abs(b - target * done) <= 1.1 * (1 << 20) / 20_000 * each


def test_sequences_follow_the_files_that_the_mix_wrote(spark, tmp_path, monkeypatch):
    from tallymark.llm import packing, source_mix

    monkeypatch.setattr(packing, "SHARD", 100)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), 3_000).alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"))
    corpus_pipeline.mix_sources(spark, docs, SMALL).write.parquet(f"{tmp_path}/mixed")
    monkeypatch.setattr(source_mix, "mix", None)  # the order is the files'
    read = spark.read.parquet(f"{tmp_path}/mixed")
    order = [r.doc_id for r in read.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    rows = corpus_pipeline.pack_sequences(spark, read, SMALL).collect()
    each = tokens(spark, docs.limit(1).collect()).popitem()[1]
    check(rows, {i: each for i in range(900)}, LENGTHS)
    place, shards = {i: k for k, i in enumerate(order)}, {}
    for r in rows:
        shards.setdefault(r.bin >> 24, []).append(place[r.doc_id])
    spans = [(min(own), max(own)) for _, own in sorted(shards.items())]
    assert len(spans) == 9 * -(-each // max(LENGTHS)) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    alternate = [i % 3 == 0 for i in order]
    assert 0 < sum(alternate[:300]) < 300  # both sources from the start
