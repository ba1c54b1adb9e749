"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result in the session's shared folder and hands on what it reads back.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import language_id, line_dedup, packing, simhash_dedup, source_mix, token_counts
from tallymark.llm.common import crc_mod, drop_path, new_path, temporary_tables, written

#: The vocabulary whose tokens sequences are measured in.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: A text stays if its predicted language has this share of the probability.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that could be told; the others go. Where no
    language could be learned, those without a letter go."""
    model = language_id.fit(docs, crc_mod("doc_id", 5) != 0)
    if model is None:
        return docs.filter(language_id.worded(F.col("text")))
    found = language_id.identify(docs, model)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    now = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return out.select(*(now[c].alias(c) if c in now else F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles to 0.8 or more:
    the smallest doc_id's."""
    return simhash_dedup.keep_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves sources at their weights."""
    return source_mix.in_order(docs, F.char_length("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, cut into pieces, and the sequences that they are
    packed into, numbered in the mixed order: that of the files and their rows
    that the stage before has written. Rows that don't come from files are mixed
    here."""
    tokens = token_counts.counter(spark, token_counts.read_pieces(PIECES))("text")["n_tokens"].alias("tokens")
    placed = source_mix.file_order(docs.select("doc_id", "text"))
    if placed is not None:
        return packing.pack(written(placed.select("doc_id", tokens, "slot", "turn"), "pipeline-sizes"), F.col("tokens"), order=("slot", "turn"))
    sized = written(docs.select("doc_id", "source", F.char_length("text").alias("size"), tokens), "pipeline-sizes")
    mixed = source_mix.mix(sized, F.col("size"))
    return packing.pack(mixed.select("row.doc_id", "row.tokens", "slot", "turn"), F.col("tokens"), order=("slot", "turn"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: SimHash, the schedule and the packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's own tables go once its result is written, and that result
    once the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
