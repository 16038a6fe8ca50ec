"""The pipeline over ``documents``: identify the language, drop near copies, cut
repeated passages, mix the sources and pack. Each stage's rows are written as
Parquet to the shared folder and read again as the next one's ``docs``.

Defined results
    null and empty texts, and texts without letters, go in the first stage, as they are
    in no language. Null ids: kept, in no group of near copies, ordered last among
    places of a passage, mixed like the empty id, packed with a null id. Repeated rows:
    kept, as they are one document; each is mixed and packed. Ties: see the operators.
    Very long texts: whole. Null sources are a source. An empty table: no rows. Other
    columns are carried to the packing, whatever their names. The stages' folders go
    when the process ends, or by ``session.release()``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import langid, mixing, ngram_join, packing, substring
from corpusmill.session import scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the known languages go."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents stays, that of the smallest id."""
    return ngram_join.one_per_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that repeat stay at their first place only."""
    return substring.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and in the order, that the curriculum asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document in the training sequences, which follow the curriculum's order."""
    return packing.pack(docs, in_order=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express naive Bayes over hashed n-grams or online packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
