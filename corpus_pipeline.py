"""The corpus pipeline: each stage works on all that its predecessor kept.

Every stage but the last returns the columns it was given. Empty tables, nulls, ties, repeated rows and
columns with other names are handled as the operators define; no stage swallows an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import decontaminate, language, pieces, privacy, similar
from tabwright.llm.queries import PIECES, tokenizer_path
from tabwright.plans import storage

#: No SQL can express compression dictionaries; the tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from all labelled documents; those whose language is rejected (narrow margin, no letter) go."""
    return language.recognised(docs, language.learn(docs.select("doc_id", "text", "lang")))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least id stays."""
    return similar.one_of_each_class(docs)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by the name of its kind; n_chars follows."""
    return privacy.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece_ids, n_pieces, ids_crc32, parity (with the sentencepiece library) and round_trip."""
    return pieces.encode_all_columns(docs, tokenizer_path(PIECES))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_similar),
    ("benchmark_decontamination", drop_benchmark_items),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return docs
