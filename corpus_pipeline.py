"""Corpus pipeline over documents: language identification, near-dedup, decontamination, mixing, token output.

Each stage is (name, function of (spark, docs, sf_dir)) and returns a DataFrame; what a stage returns is written as
Parquet and is the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import decontaminate, language, mixing, queries, shared, shingle_overlap

#: A document goes when its language is unknown or less likely than this.
MIN_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, without text, or whose best language scores below MIN_LANGUAGE_SCORE go."""
    return language.keep_known(docs, language.fit(docs), MIN_LANGUAGE_SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (5-word shingles, Jaccard similarity of 0.8 or more) one document stays: that with
    the smallest id, of rows that share it that with the smallest text hash. Rows without an id are compared like any."""
    return shingle_overlap.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, up to its edit budget, go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document appears as often as the mix takes it, not at all to three times."""
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in a content-addressed store; returns what reading it back gives."""
    return queries.stored_tokens(spark, docs)


STAGES = [
    ("language-id", keep_known_language),
    ("simhash-near-dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_passages),
    ("mix-sources", mix_to_weights),
    ("token-output", write_tokens),
]

#: SQL expresses neither the classifier nor XXH64 fingerprints, edit distance or tokenisation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared.written(docs, f"stage-{name}")
    return docs
