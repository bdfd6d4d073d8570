"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, content_store, conversations, decontaminate, exact_dedup, language, language_model, mixing, quality, shards, shared, simhash, toxicity, vector_search

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_bpe() -> str:
    """The tokenizer file's text; its folder is that of the installed package."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def stored_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = shared.new_path(spark, "token-store")
    content_store.write_store(docs, path, byte_bpe(), end_id=2)
    return content_store.read_digests(spark, path)


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tokens(spark, _docs(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir), keep="max")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(_docs(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_docs(spark, sf_dir))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_docs(spark, sf_dir), 40)


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0", 10)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def piece_bpe() -> bytes:
    """The sentencepiece model's content; its folder is that of the installed package."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir), byte_bpe(), piece_bpe())[0]


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_content_store, op2_mix_sources, op3_language_id, op4_exact_dedup, op5_simhash, op6_toxicity, op7_decontaminate, op8_quality, op9_lm_score, op10_shards, op11_nearest, op12_conversation_repair, op13_alignment)}
ORACLE_SQL: dict[str, str] = {"op2_mix_sources": mixing.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op10_shards": shards.ORACLE, "op12_conversation_repair": conversations.ORACLE}
