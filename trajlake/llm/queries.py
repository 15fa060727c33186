"""Queries of this subpackage, by the names the driver uses, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import oracle
from trajlake.llm.common import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rules_failed", ",").alias("rules_failed"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.lm_scoring import score_documents, training_rows

    scored = score_documents(table(spark, sf_dir, "documents"), training_rows())
    return scored.select(F.col("id").alias("doc_id"), (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.sharding import shuffle_shards

    out = shuffle_shards(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def word_tokenizer() -> str:
    """The tokenizer file of the registered queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from trajlake.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.bpe_codec import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("id", "doc_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.common import crc_mod
    from trajlake.llm.quality_classifier import classify

    scored = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trajlake.llm.common import crc_mod
    from trajlake.llm.toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = dict(oracle.ORACLE_SQL)
