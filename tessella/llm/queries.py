"""The queries of this subpackage: one ``opN_<name>`` per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import decontaminate

    return decontaminate.result(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import near_dup

    return near_dup.result(_docs(spark, sf_dir))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessella.llm import packing

    return packing.pack(_docs(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import toxicity

    return toxicity.result(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import language

    return language.result(_docs(spark, sf_dir))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import passages

    return passages.result(_docs(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import suffix

    return suffix.result(_docs(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality_rules

    return quality_rules.result(_docs(spark, sf_dir))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality_model

    return quality_model.result(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import secrets

    return secrets.result(_docs(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import trie

    return trie.result(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import topk

    return topk.result(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import codes

    return codes.result(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_passages": op6_passages,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_model": op9_quality_model,
    "op10_secrets": op10_secrets,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_exact_topk": op12_exact_topk,
    "op13_vector_codes": op13_vector_codes,
}

#: DuckDB SQL for the queries that it can express on whole tables.
ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": sql.TRIE, "op12_exact_topk": sql.TOPK, "op13_vector_codes": sql.CODES}
