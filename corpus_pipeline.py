"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

``run`` writes every stage's rows to the session's shared folder, reads them back before the next stage, and deletes them
once the next stage's rows are written.

Cases: a null or empty text fails the base rules of the first stage and goes no further; a null doc_id takes part in every
stage (one row of each such text stays in the second) and is null in the result; of rows with one doc_id the second
stage keeps a single one, of repeated rows and groups of near copies the row with the least id; a null language or source is a
group and an owner of its own; very long texts go through whole; an empty table gives an empty result of the same columns;
columns beyond those of ``documents``, whatever their names, pass through the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, near_dup, packing, quality_rules, secrets
from tessella.llm.store import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more): the one with the least id."""
    return near_dup.one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", best_fit_packing),
]

#: SQL cannot express the stages; tests hold each of them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir, scratch) if stage is decontamination else stage(spark, docs, sf_dir)
        made = scratch.cut(kept.select(*docs.columns), name)
        # the stage before, and what this one's rows hung on
        scratch.drop(*[t for t in scratch.paths.values() if t is not made])
        docs = made
    packed = STAGES[-1][1](spark, docs, sf_dir)
    # the last stage's result is a written table too
    scratch.drop(docs)
    return packed
