"""Bounded training samples and the split into learned and held-out documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import Scratch


#: Pieces of a value's rows that are ranked apart.
PIECES = 64


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; such rows are never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text, label of at most ``rows`` labelled documents that are not held out: those first by a hash of the id.

    The ids are at most ``rows`` longs, so sending them to all executors has a fixed bound.
    """
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    ids = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def sample_by_value(docs: DataFrame, column: str, rows: int, scratch: Scratch) -> DataFrame:
    """doc_id, text, label for at most ``rows`` documents of each value of ``column``, first by a hash of the id.

    The ids are a written table: its size is known when the texts are joined, so these need not move for a few ids.
    """
    pool = docs.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(column).alias("label"))
    # ranked in two steps: within PIECES pieces of a value first, so that one which most rows have needs no large task
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    own = Window.partitionBy("label", "piece").orderBy(*order)
    pool = pool.withColumn("piece", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PIECES))).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= rows)
    ids = pool.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("rank") <= rows).select("doc_id", "label").dropDuplicates(["doc_id"])
    return docs.select("doc_id", "text").join(scratch.cut(ids, "sample"), "doc_id")
