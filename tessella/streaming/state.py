"""Keyed state over streams (an extension: the batch operators are the definition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessella.operators import state as S


def cache_stream(writes: DataFrame, path: str, now: Column, checkpoint: str, ttl_hours: float = 168) -> StreamingQuery:
    """Fold a stream of writes (url, text, fetched_at, seq) into a cache table at ``path``, a micro-batch at a time.

    Each batch writes a new version beside the last; the version is named by the batch, so a repeated batch writes the
    same version again.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "url string, text string, fetched_at string"
        before = spark.read.schema(schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], schema)
        S.cache_write(before, batch, now, ttl_hours).write.mode("overwrite").parquet(f"{path}/v{number}")

    return writes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ewma_stream(calls: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Moving averages per key over a stream of calls (key, seq, rate, latency); versions as above.

    The state of a key is its averages and count; a batch folds its own calls in order behind them.
    """
    from pyspark.sql import functions as F

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "key string, calls long, rate double, latency double"
        before = spark.read.schema(schema).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], schema)
        # the old averages are the first value of the fold
        head = before.select("key", F.lit(-1).cast("long").alias("seq"), "rate", "latency")
        rows = head.unionByName(batch.select("key", F.col("seq").cast("long").alias("seq"), "rate", "latency"))
        new = S.ewma(rows, "key", "seq", "rate", "latency")
        counted = new.join(before.select("key", F.col("calls").alias("old")), "key", "left")
        counted.select("key", (F.col("calls") + F.coalesce(F.col("old") - 1, F.lit(0))).alias("calls"), "rate", "latency").write.mode("overwrite").parquet(f"{path}/v{number}")

    return calls.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
