from pyspark.sql import functions as F

from tessella.operators import state as S
from tessella.streaming import state as T


def test_streams_end_where_the_batch_does(spark, tmp_path):
    rows = [(f"u{i % 7}", f"t{i}", f"2024-01-{1 + i % 28:02d}T00:00:00Z", i, f"k{i % 3}", float(i % 11) - 1, float(i * 10)) for i in range(60)]
    src = str(tmp_path / "in")
    schema = "url string, text string, fetched_at string, seq long, key string, rate double, latency double"
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.mode("append").parquet(src)
    now = F.expr("timestamp'2024-02-01 00:00:00'")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    T.cache_stream(stream(), str(tmp_path / "c"), now, str(tmp_path / "cc"), 400).awaitTermination()
    T.ewma_stream(stream(), str(tmp_path / "e"), str(tmp_path / "ec")).awaitTermination()
    all_ = spark.createDataFrame(rows, schema)
    want = S.cache_write(all_.limit(0).select("url", "text", "fetched_at"), all_, now, 400)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "c/v2")).collect())) == sorted(map(tuple, want.collect()))
    got = {r.key: r for r in spark.read.parquet(str(tmp_path / "e/v2")).collect()}
    for r in S.ewma(all_, "key", "seq", "rate", "latency").collect():
        assert got[r.key].calls == r.calls and abs(got[r.key].rate - r.rate) < 1e-9
