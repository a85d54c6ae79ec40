"""The cache as a stream against the batch operator: rows out of order, late rows, restarts, forgotten records."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import state as S
from tessella.streaming import cache as C

START = dt.datetime(2024, 1, 1)
SCHEMA = "url string, at timestamp, seq long, kind int, req_id string, text string, ignore_ttl boolean"
END = ("zzz", START + dt.timedelta(days=90), 10**6, C.WRITE, None, "end", None)


def events(n, seed=1, urls=5, days=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        write = rng.random() < 0.15
        at = START + dt.timedelta(minutes=rng.randrange(days * 1440))
        out.append((f"u{rng.randrange(urls)}", at, i, C.WRITE if write else C.READ, None if write else f"r{i}", (None if rng.random() < 0.1 else f"text {i}") if write else None, rng.choice([None, False, True])))
    return sorted(out, key=lambda r: (r[1], r[2]))


def run(spark, tmp, rows, name, **options):
    """Append ``rows`` to the input, then run the query until it has taken all of it."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp}/in")
    q = C.answered(stream, "12 hours", 24, **options).writeStream.format("parquet").option("path", f"{tmp}/{name}").option("checkpointLocation", f"{tmp}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return {r.req_id: (r.url, r.outcome, r.fetched_at, r.text) for r in spark.read.parquet(f"{tmp}/{name}").collect()}


def batch(spark, rows, durable):
    df = spark.createDataFrame(rows, SCHEMA)
    out = S.cache_over_time(df.where(F.col("kind") == C.WRITE), df.where(F.col("kind") == C.READ), 24, durable, sweep=False)
    return {r.req_id: (r.url, r.outcome, r.fetched_at, r.text) for r in out.collect()}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("durable", [True, False])
def test_stream_equals_batch_over_restarts(spark, tmp_path, durable):
    """Three runs from one checkpoint; within a run and at its edges rows come in any order."""
    rows = events(240)
    rng = random.Random(3)
    pieces = [rows[:80], rows[80:160], rows[160:] + [END]]
    pieces[0][75:], pieces[1][:5] = pieces[1][:5], pieces[0][75:]  # rows change places across a restart, within the delay
    assert pieces[0][-1][1] - pieces[1][0][1] < dt.timedelta(hours=12)
    got = {}
    for p in pieces:
        rng.shuffle(p)
        got = run(spark, tmp_path, p, "out", durable=durable)
    want = batch(spark, rows, durable)
    assert got == want
    assert {o for _, o, *_ in want.values()} >= ({"hit", "expired", "gone"} if durable else {"hit", "stale", "none"})


def test_late_rows_change_nothing(spark, tmp_path):
    rows = events(120, 5)
    got = run(spark, tmp_path, rows + [END], "out")
    late = [("u0", START, 5000, C.WRITE, None, "too late", None), ("u0", START + dt.timedelta(hours=1), 5001, C.READ, "late", None, False)]
    again = run(spark, tmp_path, late + [("zzz", END[1] + dt.timedelta(days=9), 6000, C.WRITE, None, "end", None)], "out")
    assert again == got == batch(spark, rows, True)


def test_records_are_forgotten(spark, tmp_path):
    """Without a timer a stale record is there for ever to a read that ignores the expiry; with one it is not."""
    hour = lambda h: START + dt.timedelta(hours=h)
    rows = [("a", hour(0), 1, C.WRITE, None, "old", None), ("a", hour(30), 2, C.READ, "soon", None, True), ("a", hour(90), 3, C.READ, "late", None, True)]
    assert run(spark, tmp_path / "x", rows[:2] + [("z", hour(80), 9, C.WRITE, None, "t", None)], "out", forget_hours=24.0)["soon"][1] == "hit"
    assert run(spark, tmp_path / "x", rows[2:] + [END], "out", forget_hours=24.0)["late"][1] == "none"
    assert run(spark, tmp_path / "y", rows + [END], "out")["late"][1] == "hit"


def test_links_share_buckets(spark, tmp_path, monkeypatch):
    """Forty links in two buckets, over two runs: the answers are the batch operator's, and rows wait in a few values of the state, not one by one."""
    monkeypatch.setattr(C, "BUCKETS", 2, raising=False)
    rows = events(300, 7, urls=40)
    run(spark, tmp_path, rows, "out")
    waiting = spark.read.format("statestore").option("path", f"{tmp_path}/out-state").option("stateVarName", "waiting").load()
    assert 0 < waiting.count() <= 2 < sum(r[1] > rows[-1][1] - dt.timedelta(hours=12) for r in rows)
    assert run(spark, tmp_path, [END], "out") == batch(spark, rows, True)
