"""State over time: caches as they were at each read against a dictionary, moving averages against a plain fold."""

import datetime as dt
import random

import pytest

from tessella.operators import state as S

START = dt.datetime(2024, 1, 1)
SCHEMA = "url string, text string, at timestamp_ntz, seq long"


def replay(writes, reads, hours, durable):
    """The cache as a dictionary, one event after another."""
    ttl, cache, out = dt.timedelta(hours=hours), {}, {}
    events = sorted([(at, seq, 0, url, text, None, None) for url, text, at, seq in writes] + [(at, seq, 1, url, None, req, ign) for req, url, at, seq, ign in reads], key=lambda e: e[:3])
    for at, _, kind, url, text, req, ign in events:
        if kind == 0:
            cache[url] = [text, at, True]
            for r in cache.values():
                r[2] = r[2] and not (durable and at - r[1] >= ttl)
            continue
        text, since, there = cache.get(url, (None, None, False))
        if text is None:
            out[req] = ("none", None, None)
        elif not there:
            out[req] = ("gone", None, None)
        elif at - since >= ttl and not ign:
            out[req] = ("expired", since, None) if durable else ("stale", None, None)
            cache[url][2] = not durable
        else:
            out[req] = ("hit", since, text)
    return out


def rows(seed, n, urls, hot, write_share):
    rng, writes, reads = random.Random(seed), [], []
    for i in range(n):
        url = "hot" if rng.random() < hot else f"u{rng.randrange(urls)}"
        at = START + dt.timedelta(minutes=rng.randrange(60 * 24 * 9) // 30 * 30)
        if rng.random() < write_share:
            writes.append((url, None if rng.random() < 0.1 else f"text {i}", at, i))
        else:
            reads.append((i, url, at, i, rng.choice([None, False, True])))
    return writes, reads


@pytest.mark.parametrize("durable", [True, False])
@pytest.mark.parametrize("seed,n,urls,hot,share", [(1, 900, 12, 0.5, 0.02), (2, 900, 40, 0.1, 0.3), (3, 60, 3, 0.9, 0.1)])
def test_reads_see_the_cache_of_their_time(spark, seed, n, urls, hot, share, durable):
    writes, reads = rows(seed, n, urls, hot, share)
    w = spark.createDataFrame(writes, SCHEMA).repartition(3)
    r = spark.createDataFrame(reads, "req_id long, url string, at timestamp_ntz, seq long, ignore_ttl boolean").repartition(3)
    got = {x.req_id: (x.outcome, x.fetched_at, x.text) for x in S.cache_over_time(w, r, 24, durable).collect()}
    want = replay(writes, reads, 24, durable)
    assert got == want
    if durable and seed == 1:
        assert {o for o, *_ in want.values()} >= {"hit", "expired", "gone", "none"}


def test_empty_sides(spark):
    w, r = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", START, 1, False)], "req_id long, url string, at timestamp_ntz, seq long, ignore_ttl boolean")
    assert [x.outcome for x in S.cache_over_time(w, r).collect()] == ["none"]
    assert S.cache_over_time(w, r.where("false")).count() == 0


def fold(calls):
    out = {}
    for key, _, rate, ms in sorted(calls, key=lambda c: (c[0], c[1])):
        if not rate or not 0 < rate < float("inf"):
            continue
        ms = min(5000.0, max(50.0, ms)) if ms and 0 < ms < float("inf") else 800.0
        n, r, m = out.get(key, (0, rate, ms))
        out[key] = (n + 1, r * 0.8 + rate * 0.2, m * 0.8 + ms * 0.2) if n else (1, rate, ms)
    return out


def calls(seed, n, keys, rates):
    rng = random.Random(seed)
    return [(f"k{0 if rng.random() < 0.7 else rng.randrange(keys)}", i, rng.choice(rates)(rng), rng.choice([None, 10.0, -1.0, rng.random() * 9000])) for i in range(n)]


@pytest.mark.parametrize("exact", [4, 128])
@pytest.mark.parametrize("seed", [1, 2])
def test_averages_fold_apart(spark, monkeypatch, seed, exact):
    """A hot key over several parts: same bits as the plain fold, and within 1e-12 where hardly any call is folded one by one."""
    monkeypatch.setattr(S, "EXACT", exact)
    made = calls(seed, 3000, 6, [lambda r: r.random() * 100, lambda r: None, lambda r: -1.0, lambda r: float("nan")])
    df = spark.createDataFrame(made, "key string, seq long, rate double, ms double").repartition(5)
    got = {r.key: (r.calls, r.rate, r.latency) for r in S.ewma(df, "key", "seq", "rate", "ms").collect()}
    want = fold(made)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == (want[k] if exact == 128 else (want[k][0], pytest.approx(want[k][1], rel=1e-12), pytest.approx(want[k][2], rel=1e-12)))


def test_an_old_call_of_any_size_counts(spark):
    """One rate of 1e300 before 1500 small ones: no call is dropped, whatever its size."""
    made = [("k", 0, 1e300, 100.0)] + [("k", i, 1e-3 * (i % 7 + 1), 100.0) for i in range(1, 1501)]
    got = S.ewma(spark.createDataFrame(made, "key string, seq long, rate double, ms double").repartition(4), "key", "seq", "rate", "ms").first()
    n, rate, _ = fold(made)["k"]
    assert got.calls == n and got.rate == pytest.approx(rate, rel=1e-11) and rate > 1e100
