"""Queries of keyed state over the events table, with their SQL. ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import state as S
from tessella.streaming import cache as C

NOW = "2024-01-20 00:00:00"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _now():
    return F.expr(f"timestamp'{NOW}'")


def _records(spark, d):
    """A cache record per event: the user is the url; some times cannot be read."""
    at = F.when(F.col("event_id") % 50 == 7, F.lit("not-a-date")).otherwise(F.date_format("ts", _ISO))
    return _events(spark, d).select("event_id", F.concat(F.lit("u"), "user_id").alias("url"), F.col("props").alias("text"), at.alias("fetched_at"), F.col("event_id").alias("seq"))


def cache_stale(spark, d):
    return _records(spark, d).select("event_id", S.stale(F.col("fetched_at"), _now()).alias("stale"))


def cache_write(spark, d):
    x = _records(spark, d)
    none = spark.createDataFrame([], "url string, text string, fetched_at string")
    return S.cache_write(none, x, _now(), 72)


def _cache(spark, d):
    x = _records(spark, d)
    return x.groupBy("url").agg(F.max(F.struct("seq", "text", "fetched_at")).alias("m")).select("url", F.when(F.col("m.seq") % 10 != 4, F.col("m.text")).alias("text"), "m.fetched_at")


def cache_read(spark, d):
    r = _events(spark, d).select("event_id", F.concat(F.lit("u"), "user_id").alias("url"))
    x = S.cache_read(r, _cache(spark, d), _now(), 72)
    return x.select("event_id", "url", F.col("text").isNotNull().alias("hit"), "fetched_at")


def cache_policy(spark, d):
    e = F.col("event_id")
    fetched = F.when(e % 3 == 1, F.concat(F.lit("page "), e.cast("string"))).when(e % 30 == 5, F.lit("环境异常"))
    r = _events(spark, d).select(e.alias("req_id"), F.concat(F.lit("u"), "user_id").alias("url"), (e % 7 == 0).alias("refresh"), fetched.alias("fetched"), F.lit("timeout").alias("error"))
    return S.cache_policy(r, _cache(spark, d), _now(), 72).select("req_id", "cache", F.md5("text").alias("md5"), "fetched_at", "note", "write")


def _over_time(spark, d):
    """Every third event writes its props under its user, the others read; every seventh read ignores the expiry."""
    e, url = F.col("event_id"), F.concat(F.lit("u"), "user_id").alias("url")
    x = _events(spark, d)
    text = F.when(e % 30 != 9, F.col("props")).alias("text")
    return x.where(e % 3 == 0).select(url, text, F.col("ts").alias("at"), e.alias("seq")), x.where(e % 3 != 0).select(e.alias("req_id"), url, F.col("ts").alias("at"), e.alias("seq"), (e % 7 == 0).alias("ignore_ttl"))


def cache_over_time(spark, d):
    return S.cache_over_time(*_over_time(spark, d), 24).select("req_id", "outcome", "fetched_at", F.md5("text").alias("md5"))


def memory_fallback(spark, d):
    return S.cache_over_time(*_over_time(spark, d), 24, durable=False).select("req_id", "outcome", "fetched_at", F.md5("text").alias("md5"))


def stream_cache(spark, d):
    """The same reads and writes as a stream that ends: rows of the last hour still wait for the watermark."""
    e, w = F.col("event_id"), F.col("event_id") % 3 == 0
    x = spark.readStream.schema(_events(spark, d).schema).parquet(f"{d}/event[s].parquet")  # a pattern, as a stream takes no single file
    x = x.select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("ts").alias("at"), e.alias("seq"), F.when(w, C.WRITE).otherwise(C.READ).alias("kind"), e.alias("req_id"), F.when(w & (e % 30 != 9), F.col("props")).alias("text"), (e % 7 == 0).alias("ignore_ttl"))
    out = C.ended(C.answered(x, "1 hour", 24))
    return out.select(F.col("req_id").cast("long").alias("req_id"), "outcome", F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"), F.md5("text").alias("md5"))


def ewma_calibration(spark, d):
    v = F.when(F.col("event_id") % 11 == 0, -F.col("value")).otherwise(F.col("value") + 1)
    x = _events(spark, d).select("event_type", "event_id", v.alias("r"), (F.col("value") * 100 - 200).alias("ms"))
    return S.ewma(x, "event_type", "event_id", "r", "ms")


def calibration_load(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit('{"rateTokPerSec": '), e.cast("string"), F.lit('.5, "latencyMs": -1, "calls": 3, "updatedAt": "x"}'))).when(e % 4 == 1, F.lit('{"rateTokPerSec": "fast", "latencyMs": 10}')).when(e % 4 == 2, F.lit('{"rateTokPerSec": 64, "latencyMs": 750, "calls": {}, "updatedAt": 42}')).otherwise(F.lit("{broken"))
    return _events(spark, d).select("event_id", S.load_calibration(raw).alias("c")).select("event_id", "c.*")


def client_calibration(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, F.concat(F.lit('{"rate": '), e.cast("string"), F.lit(', "latency": 600}'))).when(e % 3 == 1, F.lit('{"rate": -4, "latency": "x"}')).otherwise(F.lit('{"rate":'))
    return _events(spark, d).select("event_id", S.client_calibration(raw).alias("c")).select("event_id", "c.*")


def _reads(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in S.HISTORY_KINDS]), (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, d).select(F.concat(F.lit("s"), F.col("user_id") % 40).alias("source"), kind.alias("kind"), F.col("event_type").alias("title"), F.col("event_id").alias("seq"), F.col("value").alias("chars"))


def history_upsert(spark, d):
    return S.history_upsert(_reads(spark, d))


def history_recent(spark, d):
    return S.history_recent(S.history_upsert(_reads(spark, d))).select("id", "seq")


def history_read(spark, d):
    e = F.col("event_id").cast("string")
    raw = F.concat(F.lit('[{"id": "a'), e, F.lit('", "title": "t", "kind": "map", "chars": "many", "time": 5}, {"id": 7, "title": "t", "kind": "map"}, {"id": "b", "title": "t", "kind": "poem"}, {"id": "c", "title": "t", "kind": "book", "chars": '), e, F.lit(', "summary": 3, "thesis": "x"}'), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit("]")))
    return S.history_read(_events(spark, d).select("event_id", raw.alias("raw")), "event_id")


_REC = "SELECT event_id, 'u' || user_id AS url, props AS text, ts, event_id % 50 = 7 AS bad, CASE WHEN event_id % 50 = 7 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS fetched_at, event_id AS seq FROM events"
_STALE = f"(bad OR epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) >= {{}}::BIGINT * 3600000000)"
_CACHE = f"SELECT url, CASE WHEN seq % 10 <> 4 THEN text END AS text, fetched_at, {_STALE.format(72)} AS stale FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM ({_REC})) WHERE rn = 1"
_HIST = "SELECT source || '|' || kind || '|' || title AS id, * FROM (SELECT 's' || (user_id % 40) AS source, (['article', 'book', 'map', 'feynman', 'batch'])[CAST(event_id % 5 + 1 AS INT)] AS kind, event_type AS title, event_id AS seq, value AS chars FROM events)"
_HIST_TOP = f"SELECT id, seq, source, kind, title, chars FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM ({_HIST})) WHERE rn = 1 ORDER BY seq DESC LIMIT"

_TIMES = """WITH x AS (SELECT event_id, 'u' || user_id AS url, ts, event_id % 3 = 0 AS w, event_id % 7 = 0 AS ign, CASE WHEN event_id % 30 <> 9 THEN props END AS text FROM events),
  y AS (SELECT *, last_value(CASE WHEN w THEN ts END IGNORE NULLS) OVER u AS rec, last_value(CASE WHEN w THEN event_id END IGNORE NULLS) OVER u AS rec_id, last_value(CASE WHEN NOT w AND NOT ign THEN ts END IGNORE NULLS) OVER u AS looked, max(CASE WHEN w THEN ts END) OVER (ORDER BY ts, event_id) AS swept FROM x
    WINDOW u AS (PARTITION BY url ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  z AS (SELECT y.*, x.text AS rec_text, rec + INTERVAL 24 HOUR AS due FROM y LEFT JOIN x ON x.event_id = y.rec_id WHERE NOT y.w),
  o AS (SELECT *, CASE WHEN rec_text IS NULL THEN 'none' WHEN {gone} THEN 'gone' WHEN ts >= due AND NOT ign THEN '{stale}' ELSE 'hit' END AS outcome FROM z)
  SELECT event_id AS req_id, outcome, CASE WHEN outcome IN ('hit', 'expired') THEN rec END AS fetched_at, CASE WHEN outcome = 'hit' THEN md5(rec_text) END AS md5 FROM o"""

QUERIES = {f.__name__: f for f in (cache_stale, cache_write, cache_read, cache_policy, cache_over_time, memory_fallback, stream_cache, ewma_calibration, calibration_load, client_calibration, history_upsert, history_recent, history_read)}
ORACLE_SQL = {
    "cache_stale": f"SELECT event_id, {_STALE.format(168)} AS stale FROM ({_REC})",
    "cache_write": f"SELECT url, text, fetched_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS rn FROM ({_REC})) WHERE rn = 1 AND NOT {_STALE.format(72)} ORDER BY fetched_at DESC, url DESC LIMIT 200",
    "cache_read": f"SELECT e.event_id, 'u' || e.user_id AS url, c.text IS NOT NULL AS hit, c.fetched_at FROM events e LEFT JOIN (SELECT * FROM ({_CACHE}) WHERE text IS NOT NULL AND NOT stale) c ON c.url = 'u' || e.user_id",
    "cache_policy": f"""SELECT req_id, cache, md5(CASE WHEN hit THEN text ELSE coalesce(fetched, text) END) AS md5, CASE WHEN hit OR fetched IS NULL THEN fetched_at END AS fetched_at, CASE WHEN cache = 'fallback' THEN '抓取失败（timeout），已回退缓存全文' END AS note, NOT hit AND fetched IS NOT NULL AND fetched <> '环境异常' AS write FROM (
      SELECT *, CASE WHEN hit THEN 'hit' WHEN fetched IS NOT NULL THEN 'miss' WHEN text IS NOT NULL THEN 'fallback' END AS cache FROM (
      SELECT e.event_id AS req_id, c.text, c.fetched_at, CASE WHEN e.event_id % 3 = 1 THEN 'page ' || e.event_id WHEN e.event_id % 30 = 5 THEN '环境异常' END AS fetched, c.text IS NOT NULL AND e.event_id % 7 <> 0 AND NOT coalesce(c.stale, true) AS hit
      FROM events e LEFT JOIN (SELECT * FROM ({_CACHE}) WHERE text IS NOT NULL) c ON c.url = 'u' || e.user_id))""",
    "cache_over_time": _TIMES.format(gone="swept >= due OR looked >= due", stale="expired"),
    "memory_fallback": _TIMES.format(gone="false", stale="stale"),
    "stream_cache": _TIMES.format(gone="looked >= due", stale="expired") + " WHERE ceil(epoch_us(ts) / 1000) <= (SELECT floor(epoch_us(max(ts)) / 1000) FROM events) - 3600000",
    "ewma_calibration": """SELECT event_type, count(*) AS calls, list_reduce(list(r ORDER BY event_id), lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE) AS rate, list_reduce(list(l ORDER BY event_id), lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE) AS latency FROM (
      SELECT event_type, event_id, CASE WHEN event_id % 11 = 0 THEN -value ELSE value + 1 END AS r, CASE WHEN value * 100 - 200 > 0 THEN least(5000.0::DOUBLE, greatest(50.0::DOUBLE, value * 100 - 200)) ELSE 800.0::DOUBLE END AS l FROM events) WHERE r > 0 GROUP BY event_type""",
    "calibration_load": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id + 0.5::DOUBLE WHEN 2 THEN 64.0::DOUBLE END AS rate, CASE event_id % 4 WHEN 2 THEN 750.0::DOUBLE END AS latency, CASE event_id % 4 WHEN 0 THEN 3.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE END AS calls, CASE event_id % 4 WHEN 0 THEN 'x' END AS updated_at FROM events",
    "client_calibration": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id::DOUBLE ELSE 30.0::DOUBLE END AS rate, CASE WHEN event_id % 3 = 0 THEN 600.0::DOUBLE ELSE 800.0::DOUBLE END AS latency FROM events",
    "history_upsert": f"{_HIST_TOP} 20",
    "history_recent": f"SELECT id, seq FROM ({_HIST_TOP} 8)",
    "history_read": "SELECT event_id, pos, id, 't' AS title, kind, '' AS depth, '' AS source, chars, time, '' AS summary, thesis FROM (SELECT event_id, 0 AS pos, 'a' || event_id AS id, 'map' AS kind, 0 AS chars, 5 AS time, '' AS thesis FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, 3, 'c', 'book', event_id, 0, 'x' FROM events WHERE event_id % 5 <> 0)",
}
