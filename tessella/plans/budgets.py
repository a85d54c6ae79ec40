"""Queries of token classes, estimates, batches and model speeds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import budget as B


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def estimate_modes(spark: SparkSession, d: str) -> DataFrame:
    return B.estimate_modes(_documents(spark, d))


def client_estimate(spark: SparkSession, d: str) -> DataFrame:
    x = B.estimate_modes(_documents(spark, d), rates=B.Rates(B.PANEL_RATE, B.PANEL_LATENCY))
    return x.select("doc_id", "mode", "calls", "input_tokens", "output_tokens", "total_tokens", "minutes")


def char_classes(spark: SparkSession, d: str) -> DataFrame:
    cjk, latin, other = T.class_counts(F.col("text"))
    return _documents(spark, d).select("doc_id", cjk.alias("cjk"), latin.alias("latin"), other.alias("other"), T.tokens(F.col("text")).alias("tokens"))


def estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.units(F.col("text")).alias("chars"), T.tokens(F.col("text")).alias("tokens"))


def estimate_call(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 21 + 1).alias("calls"), (F.col("event_id") * 37 % 50000).alias("i"), (F.col("event_id") * 11 % 9000).alias("o"))
    e = B.call(F.col("calls"), F.col("i"), F.col("o"), F.lit(90.0) + F.col("event_id") % 7, F.lit(700.0), F.lit(False))
    return x.select("event_id", e.alias("e")).select("event_id", "e.*")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select(F.floor(F.col("doc_id") / 12).alias("batch_id"), (F.col("doc_id") % 12 + 1).alias("item"), "text")


def batch_estimate(spark: SparkSession, d: str) -> DataFrame:
    return B.batch_estimate(_batches(spark, d))[0].drop("minutes_formula")


def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return B.batch_estimate(_batches(spark, d))[1]


_MODELS = ["DeepSeek-V3", "moonshot-v1", "glm-4", "Qwen2.5-72B", "doubao-pro", "seed-oss", "Claude-x", "gemini-pro", "gpt-4o", "openai/o3", "llama-3", ""]


def model_rate_defaults(spark: SparkSession, d: str) -> DataFrame:
    model = F.element_at(F.array(*[F.lit(m) for m in _MODELS]), (F.col("event_id") % len(_MODELS) + 1).cast("int"))
    rate, latency = B.model_rates(model)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", model.alias("model"), rate.cast("long").alias("rate"), latency.cast("long").alias("latency"))


def effective_speed(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/events.parquet")
    measured = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, -F.col("value"))
    configured = F.when(F.col("event_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(55.0))
    return x.select("event_id", B.effective(measured, configured, F.lit(100.0)).alias("rate"), B.effective(measured * 10, configured, F.lit(800.0)).alias("latency"))


def extrapolate_chars(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("event_id") % 400 + 1).alias("pages"), F.lit(2).alias("sample_pages"), (F.col("event_id") * 13 % 5000).alias("sample_chars"), (F.col("event_id") * 7 % 3000).alias("sample_tokens"))
    return B.extrapolated(x, "event_id").select("event_id", "chars", "mode", "calls", "input_tokens", "output_tokens", "minutes", "sampled")


def _cls(t: str) -> str:
    cjk = f"(length({t}) - length(regexp_replace({t}, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3000}}-\\x{{303f}}\\x{{ff00}}-\\x{{ffef}}]', '', 'g')))"
    latin = f"(length({t}) - length(regexp_replace({t}, '[\\x20-\\x7e]', '', 'g')))"
    wide = f"(length({t}) + length({t}) - length(regexp_replace({t}, '[\\x{{10000}}-\\x{{10ffff}}]', '', 'g')))"
    return f"{cjk} AS cjk, {latin} AS latin, {wide} - {cjk} - {latin} AS other, {wide} AS chars"


def _tok(t: str) -> str:
    return f"(SELECT CAST(ceil(cjk * 0.6::DOUBLE + latin * 0.25::DOUBLE + other * 0.5::DOUBLE) AS BIGINT) FROM (SELECT {_cls(t)}))"


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def _modes_sql(rate: float, latency: float, key: str = "doc_id", base: str | None = None) -> str:
    base = base or f"""SELECT doc_id, chars, least(chars, 400000) AS l, {_tok("text")} AS t_all, {_tok("substr(text, 1, 6000)")} AS t6, {_tok("substr(text, 1, 30000)")} AS t30, {_tok("substr(text, 1, 5000)")} AS t5
      FROM (SELECT doc_id, coalesce(text, '') AS text, length(text) AS chars FROM documents)"""
    return f"""
    WITH a AS ({base}),
    b AS (SELECT *, CAST(least(ceil(l / 6000.0::DOUBLE), 20) AS BIGINT) AS p FROM a),
    c AS (SELECT *, greatest(1, p) AS s, t6 + 600 AS per, p * 400 + 600 AS total, l > 9000 AS long FROM b),
    m AS (
      SELECT {key}, chars, 0 AS ord, 'quick' AS mode, '单次调用，输入截断至 30000 字' AS note, 1 AS calls, t30 + 600 AS i, 2500 AS o FROM c
      UNION ALL SELECT {key}, chars, 1, 'deep', CASE WHEN long THEN '分 ' || p || ' 段逐段精读 + 1 次综合' ELSE '短文单次调用' END, CASE WHEN long THEN p + 1 ELSE 1 END, CASE WHEN long THEN p * per + total ELSE t_all + 600 END, CASE WHEN long THEN p * 5000 + 5000 ELSE 4000 END FROM c
      UNION ALL SELECT {key}, chars, 2, 'book', '全书分 ' || s || ' 部分精读并汇总', s + 1, s * per + total, s * 5000 + 5000 FROM c
      UNION ALL SELECT {key}, chars, 3, 'map', CASE WHEN long THEN '分 ' || p || ' 段提取 + 1 次汇总' ELSE '短文单次知识地图' END, CASE WHEN long THEN p + 1 ELSE 1 END, CASE WHEN long THEN p * per + total ELSE t_all + 600 END, CASE WHEN long THEN p * 5000 + 5000 ELSE 5000 END FROM c
      UNION ALL SELECT {key}, chars, 4, 'feynman', CASE WHEN long THEN '目录提问 1 次 + ' ELSE '' END || '分 ' || s || ' 章 + 合并导图与复习计划 1 次', s + CASE WHEN long THEN 2 ELSE 1 END, s * per + CASE WHEN long THEN t5 + 600 ELSE 0 END + total, s * 5000 + 5000 FROM c
    )
    SELECT {key}, chars, ord, mode, note, CAST(calls AS BIGINT) AS calls, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(i + o AS BIGINT) AS total_tokens,
      floor(((i + o)::DOUBLE / {rate}::DOUBLE / 60.0::DOUBLE + (calls::DOUBLE * {latency}::DOUBLE) / 60000.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS minutes,
      '（(' || i || '+' || o || ') ÷ ' || {int(rate)} || ' tok/s + ' || calls || ' 次 × ' || {int(latency)} || 'ms）' AS minutes_formula,
      {rate}::DOUBLE AS est_tokens_per_second, {int(latency)}::BIGINT AS est_latency_per_call_ms, false AS calibrated
    FROM m"""


_BATCH = f"""SELECT doc_id // 12 AS batch_id, doc_id % 12 + 1 AS item, length(text) AS chars, 1::BIGINT AS calls, {_tok("substr(text, 1, 30000)")} + 600 AS input_tokens, 2500::BIGINT AS output_tokens FROM documents WHERE doc_id % 12 < 10"""
_SAMPLED = """SELECT event_id, chars, chars AS n, least(chars, 400000) AS l, CAST(ceil(least(chars, 400000)::DOUBLE * r) AS BIGINT) AS t_all, CAST(ceil(least(chars, 400000, 6000)::DOUBLE * r) AS BIGINT) AS t6,
   CAST(ceil(least(chars, 400000, 30000)::DOUBLE * r) AS BIGINT) AS t30, CAST(ceil(5000::DOUBLE * r) AS BIGINT) AS t5
   FROM (SELECT event_id, CAST(greatest(1, floor((event_id * 13 % 5000)::DOUBLE / 2 * (event_id % 400 + 1) + 0.5)) AS BIGINT) AS chars,
     CASE WHEN event_id * 13 % 5000 > 0 AND event_id * 7 % 3000 > 0 THEN (event_id * 7 % 3000)::DOUBLE / (event_id * 13 % 5000) ELSE 0.6::DOUBLE END AS r FROM events)"""
_RATE_SQL = " ".join(f"WHEN regexp_matches(m, '{p}') THEN {{{i}}}" for i, (p, _, _) in enumerate(B.MODEL_RATES))

QUERIES = {f.__name__: f for f in (estimate_modes, client_estimate, char_classes, estimate_tokens, estimate_call, batch_estimate, batch_totals, model_rate_defaults, effective_speed, extrapolate_chars)}
ORACLE_SQL = {
    "estimate_modes": _modes_sql(100.0, 800.0),
    "client_estimate": f"SELECT doc_id, mode, calls, input_tokens, output_tokens, total_tokens, minutes FROM ({_modes_sql(30.0, 800.0)})",
    "char_classes": f"SELECT doc_id, cjk, latin, other, CAST(ceil(cjk * 0.6::DOUBLE + latin * 0.25::DOUBLE + other * 0.5::DOUBLE) AS BIGINT) AS tokens FROM (SELECT doc_id, {_cls('text')} FROM documents)",
    "estimate_tokens": f"SELECT item_id, chars, CAST(ceil(cjk * 0.6::DOUBLE + latin * 0.25::DOUBLE + other * 0.5::DOUBLE) AS BIGINT) AS tokens FROM (SELECT item_id, {_cls('text')} FROM benchmark)",
    "estimate_call": f"""WITH x AS (SELECT event_id, event_id % 21 + 1 AS calls, event_id * 37 % 50000 AS i, event_id * 11 % 9000 AS o, 90.0::DOUBLE + event_id % 7 AS r FROM events)
      SELECT event_id, calls, i AS input_tokens, o AS output_tokens, i + o AS total_tokens, floor(((i + o)::DOUBLE / r / 60.0::DOUBLE + (calls::DOUBLE * 700.0::DOUBLE) / 60000.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS minutes,
      '（(' || i || '+' || o || ') ÷ ' || ({_num('r')}) || ' tok/s + ' || calls || ' 次 × 700ms）' AS minutes_formula, r AS est_tokens_per_second, 700::BIGINT AS est_latency_per_call_ms, false AS calibrated FROM x""",
    "batch_estimate": f"""SELECT *, input_tokens + output_tokens AS total_tokens, floor(((input_tokens + output_tokens)::DOUBLE / 100.0::DOUBLE / 60.0::DOUBLE + 800.0::DOUBLE / 60000.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS minutes,
      100.0::DOUBLE AS est_tokens_per_second, 800::BIGINT AS est_latency_per_call_ms, false AS calibrated FROM ({_BATCH})""",
    "batch_totals": f"""SELECT batch_id, items, chars, total_calls, total_tokens, floor((total_tokens::DOUBLE / 100.0::DOUBLE / 60.0::DOUBLE + (total_calls::DOUBLE * 800.0::DOUBLE) / 60000.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS total_minutes FROM (
      SELECT batch_id, count(*) AS items, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(calls) + 1 AS BIGINT) AS total_calls, CAST(sum(input_tokens + output_tokens) + count(*) * 400 + 600 + 5000 AS BIGINT) AS total_tokens FROM ({_BATCH}) GROUP BY batch_id)""",
    "model_rate_defaults": f"""SELECT event_id, model, CAST(CASE {_RATE_SQL.format(*[r for _, r, _ in B.MODEL_RATES])} ELSE 100 END AS BIGINT) AS rate, CAST(CASE {_RATE_SQL.format(*[r for _, _, r in B.MODEL_RATES])} ELSE 800 END AS BIGINT) AS latency
      FROM (SELECT *, lower(model) AS m FROM (SELECT event_id, ({_MODELS!r})[CAST(event_id % {len(_MODELS)} + 1 AS INT)] AS model FROM events))""",
    "effective_speed": """SELECT event_id, coalesce(CASE WHEN m > 0 THEN m END, CASE WHEN c > 0 THEN c END, 100.0::DOUBLE) AS rate, coalesce(CASE WHEN m * 10 > 0 THEN m * 10 END, CASE WHEN c > 0 THEN c END, 800.0::DOUBLE) AS latency FROM (
      SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN -value END AS m, CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE ELSE 55.0::DOUBLE END AS c FROM events)""",
    "extrapolate_chars": f"SELECT event_id, chars, mode, calls, input_tokens, output_tokens, minutes, true AS sampled FROM ({_modes_sql(100.0, 800.0, 'event_id', _SAMPLED)})",
}
