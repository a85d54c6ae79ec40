"""Token and time budgets per reading mode: column arithmetic, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import BATCH_ITEMS, QUICK_CHARS, SHORT_TEXT, STRUCTURE_CHARS, Config
from tessella.functions import text as T

#: Tokens of a prompt, of one part's condensed summary, and of outputs.
OVERHEAD, SUMMARY = 600, 400
OUT_QUICK, OUT_SHORT, OUT_PART = 2500, 4000, 5000
#: Tokens per second and milliseconds of latency by model family; the first match counts.
MODEL_RATES = [
    ("deepseek", 100, 700),
    ("kimi|moonshot", 110, 700),
    ("glm|chatglm", 100, 700),
    ("qwen", 110, 700),
    ("doubao|seed", 90, 800),
    ("claude|anthropic", 70, 900),
    ("gemini", 80, 800),
    ("gpt|openai", 90, 800),
]
DEFAULT_RATE, DEFAULT_LATENCY = 100, 800
#: What the panel assumes before anything was measured.
PANEL_RATE, PANEL_LATENCY = 30, 800
MODES = ("quick", "deep", "book", "map", "feynman")


@dataclass(frozen=True)
class Rates:
    """Speed of a model: tokens per second, latency of a call, and whether it was measured."""

    rate: float = DEFAULT_RATE
    latency: float = DEFAULT_LATENCY
    calibrated: bool = False


def model_rates(model: Column) -> tuple[Column, Column]:
    m = F.lower(F.coalesce(model, F.lit("")))
    rate, latency = F.lit(DEFAULT_RATE), F.lit(DEFAULT_LATENCY)
    for pattern, r, ms in reversed(MODEL_RATES):
        rate, latency = F.when(m.rlike(pattern), F.lit(r)).otherwise(rate), F.when(m.rlike(pattern), F.lit(ms)).otherwise(latency)
    return rate, latency


def effective(calibrated: Column, configured: Column, default: Column) -> Column:
    """Measured if positive and finite, else configured if positive, else the model's default."""
    good = F.when(~F.isnan(calibrated) & (calibrated > 0) & (calibrated < F.lit(float("inf"))), calibrated)
    return F.coalesce(good, F.when(configured > 0, configured), default).cast("double")


def call(calls: Column, inputs: Column, outputs: Column, rate: Column, latency: Column, calibrated: Column) -> Column:
    """The estimate of some calls as a struct."""
    r, ms = rate.cast("double"), latency.cast("double")
    minutes = (inputs + outputs).cast("double") / r / F.lit(60.0) + (calls.cast("double") * ms) / F.lit(60000.0)
    shown = T.round_half_up(r, 10)
    whole = F.floor(ms + 0.5)
    formula = F.concat(F.lit("（("), inputs.cast("string"), F.lit("+"), outputs.cast("string"), F.lit(") ÷ "), T.number(shown), F.lit(" tok/s + "), calls.cast("string"), F.lit(" 次 × "), whole.cast("string"), F.lit("ms）"))
    return F.struct(
        calls.cast("long").alias("calls"), inputs.cast("long").alias("input_tokens"), outputs.cast("long").alias("output_tokens"), (inputs + outputs).cast("long").alias("total_tokens"),
        T.round_half_up(minutes, 10).alias("minutes"), formula.alias("minutes_formula"), shown.alias("est_tokens_per_second"), whole.alias("est_latency_per_call_ms"), calibrated.alias("calibrated"),
    )


def _counted(x: DataFrame, config: Config) -> DataFrame:
    """Adds chars, length and the token counts of the cuts that the modes need. Each count is a column of its own, computed once."""
    x = x.withColumn("rest", T.beyond_ascii(F.col("text"))).withColumns({"cjk": T.count_of(F.col("rest"), T.CJK), "wide": T.count_of(F.col("rest"), T.ASTRAL)})
    n, left = F.length("text").cast("long"), F.length("rest").cast("long")
    x = x.withColumn("chars", n + F.col("wide")).withColumn("length", F.least("chars", F.lit(config.max_input_chars).cast("long")))
    whole = T.weighed(F.col("cjk"), n - left, left + F.col("wide") - F.col("cjk"))
    x = x.withColumn("t_all", F.when(F.col("chars") <= config.max_input_chars, whole).otherwise(T.tokens(T.prefix(F.col("text"), config.max_input_chars)))).drop("rest", "cjk", "wide")
    for name, most in (("t_chunk", config.chunk_chars), ("t_quick", QUICK_CHARS), ("t_struct", STRUCTURE_CHARS)):
        # most texts are shorter than any of the cuts: their one count serves all modes
        x = x.withColumn("cut", F.when(F.col("length") > most, T.prefix(F.col("text"), most))).withColumn("rest", T.beyond_ascii(F.col("cut")))
        x = x.withColumns({"cjk": T.count_of(F.col("rest"), T.CJK), "wide": T.count_of(F.col("rest"), T.ASTRAL)})
        n, left = F.length("cut").cast("long"), F.length("rest").cast("long")
        cut = T.weighed(F.col("cjk"), n - left, left + F.col("wide") - F.col("cjk"))
        x = x.withColumn(name, F.when(F.col("length") <= most, F.col("t_all")).otherwise(cut)).drop("cut", "rest", "cjk", "wide")
    return x.drop("text")


def _modes(x: DataFrame, config: Config, rates: Rates) -> DataFrame:
    """Five rows per row of ``x``, from length and the token counts."""
    parts = F.least(F.ceil(F.col("length").cast("double") / config.chunk_chars), F.lit(config.max_parts)).cast("long")
    x = x.withColumn("parts", parts).withColumn("some", F.greatest(F.lit(1).cast("long"), "parts")).withColumn("long", F.col("length") > SHORT_TEXT)
    parts, some, long, per = F.col("parts"), F.col("some"), F.col("long"), F.col("t_chunk") + OVERHEAD
    total, single = parts * SUMMARY + OVERHEAD, F.col("t_all") + OVERHEAD
    p, s = parts.cast("string"), some.cast("string")

    def row(mode: str, note: Column, calls: Column, inputs: Column, outputs: Column) -> Column:
        return F.struct(F.lit(mode).alias("mode"), note.alias("note"), calls.cast("long").alias("calls"), inputs.cast("long").alias("i"), outputs.cast("long").alias("o"))

    def either(mode: str, short_note: str, out_short: int, note: Column) -> Column:
        return row(
            mode, F.when(long, note).otherwise(F.lit(short_note)), F.when(long, parts + 1).otherwise(F.lit(1)),
            F.when(long, parts * per + total).otherwise(single), F.when(long, parts * OUT_PART + OUT_PART).otherwise(F.lit(out_short)),
        )

    rows = F.array(
        row("quick", F.lit("单次调用，输入截断至 30000 字"), F.lit(1), F.col("t_quick") + OVERHEAD, F.lit(OUT_QUICK)),
        either("deep", "短文单次调用", OUT_SHORT, F.concat(F.lit("分 "), p, F.lit(" 段逐段精读 + 1 次综合"))),
        row("book", F.concat(F.lit("全书分 "), s, F.lit(" 部分精读并汇总")), some + 1, some * per + total, some * OUT_PART + OUT_PART),
        either("map", "短文单次知识地图", OUT_PART, F.concat(F.lit("分 "), p, F.lit(" 段提取 + 1 次汇总"))),
        row(
            "feynman", F.concat(F.when(long, F.lit("目录提问 1 次 + ")).otherwise(F.lit("")), F.lit("分 "), s, F.lit(" 章 + 合并导图与复习计划 1 次")),
            some + F.when(long, F.lit(2)).otherwise(F.lit(1)), some * per + F.when(long, F.col("t_struct") + OVERHEAD).otherwise(F.lit(0)) + total, some * OUT_PART + OUT_PART,
        ),
    )
    keep = [c for c in x.columns if c not in ("length", "t_all", "t_chunk", "t_quick", "t_struct", "parts", "some", "long")]
    x = x.select(*keep, F.posexplode(rows).alias("ord", "m")).select(*keep, "ord", "m.*")
    e = call(F.col("calls"), F.col("i"), F.col("o"), F.lit(float(rates.rate)), F.lit(float(rates.latency)), F.lit(rates.calibrated))
    return x.select(*keep, "ord", "mode", "note", e.alias("e")).select(*keep, "ord", "mode", "note", "e.*")


def estimate_modes(docs: DataFrame, key: str = "doc_id", config: Config = Config(), rates: Rates = Rates()) -> DataFrame:
    """Five rows per document, in the order of MODES."""
    return _modes(_counted(docs.select(key, F.coalesce("text", F.lit("")).alias("text")), config), config, rates)


def extrapolated(stats: DataFrame, key: str, config: Config = Config(), rates: Rates = Rates()) -> DataFrame:
    """Estimates from sampled pages: columns pages, sample_pages, sample_chars, sample_tokens."""
    pages = F.when(F.col("sample_pages") > 0, F.col("sample_pages")).otherwise(F.lit(2))
    chars = F.greatest(F.lit(1.0), F.floor(F.col("sample_chars").cast("double") / pages * F.coalesce(F.col("pages"), F.lit(1)) + 0.5).cast("double"))
    ratio = F.when((F.col("sample_chars") > 0) & (F.col("sample_tokens") > 0), F.col("sample_tokens").cast("double") / F.col("sample_chars")).otherwise(F.lit(0.6))
    x = stats.select(key, chars.cast("long").alias("chars"), ratio.alias("ratio")).withColumn("length", F.least("chars", F.lit(config.max_input_chars).cast("long")))
    for name, most in (("t_all", config.max_input_chars), ("t_chunk", config.chunk_chars), ("t_quick", QUICK_CHARS), ("t_struct", STRUCTURE_CHARS)):
        cut = F.lit(most).cast("long") if name == "t_struct" else F.least("length", F.lit(most).cast("long"))
        x = x.withColumn(name, F.ceil(cut.cast("double") * F.col("ratio")).cast("long"))
    return _modes(x.drop("ratio"), config, rates).withColumn("sampled", F.lit(True))


def batch_estimate(docs: DataFrame, config: Config = Config(), rates: Rates = Rates()) -> tuple[DataFrame, DataFrame]:
    """Per document of a batch (batch_id, item 1.., text; the first ten count) its quick row, and per batch the totals."""
    text = T.prefix(T.newlines(F.coalesce(F.col("text"), F.lit(""))), config.max_input_chars)
    x = docs.where(F.col("item") <= BATCH_ITEMS).select("batch_id", "item", text.alias("text")).withColumn("chars", T.units(F.col("text")))
    x = x.select("batch_id", "item", "chars", (T.tokens(T.prefix(F.col("text"), QUICK_CHARS)) + OVERHEAD).alias("i"))
    e = call(F.lit(1), F.col("i"), F.lit(OUT_QUICK).cast("long"), F.lit(float(rates.rate)), F.lit(float(rates.latency)), F.lit(rates.calibrated))
    rows = x.select("batch_id", "item", "chars", e.alias("e")).select("batch_id", "item", "chars", "e.*")
    n = F.count("*")
    final_in = n * SUMMARY + OVERHEAD
    calls, toks = F.sum("calls") + 1, F.sum("total_tokens") + final_in + OUT_PART
    minutes = toks.cast("double") / F.lit(float(rates.rate)) / F.lit(60.0) + (calls.cast("double") * F.lit(float(rates.latency))) / F.lit(60000.0)
    totals = rows.groupBy("batch_id").agg(n.alias("items"), F.sum("chars").alias("chars"), calls.alias("total_calls"), toks.alias("total_tokens"), T.round_half_up(minutes, 10).alias("total_minutes"))
    return rows, totals


#: What a budget request that is no POST, or that names no source, is told.
ONLY_POST, NO_SOURCE = "仅支持 POST", "请提供 url、path 或 text（至少其一）"


def envelopes(requests: DataFrame, sources: DataFrame, config: Config = Config(), rates: Rates = Rates()) -> DataFrame:
    """Answers of the budget endpoint: req_id, status, ok, error, chars, source, source_kind, note, cache, modes, est_tokens_per_second, est_latency_per_call_ms, calibrated.

    ``requests``: req_id, method, url, path, text. ``sources``: what they resolve to (req_id, text, source, source_kind, note, cache, error).
    """
    named = (T.or_else(F.col("url")) != "") | (T.or_else(F.col("path")) != "") | (T.or_else(F.col("text")) != "")
    refused = F.when(F.upper(F.coalesce("method", F.lit(""))) != "POST", ONLY_POST).when(~named, NO_SOURCE)
    asked = requests.select("req_id", refused.alias("refused"))
    x = asked.join(sources.withColumnRenamed("text", "body"), "req_id", "left").withColumn("error", F.coalesce("refused", "error"))
    good = x.where("error is null").select("req_id", F.col("body").alias("text"))
    m = F.struct("ord", "mode", "note", "calls", "input_tokens", "output_tokens", "total_tokens", "minutes", "minutes_formula")
    e = estimate_modes(good, "req_id", config, rates).groupBy("req_id").agg(
        F.array_sort(F.collect_list(m)).alias("modes"), F.first("chars").alias("chars"), F.first("est_tokens_per_second").alias("est_tokens_per_second"), F.first("est_latency_per_call_ms").alias("est_latency_per_call_ms"), F.first("calibrated").alias("calibrated")
    )
    ok = F.col("error").isNull()
    status = F.when(F.col("refused") == ONLY_POST, 405).when(ok | F.col("refused").isNotNull(), 200).otherwise(500)
    own = [F.when(ok, F.when(F.col(c) != "", F.col(c)) if c == "note" else F.col(c)).alias(c) for c in ("source", "source_kind", "note", "cache")]
    return x.join(e, "req_id", "left").select("req_id", status.alias("status"), ok.alias("ok"), "error", "chars", *own, "modes", "est_tokens_per_second", "est_latency_per_call_ms", "calibrated")
