"""Queries that render results of every kind, with their SQL. Conversations stand for results: their turns are the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import budget as B
from tessella.operators import render as R
from tessella.operators.sanitize import NO_EVIDENCE
from tessella.plans.budgets import ORACLE_SQL as _BUDGETS
from tessella.plans.budgets import _batches

_KINDS = [*R.TYPES, "其他", ""]
_SURE = [*R.CONFIDENCE, "", "x"]


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _talks(spark, d):
    """conv_id and its turns (t, role, x: text) in order."""
    x = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.struct(F.col("turn").cast("long").alias("t"), "role", F.coalesce("text", F.lit("")).alias("x")).alias("s"))
    return x.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("v")).withColumn("c", F.col("conv_id").cast("long"))


def _each(most, **fields):
    """The first turns as structs; a field is a function of the turn."""
    v = F.slice("v", 1, most) if most else F.col("v")
    return F.transform(v, lambda s: F.struct(*[f(s).alias(n) for n, f in fields.items()]))


def _role(s):
    return s["role"]


def _text(s):
    return s["x"]


def _blank(s):
    return F.lit("")


def _every(n, at, value, other=""):
    return lambda s: F.when(s["t"] % n == at, value(s)).otherwise(F.lit(other))


def _roles(most):
    return F.transform(F.slice("v", 1, most), _role)


def _texts(most):
    return F.transform(F.slice("v", 1, most), _text)


def _title():
    return F.concat(F.lit("会话 <"), F.col("c").cast("string"), F.lit(">"))


def _meta():
    c, n = F.col("c"), F.size("v").cast("long")
    stages = F.struct(F.when(c % 3 != 0, c * 37).alias("resolve_ms"), F.when(c % 3 != 1, c % 2 * 150).alias("extract_ms"), F.when(c % 5 != 0, n).alias("calls"), F.when(c % 7 != 0, c * 1234 + 56).alias("llm_ms"))
    return F.struct(
        _pick(("hit", "fallback", "miss", "disabled", ""), c).alias("cache"), F.lit("2024-01-05T06:07:08Z").alias("fetched_at"), F.when(c % 2 == 0, n).alias("calls"), (c * 3).alias("total_tokens"), (c.cast("double") / 4).alias("minutes"),
        F.when(c % 3 == 0, F.lit(" a&b ")).otherwise(F.lit("")).alias("source"), F.when(c % 4 != 3, c * 10).alias("chars"), _pick(("deep", "", "map"), c).alias("depth"), F.when(c % 2 == 0, n).alias("chunks"), F.when(c % 6 != 5, stages).alias("stages"),
    )


def _article(spark, d):
    x = _talks(spark, d)
    r = F.struct(
        _title().alias("title"), F.when(F.col("c") % 2 == 0, F.lit("s")).otherwise(F.lit("")).alias("summary"), F.element_at("v", 1)["x"].alias("thesis"), _each(10, claim=_text, evidence=_every(2, 0, _text), quote=_every(2, 1, _role), source=_role).alias("arguments"),
        _roles(12).alias("structure"), _each(10, term=_role, explanation=_every(3, 0, _text)).alias("concepts"), _each(8, text=_text, context=_every(3, 1, _role), source=_every(2, 1, _role)).alias("quotes"),
        _each(8, claim=_role, source=_every(2, 0, _role), quote=_every(2, 1, _text)).alias("citations"), _each(0, title=_every(3, 1, _blank, "章"), summary=_every(2, 1, _text)).alias("chapters"), _texts(8).alias("questions"),
    )
    return x.select("conv_id", r.alias("r"), _meta().alias("m"))


def _map(spark, d):
    x = _talks(spark, d)
    relation = lambda s: F.when(s["t"] % 3 == 0, F.array(F.struct(s["role"].alias("to"), F.lit("支持").alias("type")), F.struct(F.lit("").alias("to"), F.lit("x").alias("type")))).otherwise(F.expr("cast(array() as array<struct<to: string, type: string>>)"))
    items = _each(0, type=lambda s: _pick(_KINDS, s["t"] * 5 + F.col("c")), claim=_text, evidence=_every(2, 0, _text, NO_EVIDENCE), source=_every(4, 1, _role), confidence=lambda s: _pick(_SURE, s["t"] + F.col("c")), relations=relation)
    r = F.struct(
        _title().alias("title"), F.lit("s").alias("summary"), F.when(F.col("c") % 2 == 0, F.element_at("v", 1)["x"]).otherwise(F.lit("")).alias("core_question"), _roles(5).alias("core_conclusions"), items.alias("items"),
        _each(30, value=_text, period=_every(2, 0, _role), subject=_every(3, 0, _role), baseline=_blank, source=_role, location=_every(4, 3, _role)).alias("data_points"), _texts(15).alias("caveats"), _pick(("graph TD\n A-->B", ""), F.col("c")).alias("mermaid"),
        _pick(("", "# a\n- b"), F.col("c")).alias("outline"), _texts(5).alias("recall_questions"),
    )
    return x.select("conv_id", r.alias("r"), _meta().alias("m"))


def _feynman(spark, d):
    x = _talks(spark, d)
    points = lambda s: F.array(F.struct(s["x"].alias("claim"), _every(2, 0, _role)(s).alias("data"), _every(2, 1, _role, NO_EVIDENCE)(s).alias("evidence")))
    some = lambda n, at: lambda s: F.when(s["t"] % n == at, F.array(s["role"], s["x"])).otherwise(F.array().cast("array<string>"))
    r = F.struct(
        _title().alias("title"), F.lit("s").alias("summary"), F.element_at("v", 1)["x"].alias("thesis"), _roles(30).alias("toc"), _texts(6).alias("questions"),
        _each(0, index=lambda s: s["t"] + 1, title=_role, points=points, chapter_map=_every(2, 0, _role), explanation=_every(3, 0, _text), gaps=some(2, 1), corrections=some(3, 2)).alias("chapters"), _pick(("graph LR", ""), F.col("c")).alias("book_map"),
        _pick(("", "讲完"), F.col("c")).alias("final_explanation"), _each(5, interval=_role, focus=_text, method=_every(2, 0, _role)).alias("review_plan"),
    )
    return x.select("conv_id", r.alias("r"), _meta().alias("m"))


def _batch(spark, d):
    x = _talks(spark, d)
    themes = lambda most: _each(most, theme=_role, positions=lambda s: F.array(F.struct(s["role"].alias("doc"), s["x"].alias("view"))))
    r = F.struct(
        _pick(("", "对照"), F.col("c")).alias("title"), F.lit("s").alias("summary"), _each(10, index=lambda s: F.when(s["t"] % 3 != 2, s["t"] + 1), title=_every(4, 1, _blank, "篇"), chars=lambda s: F.when(s["t"] % 2 == 0, F.length(s["x"])), thesis=_every(2, 0, _text), summary=_every(3, 0, _role)).alias("items"),
        themes(8).alias("comparison"), themes(0 + 1).alias("conflicts"), _pick(("互补", ""), F.col("c")).alias("complementarity"), _texts(5).alias("questions"),
    )
    return x.select("conv_id", r.alias("r"), _meta().alias("m"))


def _digest(x):
    return x.select("conv_id", F.length("x").alias("chars"), F.md5("x").alias("md5"))


def render_markdown(spark, d):
    return _digest(_article(spark, d).select("conv_id", R.article_markdown(F.col("r"), R.meta_footer(F.col("m"))).alias("x")))


def render_map_md(spark, d):
    return _digest(_map(spark, d).select("conv_id", R.map_markdown(F.col("r"), R.meta_footer(F.col("m"))).alias("x")))


def render_feynman_md(spark, d):
    return _digest(_feynman(spark, d).select("conv_id", R.feynman_markdown(F.col("r"), R.meta_footer(F.col("m"))).alias("x")))


def render_batch_md(spark, d):
    return _digest(_batch(spark, d).select("conv_id", R.batch_markdown(F.col("r"), R.meta_footer(F.col("m"))).alias("x")))


def meta_footer(spark, d):
    return _talks(spark, d).select("conv_id", R.meta_footer(_meta()).alias("line"))


def export_html(spark, d):
    r = F.col("r")
    tree = R.article_branches(r["thesis"], r["arguments"], r["quotes"], r["chapters"])
    return _digest(_article(spark, d).select("conv_id", R.html_page("article", r["title"], F.col("m"), R.article_sections(r), tree).alias("x")))


def export_html_map(spark, d):
    r = F.col("r")
    return _digest(_map(spark, d).select("conv_id", R.html_page("map", r["title"], F.col("m"), R.map_sections(r), R.map_branches(r)).alias("x")))


def export_html_feynman(spark, d):
    r = F.col("r")
    return _digest(_feynman(spark, d).select("conv_id", R.html_page("feynman", r["title"], F.col("m"), R.feynman_sections(r), R.feynman_branches(r)).alias("x")))


def render_estimate_md(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    x = B.estimate_modes(docs)
    mode = F.struct("ord", "mode", "calls", "input_tokens", "output_tokens", "total_tokens", "minutes", "note")
    g = x.groupBy("doc_id").agg(F.array_sort(F.collect_list(mode)).alias("modes"), F.first("chars").alias("chars"), F.first("est_tokens_per_second").alias("rate"), F.first("est_latency_per_call_ms").alias("latency"))
    g = g.join(docs.select("doc_id", "source"), "doc_id")
    i = F.col("doc_id")
    e = F.struct("modes", F.when(i % 5 != 0, F.col("chars")).alias("chars"), (i % 3 == 0).alias("sampled"), (i % 2 == 0).alias("calibrated"), F.col("rate").alias("est_tokens_per_second"), F.col("latency").alias("est_latency_per_call_ms"))
    return g.select("doc_id", F.md5(R.estimate_markdown(F.col("source"), e)).alias("md5"))


def render_batch_estimate_md(spark, d):
    rows, totals = B.batch_estimate(_batches(spark, d))
    title = F.when(F.col("item") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("文 "), F.col("item").cast("string")))
    item = F.struct("item", F.col("item").alias("index"), title.alias("title"), "chars", "total_tokens", "minutes")
    x = rows.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("total_tokens").alias("own")).join(totals.drop("items", "chars"), "batch_id")
    rate = F.struct("items", (F.col("total_tokens") - F.col("own")).alias("final_tokens"), "total_calls", "total_tokens", "total_minutes", F.lit(100.0).alias("est_tokens_per_second"), F.lit(800).cast("long").alias("est_latency_per_call_ms"), (F.col("batch_id") % 2 == 0).alias("calibrated"))
    return x.select("batch_id", F.md5(R.batch_estimate_markdown(F.lit("批"), rate)).alias("md5"))


QUERIES = {f.__name__: f for f in (render_markdown, render_map_md, render_feynman_md, render_batch_md, meta_footer, export_html, export_html_map, export_html_feynman, render_estimate_md, render_batch_estimate_md)}

# -- the same as SQL

_N = "chr(10)"
_V = "SELECT conv_id, CAST(conv_id AS BIGINT) AS c, list(struct_pack(t := CAST(turn AS BIGINT), role := role, x := coalesce(text, '')) ORDER BY turn) AS v, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id"
_T = "('会话 <' || c || '>')"


def _number(x):
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def _sec(ms):
    return f"({_number(f'(floor(coalesce({ms}, 0)::DOUBLE / 100 + 0.5::DOUBLE) / 10.0::DOUBLE)')} || 's')"


def _some(v, n=""):
    """A numbered or plain list of strings joined by line breaks."""
    return f"array_to_string({v}, {_N})"


def _tr(v, body):
    return f"list_transform({v}, lambda s, i: {body})"


def _opts(before, value, after=""):
    return f"(CASE WHEN {value} <> '' THEN '{before}' || {value} || '{after}' ELSE '' END)"


def _saids(label, value):
    return f"(CASE WHEN {value} <> '' THEN {_N} || {_N} || '**{label}**：' || {value} ELSE '' END)"


def _lists(label, lines):
    return f"(CASE WHEN len({lines}) > 0 THEN {_N} || {_N} || '{label}' || {_N} || {_some(lines)} ELSE '' END)"


def _bold(label):
    return f"**{label}**："


def _if_t(n, at, value, other="''"):
    return f"(CASE WHEN s.t % {n} = {at} THEN {value} ELSE {other} END)"


def _of(values, at):
    return f"({list(values)!r})[CAST(({at}) % {len(values)} + 1 AS INT)]"


_RES, _EXT, _CALLS, _LLM = "(CASE WHEN c % 3 <> 0 THEN c * 37 END)", "(CASE WHEN c % 3 <> 1 THEN c % 2 * 150 END)", "(CASE WHEN c % 5 <> 0 THEN n END)", "(CASE WHEN c % 7 <> 0 THEN c * 1234 + 56 END)"
_TOTAL = f"(coalesce({_RES}, 0) + coalesce({_EXT}, 0) + coalesce({_LLM}, 0))"
_BITS = f"""list_filter([CASE WHEN c % 2 = 0 AND n > 0 THEN '分段 ' || n END, '抓取 ' || (CASE WHEN {_RES} IS NOT NULL THEN {_sec(_RES)} END), CASE WHEN {_EXT} > 0 THEN '解析 ' || {_sec(_EXT)} END,
  '模型 ' || {_CALLS} || ' 次 ' || {_sec(_LLM)}, CASE WHEN {_TOTAL} > 0 THEN '总 ' || {_sec(_TOTAL)} END], lambda b: b IS NOT NULL)"""
_FOOT = f"""('（来源：' || CASE WHEN c % 3 = 0 THEN 'a&b' ELSE '粘贴文本' END || ' · 字数：' || CASE WHEN c % 4 <> 3 THEN c * 10 ELSE 0 END || ' · 深度：' || (['deep', 'deep', 'map'])[CAST(c % 3 + 1 AS INT)]
  || CASE c % 5 WHEN 0 THEN ' · 缓存命中（抓取于 2024-01-05 06:07，未重新联网）' WHEN 1 THEN ' · 回退缓存（抓取于 2024-01-05 06:07）' WHEN 2 THEN ' · 已重新抓取并写入缓存' WHEN 3 THEN ' · 缓存已禁用' ELSE '' END
  || CASE WHEN c % 2 = 0 THEN ' · 本次预算：约 ' || n || ' 次调用 / ' || c * 3 || ' token / ≈' || {_number('(c::DOUBLE / 4)')} || ' 分钟' ELSE '' END
  || CASE WHEN c % 6 <> 5 AND len({_BITS}) > 0 THEN ' · ' || array_to_string({_BITS}, ' · ') ELSE '' END || '）')"""
_END = f"{_N} || {_N} || '---' || {_N} || {_N} || {_FOOT}"
_TH = "v[1].x"


def _md(*blocks):
    return f"SELECT conv_id, length(x) AS chars, md5(x) AS md5 FROM (SELECT conv_id, {' || '.join(blocks)} || {_END} AS x FROM ({_V}))"


_ARTICLE = _md(
    f"'# 📖 精读报告：' || {_T}", "CASE WHEN c % 2 = 0 THEN chr(10) || chr(10) || '**一句话总结**：s' ELSE '' END", _saids("核心论点", _TH),
    _lists(_bold("论证结构"), _tr("v[1:10]", f"i || '. ' || s.x || {_opts(' —— 论据：', _if_t(2, 0, 's.x'))}")), _saids("论证脉络", "array_to_string(list_transform(v[1:12], lambda s: s.role), ' → ')"),
    _saids("核心概念", "array_to_string(" + _tr("v[1:10]", f"s.role || {_opts('（', _if_t(3, 0, 's.x'), '）')}") + ", '；')"), _lists(_bold("金句摘录"), _tr("v[1:8]", f"'- “' || s.x || '”' || {_opts('（', _if_t(2, 1, 's.role'), '）')}")),
    _lists(_bold("引用溯源"), _tr("v[1:8]", f"i || '. ' || s.role || {_opts(' — 位置：', _if_t(2, 0, 's.role'))} || {_opts(' — 原文：“', _if_t(2, 1, 's.x'), '”')}")),
    _lists(_bold("各部分脉络"), _tr("v", f"i || '. ' || (CASE WHEN s.t % 3 = 1 THEN '第 ' || i || ' 部分' ELSE '章' END) || {_opts('：', _if_t(2, 1, 's.x'))}")), _lists(_bold("批判性思考"), _tr("v[1:8]", "'- ' || s.x")),
)
_KIND = f"(CASE WHEN {_of(_KINDS, 's.t * 5 + c')} = '' THEN '分论点' ELSE {_of(_KINDS, 's.t * 5 + c')} END)"
_CONF = _of(_SURE, "s.t + c")
_EVID = _if_t(2, 0, "s.x", f"'{NO_EVIDENCE}'")
_MAP_MD = _md(
    f"'# 🗺️ 知识地图：' || {_T}", _saids("摘要", "'s'"), _saids("核心问题", f"(CASE WHEN c % 2 = 0 THEN {_TH} ELSE '' END)"), _lists(_bold("核心结论"), _tr("v[1:5]", "i || '. ' || s.role")),
    _lists(_bold("观点与证据表"), _tr("v", f"i || '. [' || {_KIND} || '] ' || s.x || {_N} || '   证据：' || (CASE WHEN {_EVID} = '' THEN '{NO_EVIDENCE}' ELSE {_EVID} END) || {_opts('（', _if_t(4, 1, 's.role'), '）')} || {_opts(' [', _CONF, ']')} || (CASE WHEN s.t % 3 = 0 AND s.role <> '' THEN {_N} || '   ↳ 支持 → ' || s.role ELSE '' END)")),
    _lists(_bold("关键数据表"), _tr("v[1:30]", f"'- ' || s.x || {_opts(' · 时间：', _if_t(2, 0, 's.role'))} || {_opts(' · 对象：', _if_t(3, 0, 's.role'))} || {_opts(' · 来源：', 's.role')} || {_opts(' · 位置：', _if_t(4, 3, 's.role'))}")),
    _lists(_bold("反对意见与局限"), _tr("v[1:15]", "'- ' || s.x")), f"CASE WHEN c % 2 = 0 THEN {_N} || {_N} || '**Mermaid 思维导图**：' || {_N} || '```mermaid' || {_N} || 'graph TD' || {_N} || ' A-->B' || {_N} || '```' ELSE '' END",
    f"CASE WHEN c % 2 = 1 THEN {_N} || {_N} || '**XMind 大纲**：' || {_N} || '```markdown' || {_N} || '# a' || {_N} || '- b' || {_N} || '```' ELSE '' END", _lists(_bold("主动回忆问题"), _tr("v[1:5]", "i || '. ' || s.x")),
)
_CHAPTER = f"""{_N} || {_N} || '## 第 ' || (s.t + 1) || ' 章：' || s.role || {_N} || {_N} || '**观点 · 数据 · 证据**：' || {_N} || '1. ' || s.x || {_opts('（数据：', _if_t(2, 0, 's.role'), '）')} || ' —— 证据：' || {_if_t(2, 1, 's.role', f"'{NO_EVIDENCE}'")}
  || (CASE WHEN s.t % 2 = 0 THEN {_N} || {_N} || '**章节导图**：' || {_N} || '```mermaid' || {_N} || s.role || {_N} || '```' ELSE '' END) || (CASE WHEN s.t % 3 = 0 AND s.x <> '' THEN {_N} || {_N} || '**费曼讲解（合上书）**：' || {_N} || s.x ELSE '' END)
  || (CASE WHEN s.t % 2 = 1 THEN {_N} || {_N} || '**知识缺口**：' || {_N} || '- ' || s.role || {_N} || '- ' || s.x ELSE '' END) || (CASE WHEN s.t % 3 = 2 THEN {_N} || {_N} || '**原文修正**：' || {_N} || '- ' || s.role || {_N} || '- ' || s.x ELSE '' END)"""
_FEYNMAN_MD = _md(
    f"'# 🧠 费曼读书报告：' || {_T}", _saids("一句话总结", "'s'"), _saids("核心论点", _TH), _lists(_bold("目录"), _tr("v[1:30]", "'- ' || s.role")), _lists(_bold("阅读问题清单"), _tr("v[1:6]", "i || '. ' || s.x")), f"array_to_string({_tr('v', _CHAPTER)}, '')",
    f"CASE WHEN c % 2 = 0 THEN {_N} || {_N} || '## 合并全书导图' || {_N} || '```mermaid' || {_N} || 'graph LR' || {_N} || '```' ELSE {_N} || {_N} || '## 再讲一次（全书终讲）' || {_N} || '讲完' END",
    _lists("## 间隔复习计划", _tr("v[1:5]", f"'- **' || s.role || '**：' || s.x || {_opts('（', _if_t(2, 0, 's.role'), '）')}")),
)
_THEME = f"{_N} || '### ' || i || '. ' || s.role || {_N} || '- **' || s.role || '**：' || s.x"
_BATCH_MD = _md(
    "'# 🔀 跨篇对比：' || CASE WHEN c % 2 = 0 THEN '批量精读' ELSE '对照' END", _saids("综合结论", "'s'"),
    _lists("## 各篇速览", _tr("v[1:10]", f"{_N} || '### ' || (CASE WHEN s.t % 3 <> 2 THEN (s.t + 1) || '. ' ELSE '' END) || (CASE WHEN s.t % 4 = 1 THEN '未命名' ELSE '篇' END) || (CASE WHEN s.t % 2 = 0 THEN '（' || length(s.x) || ' 字）' ELSE '' END) || {_opts(chr(10) + '- 核心论点：', _if_t(2, 0, 's.x'))} || {_opts(chr(10) + '- 摘要：', _if_t(3, 0, 's.role'))}")),
    _lists("## 对比矩阵", _tr("v[1:8]", _THEME)), _lists("## 冲突点", _tr("v[1:1]", _THEME)), f"CASE WHEN c % 2 = 0 THEN {_N} || {_N} || '## 互补关系' || {_N} || '互补' ELSE '' END", _lists("## 跨篇追问", _tr("v[1:5]", "i || '. ' || s.x")),
)


def _e(x):
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _j(v, body):
    return f"array_to_string({_tr(v, body)}, '')"


def _div(css, value, before="", after=""):
    return f"(CASE WHEN {value} <> '' THEN '<div class=\"{css}\">{before}' || {_e(value)} || '{after}</div>' ELSE '' END)"


def _ol(css, v, body, name="ol"):
    return f"'<{name} class=\"{css}\">' || {_j(v, body)} || '</{name}>'"


def _sect(title, cond, body):
    return f"CASE WHEN {cond} THEN struct_pack(h := {title}, b := {body}) END"


def _html(kind, sections, tree):
    """The page of the sections (list of structs h, b) and the tree's branches."""
    label = R.KINDS[kind]
    style = R.STYLE.replace("'", "''")
    num = lambda i: f"'<span class=\"num\">' || lpad(CAST({i} AS VARCHAR), 2, '0') || '</span>'"
    return f"""SELECT conv_id, length(x) AS chars, md5(x) AS md5 FROM (SELECT conv_id, '<!DOCTYPE html>' || {_N} || '<html lang="zh-CN"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><style>{style}</style><title>' || {_e(_T)} || ' · {label}</title></head><body><div class="wrap">'
      || '<header class="hero"><div class="kicker"><span>{label}</span><span>' || (['深度精读', '精读', '知识地图'])[CAST(c % 3 + 1 AS INT)] || '</span>' || CASE WHEN c % 4 <> 3 THEN '<span>约 ' || c * 10 || ' 字</span>' ELSE '' END || '</div><h1>' || {_e(_T)} || '</h1>' || CASE WHEN c % 3 = 0 THEN '<div class="src">来源 ·  a&amp;b </div>' ELSE '' END || '</header>'
      || array_to_string(list_transform(secs, lambda s, i: '<section class="sec"><h2>' || {num('i')} || {_e('s.h')} || '</h2>' || s.b || '</section>'), '') || '<section class="sec"><h2>' || {num('len(secs) + 1')} || '思维导图</h2><ul class="tree"><li><div class="node t0">' || {_e(_T)} || '</div>'
      || '<ul>' || {tree} || '</ul></li></ul></section><footer class="ft"><span>文件可离线打开 · 支持深色模式</span></footer></div></body></html>' AS x
      FROM (SELECT *, {sections} AS secs FROM ({_V})))"""


def _listed(*sections):
    return f"list_filter([{', '.join(sections)}], lambda s: s IS NOT NULL)"


def _branches(title, kids, cond="true"):
    return f"(CASE WHEN {cond} THEN '<li><div class=\"node t1\">{title}</div><ul>' || {kids} || '</ul></li>' ELSE '' END)"


def _leafs(v, text, below="''"):
    return _j(v, f"'<li><div class=\"node t2\">' || {_e(text)} || '</div>' || {below} || '</li>'")


def _under(text, cond):
    return f"(CASE WHEN {cond} THEN '<ul><li><div class=\"node t2\">' || {_e(text)} || '</div></li></ul>' ELSE '' END)"


def _cut(x, n):
    return f"substr({x}, 1, {n})"


_LI = "'<li>' || {} || '</li>'"
_HTML_ARTICLE = _html(
    "article",
    _listed(
        _sect("'一句话总结'", "c % 2 = 0", "'<p class=\"lead\">s</p>'"), _sect("'核心论点'", f"{_TH} <> ''", f"'<div class=\"hl\">' || {_e(_TH)} || '</div>'"),
        _sect("'论证结构'", "true", _ol("concl", "v[1:10]", f"'<li><span class=\"claim\">' || {_e('s.x')} || '</span>' || {_div('ev', _if_t(2, 0, 's.x'), '论据 · ')} || {_div('quote', _if_t(2, 1, 's.role'), '“', '”')} || '</li>'")),
        _sect("'金句摘录'", "true", _ol("list", "v[1:8]", f"'<li>“' || {_e('s.x')} || '”' || {_div('ev', _if_t(3, 1, 's.role'))} || '</li>'", "ul")),
        _sect("'核心概念'", "true", _ol("list", "v[1:10]", f"'<li><b>' || {_e('s.role')} || '</b>' || (CASE WHEN s.t % 3 = 0 AND s.x <> '' THEN ' — ' || {_e('s.x')} ELSE '' END) || '</li>'", "ul")),
        _sect("'章节脉络'", "true", _ol("list", "v", f"'<li>' || (CASE WHEN s.t % 3 = 1 THEN '' ELSE '章' END) || {_div('ev', _if_t(2, 1, 's.x'))} || '</li>'")), _sect("'批判性思考'", "true", _ol("list", "v[1:8]", _LI.format(_e("s.x")), "ul")),
    ),
    " || ".join(
        (
            _branches("核心论点", f"'<li><div class=\"node t2\">' || {_e(_TH)} || '</div></li>'", f"{_TH} <> ''"), _branches("论证结构", _leafs("v[1:10]", _cut("s.x", 60), _under("'论据：' || " + _cut("s.x", 80), "s.t % 2 = 0 AND s.x <> ''"))),
            _branches("金句摘录", _leafs("v[1:8]", _cut("s.x", 60))), _branches("章节脉络", _leafs("v", "(CASE WHEN s.t % 3 = 1 THEN '' ELSE '章' END)", _under(_cut("s.x", 60), "s.t % 2 = 1 AND s.x <> ''"))),
        )
    ),
)
_LEGEND = '<div class="legend"><span class="legend-label">置信度</span><span class="chip c-author">作者原意</span><span class="chip c-fact">原文事实与数据</span><span class="chip c-infer">合理推断</span><span class="chip c-unknown">无法确认</span></div>'
_CSS = f"(CASE {_CONF} WHEN '作者原意' THEN 'c-author' WHEN '原文事实与数据' THEN 'c-fact' WHEN '合理推断' THEN 'c-infer' WHEN '无法确认' THEN 'c-unknown' ELSE '' END)"
_TAGS = f"(CASE WHEN s.t % 4 = 1 AND s.role <> '' THEN '<span class=\"chip plain\">位置 ' || {_e('s.role')} || '</span>' ELSE '' END || CASE WHEN {_CONF} <> '' THEN '<span class=\"chip ' || {_CSS} || '\">' || {_e(_CONF)} || '</span>' ELSE '' END)"
_ITEM = f"""'<div class="item"><div class="claim"><span class="idx">' || i || '</span>' || {_e('s.x')} || '</div>' || (CASE WHEN {_EVID} = '' THEN '' ELSE CASE WHEN {_EVID} = '{NO_EVIDENCE}' THEN '<div class="ev ev-missing">' ELSE '<div class="ev">' END || '证据 · ' || {_e(_EVID)} || '</div>' END)
  || (CASE WHEN {_TAGS} <> '' THEN '<div class="tags">' || {_TAGS} || '</div>' ELSE '' END) || (CASE WHEN s.t % 3 = 0 AND s.role <> '' THEN '<div class="rel">支持 → ' || {_e('s.role')} || '</div>' ELSE '' END) || '</div>'"""


def _typed(t):
    return f"list_filter(v, lambda s: {_KIND} = '{t}')"


def _bit(value, label):
    return f"(CASE WHEN {value} <> '' THEN '<span>{label} ' || {_e(value)} || '</span>' ELSE '' END)"


_META = f"({_bit(_if_t(2, 0, 's.role'), '时间')} || {_bit(_if_t(3, 0, 's.role'), '对象')} || {_bit('s.role', '来源')} || {_bit(_if_t(4, 3, 's.role'), '位置')})"
_CELL = f"'<div class=\"dcell\"><div class=\"dval\">' || {_e('s.x')} || '</div>' || (CASE WHEN {_META} <> '' THEN '<div class=\"dmeta\">' || {_META} || '</div>' ELSE '' END) || '</div>'"
_RAW_KIND = _of(_KINDS, "s.t * 5 + c")
_HTML_MAP = _html(
    "map",
    _listed(
        _sect("'摘要'", "true", "'<p class=\"lead\">s</p>'"), _sect("'核心问题'", f"c % 2 = 0 AND {_TH} <> ''", f"'<div class=\"hl\"><span class=\"hl-label\">作者试图回答</span>' || {_e(_TH)} || '</div>'"), _sect("'核心结论'", "true", _ol("concl", "v[1:5]", _LI.format(_e("s.role")))),
        *[_sect(f"'{t}'", f"len({_typed(t)}) > 0", f"'{_LEGEND}' || {_j(_typed(t), _ITEM)}") for t in R.TYPES],
        _sect("'关键数据'", "true", f"'<div class=\"dgrid\">' || {_j('v[1:30]', _CELL)} || '</div>'"), _sect("'反对意见与局限'", "true", _ol("list", "v[1:15]", _LI.format(_e("s.x")), "ul")),
        _sect("'Mermaid 思维导图'", "c % 2 = 0", f"'<pre class=\"pre\">graph TD' || {_N} || ' A--&gt;B</pre><p class=\"note\">复制到 mermaid.live 或支持 Mermaid 的编辑器渲染</p>'"), _sect("'XMind 大纲'", "c % 2 = 1", f"'<pre class=\"pre\"># a' || {_N} || '- b</pre>'"),
        _sect("'主动回忆问题'", "true", _ol("list", "v[1:5]", _LI.format(_e("s.x")))),
    ),
    " || ".join(
        (
            _branches("核心问题", f"'<li><div class=\"node t2\">' || {_e(_TH)} || '</div></li>'", f"c % 2 = 0 AND {_TH} <> ''"), _branches("核心结论", _leafs("v[1:5]", "s.role")),
            *[_branches(t, _leafs(f"list_filter(v, lambda s: {_RAW_KIND} = '{t}')", _cut("s.x", 60), _under("'证据：' || " + _cut("s.x", 80), "s.t % 2 = 0 AND s.x <> ''")), f"len(list_filter(v, lambda s: {_RAW_KIND} = '{t}')) > 0") for t in R.TREE_TYPES],
            _branches("关键数据", _leafs("v[1:30]", _cut("s.x", 60))), _branches("反对意见与局限", _leafs("v[1:15]", _cut("s.x", 60))), _branches("主动回忆问题", _leafs("v[1:5]", _cut("s.x", 60))),
        )
    ),
)
_CHAPTER_HTML = f"""'<ol class="concl"><li><span class="claim">' || {_e('s.x')} || '</span>' || {_div('ev', _if_t(2, 0, 's.role'), '数据 · ')} || {_div('ev', _if_t(2, 1, 's.role', f"'{NO_EVIDENCE}'"), '证据 · ')} || '</li></ol>' || (CASE WHEN s.t % 2 = 0 AND s.role <> '' THEN '<pre class="pre">' || {_e('s.role')} || '</pre>' ELSE '' END)
  || {_div('hl', _if_t(3, 0, 's.x'), '<span class="hl-label">合上书讲解</span>')} || (CASE WHEN s.t % 2 = 1 THEN '<p class="ev-missing">知识缺口：' || {_e('s.role')} || '；' || {_e('s.x')} || '</p>' ELSE '' END) || (CASE WHEN s.t % 3 = 2 THEN '<p class="ev">原文修正：' || {_e('s.role')} || '；' || {_e('s.x')} || '</p>' ELSE '' END)"""
_PLAN = f"'<div class=\"it\"><span class=\"claim\">' || {_e('s.role')} || '</span><div class=\"ev\">' || {_e('s.x')} || (CASE WHEN s.t % 2 = 0 AND s.role <> '' THEN '（' || {_e('s.role')} || '）' ELSE '' END) || '</div></div>'"
_HTML_FEYNMAN = _html(
    "feynman",
    "list_concat(list_concat("
    + _listed(_sect("'一句话总结'", "true", "'<p class=\"lead\">s</p>'"), _sect("'核心论点'", f"{_TH} <> ''", f"'<div class=\"hl\">' || {_e(_TH)} || '</div>'"), _sect("'浏览目录'", "true", _ol("list", "v[1:30]", _LI.format(_e("s.role")))), _sect("'阅读问题清单'", "true", _ol("list", "v[1:6]", _LI.format(_e("s.x")))))
    + ", " + _tr("v", f"struct_pack(h := '第 ' || (s.t + 1) || ' 章 · ' || s.role, b := {_CHAPTER_HTML})") + "), "
    + _listed(_sect("'合并全书导图'", "c % 2 = 0", "'<pre class=\"pre\">graph LR</pre>'"), _sect("'再讲一次（全书终讲）'", "c % 2 = 1", "'<div class=\"hl\">讲完</div>'"), _sect("'间隔复习计划'", "true", _j("v[1:5]", _PLAN)))
    + ")",
    " || ".join(
        (
            _branches("目录", _leafs("v[1:30]", _cut("s.role", 50))), _branches("阅读问题", _leafs("v[1:6]", _cut("s.x", 50))), _branches("章节", _leafs("v", "'第 ' || (s.t + 1) || ' 章 ' || " + _cut("s.role", 30), _under(_cut("s.x", 50), "true"))),
            _branches("间隔复习", _leafs("v[1:5]", _cut("(s.role || ' ' || s.x)", 50))),
        )
    ),
)
_BASIS = "中文≈0.6 token/字，拉丁≈0.25 token/字符；"
_ESTIMATE = f"""SELECT e.doc_id, md5('# 🧮 预算预检：' || any_value(d.source) || {_N} || {_N} || '**口径**：{_BASIS}输出按各阶段预算计；时间=(总token÷100 tok/s)+(调用次数×800ms)。' || {_N} || {_N} || '| 模式 | 调用次数 | 输入 token | 输出 token | 总 token | 预计耗时 | 说明 |' || {_N} || '| --- | --- | --- | --- | --- | --- | --- |' || {_N}
  || string_agg('| ' || mode || ' | ' || calls || ' | ' || input_tokens || ' | ' || output_tokens || ' | ' || total_tokens || ' | ≈ ' || {_number('minutes')} || ' 分钟 | ' || note || ' |', {_N} ORDER BY ord)
  || CASE WHEN e.doc_id % 5 <> 0 THEN {_N} || {_N} || '输入字数：' || any_value(e.chars) || '（超过 400000 会被截断）' ELSE '' END || CASE WHEN e.doc_id % 3 = 0 THEN {_N} || {_N} || '> 本预检采用 PDF 采样外推（前 2 页字数 ÷ 2 × 总页数），仅作数量级参考。' ELSE '' END
  || CASE WHEN e.doc_id % 2 = 0 THEN {_N} || {_N} || '> 已使用运行时实测校准速率（100 tok/s / 800ms）。' ELSE '' END || {_N} || {_N} || '> 估算基于本地字数启发式与默认速率/延迟，实际取决于模型速度、负载与网络。') AS md5
  FROM ({_BUDGETS["estimate_modes"]}) e JOIN documents d ON d.doc_id = e.doc_id GROUP BY e.doc_id"""
_BATCH_ESTIMATE = f"""SELECT batch_id, md5('# 🧮 预算预检：批' || {_N} || {_N} || '**口径**：{_BASIS}时间=(总token÷100 tok/s)+(调用次数×800ms)。' || {_N} || {_N} || i.x || {_N} || '- **跨篇对比**（1 次）· 约 ' || (t.total_tokens - i.own) || ' token' || {_N} || {_N}
  || '**合计**：' || t.total_calls || ' 次调用 · 约 ' || t.total_tokens || ' token · 预计 ' || {_number('t.total_minutes')} || ' 分钟' || CASE WHEN batch_id % 2 = 0 THEN {_N} || {_N} || '> 已使用运行时实测校准速率（100 tok/s / 800ms）。' ELSE '' END) AS md5
  FROM (SELECT batch_id, sum(total_tokens)::BIGINT AS own, string_agg('- **#' || item || ' ' || CASE WHEN item % 3 = 0 THEN '未命名' ELSE '文 ' || item END || '**（' || chars || ' 字）· 1 次调用 · 约 ' || total_tokens || ' token · 约 ' || {_number('minutes')} || ' 分钟', {_N} ORDER BY item) AS x FROM ({_BUDGETS["batch_estimate"]}) GROUP BY batch_id) i
  JOIN ({_BUDGETS["batch_totals"]}) t USING (batch_id)"""
ORACLE_SQL = {
    "render_batch_estimate_md": _BATCH_ESTIMATE,
    "render_markdown": _ARTICLE, "render_map_md": _MAP_MD, "render_feynman_md": _FEYNMAN_MD, "render_batch_md": _BATCH_MD, "meta_footer": f"SELECT conv_id, {_FOOT} AS line FROM ({_V})",
    "export_html": _HTML_ARTICLE, "export_html_map": _HTML_MAP, "export_html_feynman": _HTML_FEYNMAN, "render_estimate_md": _ESTIMATE,
}
