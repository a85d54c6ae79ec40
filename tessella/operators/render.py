"""Results as trees and texts: grouped items, mind trees as node tables, outlines and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators.sanitize import NO_EVIDENCE, NO_RELATION, NO_TYPE
from tessella.sources.document_files import distinct_names, write_files
from tessella.tables import Scratch

#: Item types in the order of reports, those that mind trees show, and classes of the confidence labels.
TYPES = ("核心结论", "分论点", "原因或作用机制", "事实", "数据", "案例", "隐含前提", "反对意见", "限制条件", "可执行建议")
TREE_TYPES = ("分论点", "原因或作用机制", "事实", "案例", "限制条件", "可执行建议")
CONFIDENCE = {"作者原意": "c-author", "原文事实与数据": "c-fact", "合理推断": "c-infer", "无法确认": "c-unknown"}
#: Headings of the branches, and how long titles may be.
ROOT, QUESTION, CONCLUSIONS, EVIDENCE, DATA, CAVEATS, RECALL = "精读报告", "核心问题", "核心结论", "证据：", "关键数据", "反对意见与局限", "主动回忆问题"
THESIS, ARGUMENTS, GROUNDS, QUOTES, CHAPTERS = "核心论点", "论证结构", "论据：", "金句摘录", "章节脉络"
#: Titles of the Markdown reports, then headings of their blocks: a reading's, a map's, a Feynman reading's, a comparison's.
R_ARTICLE, R_MAP, R_FEYNMAN, R_BATCH, R_ESTIMATE = "📖 精读报告", "🗺️ 知识地图", "🧠 费曼读书报告", "🔀 跨篇对比", "🧮 预算预检"
ONE_LINE, LINE, TERMS, CITED, PARTS, CRITICAL = "一句话总结", "论证脉络", "核心概念", "引用溯源", "各部分脉络", "批判性思考"
ABSTRACT, CLAIMS, DATA_TABLE, MERMAID, XMIND = "摘要", "观点与证据表", "关键数据表", "Mermaid 思维导图", "XMind 大纲"
THREE, CHAPTER_MAP, GAPS, CORRECTIONS, CONTENTS, TO_ASK, BOOK_MAP = "观点 · 数据 · 证据", "章节导图", "知识缺口", "原文修正", "目录", "阅读问题清单", "合并全书导图"
SYNTHESIS, EACH, MATRIX, CONFLICTS_MD, ACROSS = "综合结论", "各篇速览", "对比矩阵", "冲突点", "跨篇追问"


def confidence_class(c: Column) -> Column:
    out = F.lit("")
    for label, name in CONFIDENCE.items():
        out = F.when(c == label, F.lit(name)).otherwise(out)
    return out


def group_by_type(items: DataFrame, key: str, order: str) -> DataFrame:
    """Per key and type the claims in their order; blank types count as the default one, unknown types are left out."""
    kind = T.or_else(F.col("type"), NO_TYPE)
    rank = F.coalesce(*[F.when(kind == t, F.lit(i)) for i, t in enumerate(TYPES)])
    x = items.select(key, rank.alias("type_order"), kind.alias("type"), F.struct(order, "claim").alias("s")).where("type_order is not null")
    g = x.groupBy(key, "type_order", "type").agg(F.array_sort(F.collect_list("s")).alias("s"), F.count("*").alias("n"))
    return g.select(key, "type_order", "type", "n", F.transform("s", lambda s: s["claim"]).alias("claims"))


def _branch(title: str, kids: Column) -> Column:
    return F.struct(F.lit(title).alias("title"), kids.alias("kids"))


def _leaf(title: Column) -> Column:
    return F.struct(title.alias("title"), F.array().cast("array<string>").alias("kids"))


def _with(title: Column, below: Column) -> Column:
    """A node with one node below it, or none if that is null."""
    return F.struct(title.alias("title"), F.when(below.isNotNull(), F.array(below)).otherwise(F.array().cast("array<string>")).alias("kids"))


def _some(branches: list[Column]) -> Column:
    return F.filter(F.array(*branches), lambda b: F.size(b["kids"]) > 0)


def _of_type(items: Column, kind: str) -> Column:
    return F.filter(items, lambda i: i["type"] == kind)


def _evidence(item: Column) -> Column:
    return F.when((item["evidence"] != "") & (item["evidence"] != NO_EVIDENCE), F.concat(F.lit(EVIDENCE), T.prefix(item["evidence"], 80)))


def map_branches(m: Column) -> Column:
    """Branches (title, kids of title and kids) below the root of a knowledge map."""
    out = [_branch(QUESTION, F.when(m["core_question"] != "", F.array(_leaf(m["core_question"]))).otherwise(F.expr("cast(array() as array<struct<title: string, kids: array<string>>>)")))]
    out.append(_branch(CONCLUSIONS, F.transform(m["core_conclusions"], _leaf)))
    for t in TREE_TYPES:
        out.append(_branch(t, F.transform(_of_type(m["items"], t), lambda i: _with(T.prefix(i["claim"], 60), _evidence(i)))))
    out.append(_branch(DATA, F.transform(m["data_points"], lambda d: _leaf(T.prefix(d["value"], 60)))))
    out.append(_branch(CAVEATS, F.transform(m["caveats"], lambda c: _leaf(T.prefix(c, 60)))))
    out.append(_branch(RECALL, F.transform(m["recall_questions"], lambda q: _leaf(T.prefix(q, 60)))))
    return _some(out)


def article_branches(thesis: Column, arguments: Column, quotes: Column, chapters: Column) -> Column:
    none = F.expr("cast(array() as array<struct<title: string, kids: array<string>>>)")
    grounds = lambda a: F.when(a["evidence"] != "", F.concat(F.lit(GROUNDS), T.prefix(a["evidence"], 80)))
    return _some(
        [
            _branch(THESIS, F.when(thesis != "", F.array(_leaf(thesis))).otherwise(none)),
            _branch(ARGUMENTS, F.transform(arguments, lambda a: _with(T.prefix(a["claim"], 60), grounds(a)))),
            _branch(QUOTES, F.transform(quotes, lambda q: _leaf(T.prefix(q["text"], 60)))),
            _branch(CHAPTERS, F.transform(chapters, lambda c: _with(T.prefix(c["title"], 50), F.when(c["summary"] != "", T.prefix(c["summary"], 60))))),
        ]
    )


def mind_tree(results: DataFrame, key: str, title: str = "title", branches: str = "branches") -> DataFrame:
    """Node table: key, path (places of the ancestors and of the node), depth, title. The root has path ''."""
    root = results.select(key, F.lit("").alias("path"), F.lit(0).alias("depth"), T.or_else(F.col(title), ROOT).alias("title"))
    b = results.select(key, F.posexplode(branches).alias("i", "b"))
    top = b.select(key, F.col("i").cast("string").alias("path"), F.lit(1).alias("depth"), F.col("b.title").alias("title"))
    k = b.select(key, "i", F.posexplode("b.kids").alias("j", "k"))
    mid = k.select(key, F.concat_ws(".", "i", "j").alias("path"), F.lit(2).alias("depth"), F.col("k.title").alias("title"))
    low = k.select(key, "i", "j", F.posexplode("k.kids").alias("l", "t")).select(key, F.concat_ws(".", "i", "j", "l").alias("path"), F.lit(3).alias("depth"), F.col("t").alias("title"))
    return root.unionByName(top).unionByName(mid).unionByName(low)


def freemind(title: Column, branches: Column) -> Column:
    """The tree as FreeMind XML, two spaces of indent a level."""

    def node(t: Column, kids: Column, indent: str) -> Column:
        head = F.concat(F.lit(f'{indent}<node TEXT="'), T.escape_html(t), F.lit('"'))
        return F.when(F.length(kids) == 0, F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), kids, F.lit(f"\n{indent}</node>")))

    leaf = lambda t: node(t, F.lit(""), "        ")
    mid = lambda k: node(k["title"], F.array_join(F.transform(k["kids"], leaf), "\n"), "      ")
    top = lambda b: node(b["title"], F.array_join(F.transform(b["kids"], mid), "\n"), "    ")
    root = node(T.or_else(title, ROOT), F.array_join(F.transform(branches, top), "\n"), "  ")
    return F.concat(F.lit('<map version="1.0.1">\n'), root, F.lit("\n</map>"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _lines(*texts: Column | str) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])


def _if(cond: Column, *parts: Column) -> Column:
    """The lines of all parts, or none."""
    return F.when(cond, F.concat(*parts)).otherwise(_none())


def _around(before: str, value: Column, after: str = "") -> Column:
    """The value between two texts, or nothing if it is blank."""
    return F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise(F.lit(""))


def _said(label: str, value: Column) -> Column:
    return _if(value != "", _lines("", F.concat(F.lit(f"**{label}**："), value)))


def _numbered(texts: Column) -> Column:
    return F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t))


def _bulleted(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.concat(F.lit("- "), t))


def _listed(label: str, lines: Column) -> Column:
    return _if(F.size(lines) > 0, _lines("", f"**{label}**："), lines)


def _flat(items: Column, lines) -> Column:
    return F.flatten(F.transform(items, lines))


def _fenced(label: str, kind: str, value: Column, heading: bool = False) -> Column:
    return _if(value != "", _lines("", f"## {label}" if heading else f"**{label}**：", f"```{kind}", value, "```"))


def _report(title: Column, footer: Column, *blocks: Column) -> Column:
    return F.array_join(F.concat(_lines(title), *blocks, _lines("", "---", "", footer)), "\n")


def _heading(mark: str, title: Column, fallback: str = "未命名") -> Column:
    return F.concat(F.lit(f"# {mark}："), T.or_else(title, fallback))


def _seconds(ms: Column) -> Column:
    return F.concat(T.number(F.floor(F.coalesce(ms, F.lit(0)).cast("double") / 100 + 0.5).cast("double") / 10), F.lit("s"))


def meta_footer(m: Column) -> Column:
    """Source, length, depth, cache status, budget, and times of the stages of a result; parts that are missing are left out.

    ``m``: source, chars, depth, cache, fetched_at; calls, total_tokens, minutes (the budget of the depth, or nulls); chunks;
    stages (resolve_ms, extract_ms, calls, llm_ms; null without any).
    """
    cache = T.cache_label(m["cache"], m["fetched_at"])
    budget = F.when(m["calls"].isNotNull(), F.concat(F.lit(" · 本次预算：约 "), m["calls"].cast("string"), F.lit(" 次调用 / "), m["total_tokens"].cast("string"), F.lit(" token / ≈"), T.number(m["minutes"]), F.lit(" 分钟"))).otherwise(F.lit(""))
    st = m["stages"]
    total = sum((F.coalesce(st[k], F.lit(0)) for k in ("resolve_ms", "extract_ms", "llm_ms")), F.lit(0))
    bits = F.array_compact(
        F.array(
            F.when(m["chunks"] > 0, F.concat(F.lit("分段 "), m["chunks"].cast("string"))), F.when(st["resolve_ms"].isNotNull(), F.concat(F.lit("抓取 "), _seconds(st["resolve_ms"]))),
            F.when(st["extract_ms"] > 0, F.concat(F.lit("解析 "), _seconds(st["extract_ms"]))), F.when(st["calls"].isNotNull(), F.concat(F.lit("模型 "), st["calls"].cast("string"), F.lit(" 次 "), _seconds(st["llm_ms"]))),
            F.when(total > 0, F.concat(F.lit("总 "), _seconds(total))),
        )
    )
    times = F.when(st.isNotNull() & (F.size(bits) > 0), F.concat(F.lit(" · "), F.array_join(bits, " · "))).otherwise(F.lit(""))
    head = F.concat(F.lit("（来源："), T.or_else(m["source"], T.PASTED), F.lit(" · 字数："), F.coalesce(m["chars"], F.lit(0)).cast("string"), F.lit(" · 深度："), T.or_else(m["depth"], "deep"))
    return F.concat(head, _around(" · ", cache), budget, times, F.lit("）"))


def article_markdown(r: Column, footer: Column) -> Column:
    """A reading (title, summary, thesis, arguments, structure, concepts, quotes, citations, chapters, questions) as Markdown."""
    arguments = F.transform(r["arguments"], lambda a: F.concat(a["claim"], _around(" —— 论据：", a["evidence"])))
    concepts = F.transform(r["concepts"], lambda c: F.concat(c["term"], _around("（", c["explanation"], "）")))
    quotes = F.transform(r["quotes"], lambda q: F.concat(F.lit("- “"), q["text"], F.lit("”"), _around("（", q["source"], "）")))
    citations = F.transform(r["citations"], lambda c: F.concat(c["claim"], _around(" — 位置：", c["source"]), _around(" — 原文：“", c["quote"], "”")))
    chapters = F.transform(r["chapters"], lambda c, i: F.concat(F.when(c["title"] != "", c["title"]).otherwise(F.concat(F.lit("第 "), (i + 1).cast("string"), F.lit(" 部分"))), _around("：", c["summary"])))
    return _report(
        _heading(R_ARTICLE, r["title"]), footer, _said(ONE_LINE, r["summary"]), _said(THESIS, r["thesis"]), _listed(ARGUMENTS, _numbered(arguments)),
        _said(LINE, F.array_join(r["structure"], " → ")), _said(TERMS, F.array_join(concepts, "；")), _listed(QUOTES, quotes), _listed(CITED, _numbered(citations)),
        _listed(PARTS, _numbered(chapters)), _listed(CRITICAL, _bulleted(r["questions"])),
    )


def map_markdown(m: Column, footer: Column) -> Column:
    """A knowledge map as Markdown."""

    def item(o: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(". ["), T.or_else(o["type"], NO_TYPE), F.lit("] "), o["claim"])
        proof = F.concat(F.lit("   证据："), T.or_else(o["evidence"], NO_EVIDENCE), _around("（", o["source"], "）"), _around(" [", o["confidence"], "]"))
        known = F.filter(o["relations"], lambda x: x["to"] != "")
        return F.concat(_lines(head, proof), F.transform(known, lambda x: F.concat(F.lit("   ↳ "), T.or_else(x["type"], NO_RELATION), F.lit(" → "), x["to"])))

    parts = (("period", "时间"), ("subject", "对象"), ("baseline", "基准"), ("source", "来源"), ("location", "位置"))
    data = F.transform(m["data_points"], lambda d: F.concat(F.lit("- "), d["value"], *[_around(f" · {label}：", d[f]) for f, label in parts]))
    return _report(
        _heading(R_MAP, m["title"]), footer, _said(ABSTRACT, m["summary"]), _said(QUESTION, m["core_question"]), _listed(CONCLUSIONS, _numbered(m["core_conclusions"])), _listed(CLAIMS, _flat(m["items"], item)),
        _listed(DATA_TABLE, data), _listed(CAVEATS, _bulleted(m["caveats"])), _fenced(MERMAID, "mermaid", m["mermaid"]), _fenced(XMIND, "markdown", m["outline"]), _listed(RECALL, _numbered(m["recall_questions"])),
    )


def feynman_markdown(r: Column, footer: Column) -> Column:
    """A Feynman reading (title, summary, thesis, toc, questions, chapters, book_map, final_explanation, review_plan) as Markdown."""

    def chapter(c: Column) -> Column:
        points = F.transform(c["points"], lambda p: F.concat(p["claim"], _around("（数据：", p["data"], "）"), _around(" —— 证据：", p["evidence"])))
        return F.concat(
            _lines("", F.concat(F.lit("## 第 "), c["index"].cast("string"), F.lit(" 章："), c["title"])), _listed(THREE, _numbered(points)), _fenced(CHAPTER_MAP, "mermaid", c["chapter_map"]),
            _if(c["explanation"] != "", _lines("", "**费曼讲解（合上书）**：", c["explanation"])), _listed(GAPS, _bulleted(c["gaps"])), _listed(CORRECTIONS, _bulleted(c["corrections"])),
        )

    plan = F.transform(r["review_plan"], lambda x: F.concat(F.lit("- **"), x["interval"], F.lit("**："), x["focus"], _around("（", x["method"], "）")))
    return _report(
        _heading(R_FEYNMAN, r["title"]), footer, _said(ONE_LINE, r["summary"]), _said(THESIS, r["thesis"]), _listed(CONTENTS, _bulleted(r["toc"])), _listed(TO_ASK, _numbered(r["questions"])), _flat(r["chapters"], chapter),
        _fenced(BOOK_MAP, "mermaid", r["book_map"], True), _if(r["final_explanation"] != "", _lines("", "## 再讲一次（全书终讲）", r["final_explanation"])), _if(F.size(plan) > 0, _lines("", "## 间隔复习计划"), plan),
    )


def batch_markdown(r: Column, footer: Column) -> Column:
    """A comparison (title, summary, items of index, title, chars, thesis, summary; comparison, conflicts, complementarity, questions) as Markdown."""

    def item(o: Column) -> Column:
        place = F.when(o["index"].isNotNull(), F.concat(o["index"].cast("string"), F.lit(". "))).otherwise(F.lit(""))
        size = F.when(o["chars"].isNotNull(), F.concat(F.lit("（"), o["chars"].cast("string"), F.lit(" 字）"))).otherwise(F.lit(""))
        return F.concat(
            _lines("", F.concat(F.lit("### "), place, T.or_else(o["title"], "未命名"), size)), _if(o["thesis"] != "", _lines(F.concat(F.lit("- 核心论点："), o["thesis"]))),
            _if(o["summary"] != "", _lines(F.concat(F.lit("- 摘要："), o["summary"]))),
        )

    def theme(c: Column, i: Column) -> Column:
        return F.concat(_lines("", F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), c["theme"])), F.transform(c["positions"], lambda x: F.concat(F.lit("- **"), x["doc"], F.lit("**："), x["view"])))

    part = lambda title, lines: _if(F.size(lines) > 0, _lines("", f"## {title}"), lines)
    return _report(
        _heading(R_BATCH, r["title"], "批量精读"), footer, _said(SYNTHESIS, r["summary"]), part(EACH, _flat(r["items"], item)), part(MATRIX, _flat(r["comparison"], theme)), part(CONFLICTS_MD, _flat(r["conflicts"], theme)),
        _if(r["complementarity"] != "", _lines("", "## 互补关系", r["complementarity"])), part(ACROSS, _numbered(r["questions"])),
    )


def _whole(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("string")


def _basis(e: Column) -> tuple[Column, Column]:
    """Rate and latency of an estimate as texts."""
    return T.number(F.coalesce(e["est_tokens_per_second"], F.lit(100.0))), T.number(F.coalesce(e["est_latency_per_call_ms"].cast("double"), F.lit(800.0)))


def estimate_markdown(source: Column, e: Column, most_chars: int = 400_000) -> Column:
    """The table of an estimate: modes (mode, calls, input_tokens, output_tokens, total_tokens, minutes, note), chars, sampled, calibrated, est_tokens_per_second, est_latency_per_call_ms."""
    rate, latency = _basis(e)
    tokens = ("calls", "input_tokens", "output_tokens", "total_tokens")
    row = lambda m: F.concat(F.lit("| "), m["mode"], *[F.concat(F.lit(" | "), _whole(m[k])) for k in tokens], F.lit(" | "), F.coalesce(F.concat(F.lit("≈ "), T.number(m["minutes"]), F.lit(" 分钟")), F.lit("")), F.lit(" | "), m["note"], F.lit(" |"))
    basis = F.concat(F.lit("**口径**：中文≈0.6 token/字，拉丁≈0.25 token/字符；输出按各阶段预算计；时间=(总token÷"), rate, F.lit(" tok/s)+(调用次数×"), latency, F.lit("ms)。"))
    return F.array_join(
        F.concat(
            _lines(_heading(R_ESTIMATE, source, "内容"), "", basis, "", "| 模式 | 调用次数 | 输入 token | 输出 token | 总 token | 预计耗时 | 说明 |", "| --- | --- | --- | --- | --- | --- | --- |"), F.transform(e["modes"], row),
            _if(e["chars"].isNotNull(), _lines("", F.concat(F.lit("输入字数："), _whole(e["chars"]), F.lit(f"（超过 {most_chars} 会被截断）")))),
            _if(F.coalesce(e["sampled"], F.lit(False)), _lines("", "> 本预检采用 PDF 采样外推（前 2 页字数 ÷ 2 × 总页数），仅作数量级参考。")), _calibrated(e), _lines("", "> 估算基于本地字数启发式与默认速率/延迟，实际取决于模型速度、负载与网络。"),
        ),
        "\n",
    )


def _calibrated(e: Column) -> Column:
    rate, latency = _basis(e)
    return _if(F.coalesce(e["calibrated"], F.lit(False)), _lines("", F.concat(F.lit("> 已使用运行时实测校准速率（"), rate, F.lit(" tok/s / "), latency, F.lit("ms）。"))))


def batch_estimate_markdown(source: Column, e: Column) -> Column:
    """The list of a batch's estimate: items (index, title, chars, total_tokens, minutes), final_tokens, total_calls, total_tokens, total_minutes and the basis."""
    rate, latency = _basis(e)
    basis = F.concat(F.lit("**口径**：中文≈0.6 token/字，拉丁≈0.25 token/字符；时间=(总token÷"), rate, F.lit(" tok/s)+(调用次数×"), latency, F.lit("ms)。"))
    item = lambda o: F.concat(F.lit("- **"), F.coalesce(F.concat(F.lit("#"), o["index"].cast("string"), F.lit(" ")), F.lit("")), T.or_else(o["title"], "未命名"), F.lit("**（"), _whole(o["chars"]), F.lit(" 字）· 1 次调用 · 约 "), _whole(o["total_tokens"]), F.lit(" token · 约 "), T.number(o["minutes"]), F.lit(" 分钟"))
    final = F.concat(F.lit("- **跨篇对比**（1 次）· 约 "), _whole(e["final_tokens"]), F.lit(" token"))
    total = F.concat(F.lit("**合计**："), _whole(e["total_calls"]), F.lit(" 次调用 · 约 "), _whole(e["total_tokens"]), F.lit(" token · 预计 "), T.number(e["total_minutes"]), F.lit(" 分钟"))
    return F.array_join(F.concat(_lines(_heading(R_ESTIMATE, source, "内容"), "", basis, ""), F.transform(e["items"], item), _lines(final, "", total), _calibrated(e)), "\n")


def feynman_branches(r: Column) -> Column:
    """Branches below the root of a Feynman reading's tree."""
    short = lambda xs: F.transform(xs, lambda t: _leaf(T.prefix(t, 50)))
    points = lambda c: F.transform(F.slice(c["points"], 1, 4), lambda p: T.prefix(p["claim"], 50))
    chapters = F.transform(r["chapters"], lambda c: F.struct(F.concat(F.lit("第 "), c["index"].cast("string"), F.lit(" 章 "), T.prefix(c["title"], 30)).alias("title"), points(c).alias("kids")))
    plan = F.transform(r["review_plan"], lambda x: _leaf(T.prefix(F.concat(x["interval"], F.lit(" "), x["focus"]), 50)))
    return _some([_branch("目录", short(r["toc"])), _branch("阅读问题", short(r["questions"])), _branch("章节", chapters), _branch("间隔复习", plan)])


#: Labels of the kinds and depths of a reading on a page.
KINDS = {"map": "知识地图", "feynman": "费曼读书报告", "article": "精读报告"}
DEPTHS = {"quick": "快速要点", "deep": "深度精读", "book": "全书精读", "map": "知识地图", "feynman": "费曼读书法"}
#: An own style for the classes that the page's parts have.
STYLE = """body{margin:0;font:16px/1.7 sans-serif;background:#fafafa;color:#222}.wrap{max-width:800px;margin:auto;padding:40px 20px}
.sec{margin:0 0 32px}.num,.idx,.hl-label{color:#06c;margin-right:8px}.lead,.hl,.item,.dcell,.pre{background:#fff;border:1px solid #ddd;border-radius:8px;padding:12px}
.ev,.note,.src,.dmeta,.legend{color:#666;font-size:14px}.ev-missing,.c-infer{color:#a50}.c-author{color:#084}.c-fact,.rel{color:#06c}.c-unknown{color:#b00}
.chip,.kicker span{border:1px solid #ccc;border-radius:9px;padding:0 8px;margin-right:6px;font-size:12px}.dgrid{display:grid;grid-template-columns:1fr 1fr;gap:10px}
.tree,.tree ul{list-style:none;padding-left:20px}.node{display:inline-block;border:1px solid #ccc;border-radius:8px;padding:2px 10px}.t0{background:#222;color:#fff}.t1{color:#06c}
@media (prefers-color-scheme:dark){body{background:#111;color:#ddd}.lead,.hl,.item,.dcell,.pre{background:#1b1b1b}}"""


def _tag(name: str, css: str, *body: Column | str) -> Column:
    opening = f'<{name} class="{css}">' if css else f"<{name}>"
    return F.concat(F.lit(opening), *[F.lit(b) if isinstance(b, str) else b for b in body], F.lit(f"</{name}>"))


def _opt(value: Column, html: Column) -> Column:
    return F.when(value != "", html).otherwise(F.lit(""))


def _joined(xs: Column, f) -> Column:
    return F.array_join(F.transform(xs, f), "")


def _items(name: str, css: str, xs: Column, f=None) -> Column:
    return _tag(name, css, _joined(xs, f or (lambda t: _tag("li", "", T.escape_html(t)))))


def _part(title: Column | str, cond: Column, body: Column) -> Column:
    """A section (title, body), or null."""
    return F.when(cond, F.struct((F.lit(title) if isinstance(title, str) else title).alias("title"), body.alias("body")))


_E = T.escape_html


def article_sections(r: Column) -> Column:
    """Sections of a reading's page."""
    arguments = lambda a: _tag("li", "", _tag("span", "claim", _E(a["claim"])), _opt(a["evidence"], _tag("div", "ev", "论据 · ", _E(a["evidence"]))), _opt(a["quote"], _tag("div", "quote", "“", _E(a["quote"]), "”")))
    quotes = lambda q: _tag("li", "", "“", _E(q["text"]), "”", _opt(q["context"], _tag("div", "ev", _E(q["context"]))))
    concepts = lambda c: _tag("li", "", _tag("b", "", _E(c["term"])), _opt(c["explanation"], F.concat(F.lit(" — "), _E(c["explanation"]))))
    chapters = lambda c: _tag("li", "", _E(c["title"]), _opt(c["summary"], _tag("div", "ev", _E(c["summary"]))))
    return F.array_compact(
        F.array(
            _part("一句话总结", r["summary"] != "", _tag("p", "lead", _E(r["summary"]))), _part(THESIS, r["thesis"] != "", _tag("div", "hl", _E(r["thesis"]))),
            _part(ARGUMENTS, F.size(r["arguments"]) > 0, _items("ol", "concl", r["arguments"], arguments)), _part(QUOTES, F.size(r["quotes"]) > 0, _items("ul", "list", r["quotes"], quotes)),
            _part("核心概念", F.size(r["concepts"]) > 0, _items("ul", "list", r["concepts"], concepts)), _part(CHAPTERS, F.size(r["chapters"]) > 0, _items("ol", "list", r["chapters"], chapters)),
            _part("批判性思考", F.size(r["questions"]) > 0, _items("ul", "list", r["questions"])),
        )
    )


def map_sections(m: Column) -> Column:
    """Sections of a knowledge map's page: its items by type, each type under the legend of the confidence labels."""
    legend = '<div class="legend"><span class="legend-label">置信度</span>' + "".join(f'<span class="chip {css}">{label}</span>' for label, css in CONFIDENCE.items()) + "</div>"

    def item(o: Column, i: Column) -> Column:
        proof = F.when(o["evidence"] == "", F.lit("")).otherwise(F.concat(F.when(o["evidence"] == NO_EVIDENCE, F.lit('<div class="ev ev-missing">')).otherwise(F.lit('<div class="ev">')), F.lit("证据 · "), _E(o["evidence"]), F.lit("</div>")))
        sure = F.concat(F.lit('<span class="chip '), confidence_class(o["confidence"]), F.lit('">'), _E(o["confidence"]), F.lit("</span>"))
        tags = F.concat(_opt(o["source"], _tag("span", "chip plain", "位置 ", _E(o["source"]))), _opt(o["confidence"], sure))
        known = F.filter(o["relations"], lambda x: x["to"] != "")
        return _tag("div", "item", _tag("div", "claim", _tag("span", "idx", (i + 1).cast("string")), _E(o["claim"])), proof, _opt(tags, _tag("div", "tags", tags)), _joined(known, lambda x: _tag("div", "rel", _E(x["type"]), " → ", _E(x["to"]))))

    labels = (("period", "时间"), ("subject", "对象"), ("baseline", "基准"), ("source", "来源"), ("location", "位置"))

    def cell(d: Column) -> Column:
        bits = F.concat(*[_opt(d[f], _tag("span", "", f"{label} ", _E(d[f]))) for f, label in labels])
        return _tag("div", "dcell", _tag("div", "dval", _E(d["value"])), _opt(bits, _tag("div", "dmeta", bits)))

    kind = lambda t: F.filter(m["items"], lambda o: T.or_else(o["type"], NO_TYPE) == t)
    return F.array_compact(
        F.array(
            _part("摘要", m["summary"] != "", _tag("p", "lead", _E(m["summary"]))), _part(QUESTION, m["core_question"] != "", _tag("div", "hl", _tag("span", "hl-label", "作者试图回答"), _E(m["core_question"]))),
            _part(CONCLUSIONS, F.size(m["core_conclusions"]) > 0, _items("ol", "concl", m["core_conclusions"])), *[_part(t, F.size(kind(t)) > 0, F.concat(F.lit(legend), _joined(kind(t), item))) for t in TYPES],
            _part(DATA, F.size(m["data_points"]) > 0, _tag("div", "dgrid", _joined(m["data_points"], cell))), _part(CAVEATS, F.size(m["caveats"]) > 0, _items("ul", "list", m["caveats"])),
            _part("Mermaid 思维导图", m["mermaid"] != "", F.concat(_tag("pre", "pre", _E(m["mermaid"])), F.lit('<p class="note">复制到 mermaid.live 或支持 Mermaid 的编辑器渲染</p>'))), _part("XMind 大纲", m["outline"] != "", _tag("pre", "pre", _E(m["outline"]))),
            _part(RECALL, F.size(m["recall_questions"]) > 0, _items("ol", "list", m["recall_questions"])),
        )
    )


def feynman_sections(r: Column) -> Column:
    """Sections of a Feynman reading's page."""

    def chapter(c: Column) -> Column:
        point = lambda p: _tag("li", "", _tag("span", "claim", _E(p["claim"])), _opt(p["data"], _tag("div", "ev", "数据 · ", _E(p["data"]))), _opt(p["evidence"], _tag("div", "ev", "证据 · ", _E(p["evidence"]))))
        some = lambda css, label, xs: F.when(F.size(xs) > 0, _tag("p", css, label, F.array_join(F.transform(xs, _E), "；"))).otherwise(F.lit(""))
        body = F.concat(
            F.when(F.size(c["points"]) > 0, _items("ol", "concl", c["points"], point)).otherwise(F.lit("")), _opt(c["chapter_map"], _tag("pre", "pre", _E(c["chapter_map"]))),
            _opt(c["explanation"], _tag("div", "hl", _tag("span", "hl-label", "合上书讲解"), _E(c["explanation"]))), some("ev-missing", "知识缺口：", c["gaps"]), some("ev", "原文修正：", c["corrections"]),
        )
        return F.struct(F.concat(F.lit("第 "), c["index"].cast("string"), F.lit(" 章 · "), c["title"]).alias("title"), body.alias("body"))

    plan = lambda x: _tag("div", "it", _tag("span", "claim", _E(x["interval"])), _tag("div", "ev", _E(x["focus"]), _opt(x["method"], F.concat(F.lit("（"), _E(x["method"]), F.lit("）")))))
    before = F.array_compact(
        F.array(
            _part("一句话总结", r["summary"] != "", _tag("p", "lead", _E(r["summary"]))), _part(THESIS, r["thesis"] != "", _tag("div", "hl", _E(r["thesis"]))), _part("浏览目录", F.size(r["toc"]) > 0, _items("ol", "list", r["toc"])),
            _part("阅读问题清单", F.size(r["questions"]) > 0, _items("ol", "list", r["questions"])),
        )
    )
    after = F.array_compact(
        F.array(
            _part("合并全书导图", r["book_map"] != "", _tag("pre", "pre", _E(r["book_map"]))), _part("再讲一次（全书终讲）", r["final_explanation"] != "", _tag("div", "hl", _E(r["final_explanation"]))),
            _part("间隔复习计划", F.size(r["review_plan"]) > 0, _joined(r["review_plan"], plan)),
        )
    )
    return F.concat(before, F.transform(r["chapters"], chapter), after)


def html_page(kind: str, title: Column, m: Column, sections: Column, tree: Column) -> Column:
    """A page that needs no other file: hero, numbered sections (title, body), and the tree as nested lists. ``m``: depth, chars, source."""
    name = T.or_else(title, ROOT)
    depth = F.lit("精读")
    for k, label in DEPTHS.items():
        depth = F.when(m["depth"] == k, F.lit(label)).otherwise(depth)
    number = lambda i: _tag("span", "num", F.lpad(i.cast("string"), 2, "0"))
    section = lambda s, i: _tag("section", "sec", _tag("h2", "", number(i + 1), _E(s["title"])), s["body"])
    node = lambda css, t, kids: _tag("li", "", _tag("div", f"node {css}", _E(t)), kids)
    below = lambda xs, f: F.when(F.size(xs) > 0, _tag("ul", "", _joined(xs, f))).otherwise(F.lit(""))
    branch = lambda b: node("t1", b["title"], below(b["kids"], lambda k: node("t2", k["title"], below(k["kids"], lambda t: node("t2", t, F.lit(""))))))
    chars = F.when(m["chars"].isNotNull(), _tag("span", "", "约 ", m["chars"].cast("string"), " 字")).otherwise(F.lit(""))
    head = f'<meta charset="utf-8"><meta name="viewport" content="width=device-width, initial-scale=1"><style>{STYLE}</style>'
    return F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="zh-CN"><head>{head}<title>'), _E(name), F.lit(f' · {KINDS[kind]}</title></head><body><div class="wrap">'),
        _tag("header", "hero", _tag("div", "kicker", _tag("span", "", KINDS[kind]), _tag("span", "", depth), chars), _tag("h1", "", _E(name)), _opt(F.coalesce(m["source"], F.lit("")), _tag("div", "src", "来源 · ", _E(m["source"])))),
        F.array_join(F.transform(sections, section), ""), _tag("section", "sec", _tag("h2", "", number(F.size(sections) + 1), "思维导图"), _tag("ul", "tree", node("t0", name, below(tree, branch)))),
        F.lit('<footer class="ft"><span>文件可离线打开 · 支持深色模式</span></footer></div></body></html>'),
    )


#: Fixed value: beginning of the note on files that could not be written.
EXPORT_FAILED = "导出文件失败："


def write_exports(results: DataFrame, folder: str, formats: tuple[str, ...] = ("md", "mm", "html"), note: str = "") -> dict[str, str]:
    """Write columns ``md``, ``mm``, ``html`` as one text dataset per format, partitioned by distinct file names; returns their paths.

    What cannot be written below the folder is written beside it. If that fails too, there are no paths but a note that
    says why, behind the note so far.
    """
    out = {}
    named = distinct_names(results.select("title", *formats), F.col("title"), "title", Scratch(results.sparkSession))
    for f in formats:
        rows = named.select("name", F.col(f).alias("value"))
        for path, last in ((f"{folder}/{f}", False), (f"{folder}-{f}", True)):
            try:
                rows.write.mode("overwrite").partitionBy("name").option("compression", "none").text(path)
            except Exception as e:  # a folder that cannot be written is reported, not fatal: the results stand without files
                if last:
                    return {"note": (f"{note}；" if note else "") + EXPORT_FAILED + str(e).split("\n")[0]}
                continue
            out[f] = path
            break
    return out


def export_files(results: DataFrame, folder: str, key: str, formats: tuple[str, ...] = ("md", "mm", "html")) -> DataFrame:
    """One file per document and format below ``folder`` (columns ``key``, title and those of the formats): key, format, file, note.

    Files appear all at once when their format is written, or not at all. What cannot be written below the folder is written beside it; if
    that fails too, there is no file but a note that says why. A null content is no file.
    """
    spark, out = results.sparkSession, []
    scratch = Scratch(spark)
    named = scratch.cut(distinct_names(results.select(key, "title", *formats), F.col("title"), key, scratch), "exports")
    for f in formats:
        rows = named.where(F.col(f).isNotNull()).select(key, F.concat("name", F.lit(f".{f}")).alias("name"), F.col(f).alias("content"))
        note = None
        for path in (folder, f"{folder}-{f}"):
            try:
                write_files(rows, path, overwrite=False)
            except Exception as e:  # a folder that cannot be written is reported, not fatal: the results stand without files
                note = EXPORT_FAILED + str(e).split("\n")[0]
                continue
            out.append(rows.select(key, F.lit(f).alias("format"), F.concat(F.lit(f"{path}/"), "name").alias("file"), F.lit(None).cast("string").alias("note")))
            break
        else:
            out.append(rows.select(key, F.lit(f).alias("format"), F.lit(None).cast("string").alias("file"), F.lit(note).alias("note")))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return scratch.done(whole, "exported")
