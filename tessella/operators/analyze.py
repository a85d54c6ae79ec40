"""Readings by a model: sections per chunk in parallel, one final call per document or batch, everything sanitised.

A stage is one ``mapInArrow`` over prompts; its answers are written before the next stage reads them, so a lost executor
or a second action never pays for a call twice, and deleted once a reading's rows are written. A streamed answer is joined piece by piece; a call
that takes longer than it may fails between two pieces. If the stage's Spark jobs are cancelled by their tag, its tasks end between two pieces
too, and its rows say that they were cancelled. Final calls read condensed parts, gathered per document (at most
``max_parts`` of them, all of an article; beyond FAN they are reduced by a tree of calls first). Prompts ask for one JSON object; failed attempts are repeated up to three times with a note.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessella.config import BATCH_ITEMS, QUICK_CHARS, SHORT_TEXT, STRUCTURE_CHARS, Config
from tessella.functions import text as T
from tessella.operators import chunk as C
from tessella.operators import jsonx as J
from tessella.operators import sanitize as S
from tessella.operators.budget import OUT_PART, OUT_QUICK, OUT_SHORT
from tessella.operators.prompts import system_prompt
from tessella.providers import CORRECTION, ModelError, ModelProvider
from tessella.tables import Scratch, write

#: What is said of a request without a text.
NOTHING = "nothing to analyse"
#: Fixed value: what is said of a request whose stage was cancelled.
CANCELLED = "任务已取消"
#: Answers that a task passes on at once.
ROWS = 64
#: Parts that one call reads, and characters of their titles and other texts if ``max_parts`` is above that.
FAN, CLIP_TITLE, CLIP = 20, 80, 200
#: Attempts of a call, growth of the output budget after an error or a cut answer, and its cap.
ATTEMPTS, GROWTH, MOST_BUDGET, TEMPERATURE, TAIL = 3, 1.5, 16000, 0.2, 160


def next_budget(budget: int) -> int:
    return min(math.ceil(budget * GROWTH), MOST_BUDGET)


def whole(provider: ModelProvider, system: str, prompt: str, budget: int, seconds: float | None = None) -> str:
    """An answer, joined from its pieces as they come if the provider streams; fails between two pieces after ``seconds``."""
    if not hasattr(provider, "stream"):
        return provider.complete(system, prompt, budget, TEMPERATURE)
    end, text = None if seconds is None else time.monotonic() + seconds, []
    for piece in provider.stream(system, prompt, budget, TEMPERATURE):
        if end is not None and time.monotonic() > end:
            raise ModelError(f"no answer within {seconds:g} s")
        text.append(piece)
    return "".join(text)


def call_json(provider: ModelProvider, parse, system: str, user: str, budget: int, seconds: float | None = None) -> dict:
    """Up to three attempts; more budget after an error or a cut answer, the same after a mere slip of format."""
    prompt, history = user, []
    for attempt in range(1, ATTEMPTS + 1):
        answer, error = "", None
        try:
            answer = whole(provider, system, prompt, budget, seconds)
            if not answer.strip():
                raise ModelError("empty answer")
        except ModelError as e:
            error = str(e)
        if error is None and parse(answer):
            return {"answer": answer, "attempts": attempt, "budget": budget, "error": None}
        cut = error is None and answer.strip()[-1:] not in ("}", "]")
        history.append(f"error ({error})" if error else "cut off" if cut else "not JSON")
        if error or cut:
            budget = next_budget(budget)
        note = f"the call failed ({error})" if error else "the answer was cut off: be shorter and close the object" if cut else "the answer was no JSON: no prose, no fences, escaped line breaks"
        prompt = user + f"\n\n{CORRECTION * attempt} {note}. Answer with one JSON object only."
    tail = answer.strip()[-TAIL:]
    return {"answer": None, "attempts": ATTEMPTS, "budget": budget, "error": f"no JSON in {ATTEMPTS} attempts: {'; '.join(history)}" + (f". End of the last answer: {tail}" if tail else "")}


def _parses(text: str) -> bool:
    """As the column parser does: whole or outermost object, repaired or not, with or without trailing commas."""
    import json
    import re

    text = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", text.strip()))
    outer = text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""
    for raw in (text, outer):
        for x in (raw, re.sub(r",\s*([}\]])", r"\1", raw)):
            try:
                if raw and json.loads(x, strict=False) is not None:
                    return True
            except ValueError:
                pass
    return False


def cancelled(e: Exception) -> bool:
    """Whether Spark ended a job because it was cancelled."""
    return "SPARK_JOB_CANCELLED" in str(e)


def call_stage(prompts: DataFrame, provider: ModelProvider, keys: list[str], scratch: Scratch | None = None, seconds: float | None = None, seen: Observation | None = None) -> DataFrame:
    """keys, v (the parsed answer), attempts, budget, error for prompts (keys, system, user, budget); written once.

    ``seen`` observes finished, failed and attempts while answers are written. Without ``scratch`` the written table stays. A cancelled stage gives
    every prompt's row with that error, and no answer.
    """
    own = prompts.select(*keys, "system", "user", "budget")
    schema = own.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            got = [call_json(provider, _parses, *asked, seconds) for asked in zip(*(b.column(c).to_pylist() for c in ("system", "user", "budget")))]
            found = [pa.array([g[c] for g in got], t) for c, t in (("answer", pa.string()), ("attempts", pa.int32()), ("budget", pa.int32()), ("error", pa.string()))]
            yield pa.record_batch([*(b.column(k) for k in keys), *found], names=[*keys, "answer", "attempts", "budget", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    # many small tasks: calls are slow and should spread over all executors
    answers = own.repartition(*keys).mapInArrow(run, f"{kinds}, answer string, attempts int, budget int, error string")
    if seen is not None:
        answers = answers.observe(seen, F.count(F.lit(1)).alias("finished"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("failed"), F.sum("attempts").alias("attempts"))
    try:
        table = scratch.cut(answers, "answers") if scratch else write(answers, "answers")[0]
    except Exception as e:
        if not cancelled(e):
            raise
        none = F.lit(None).cast("string")
        table = own.select(*keys, none.alias("answer"), F.lit(0).alias("attempts"), "budget", F.lit(CANCELLED).alias("error"))
    return table.withColumn("v", J.parse(F.col("answer")))


def _read(text: Column, config: Config) -> Column:
    lines = T.newlines(text)
    return lines if config.max_input_chars is None else T.prefix(lines, config.max_input_chars)


def _texts(requests: DataFrame, config: Config) -> DataFrame:
    """req_id, text (line breaks normalised, cut if there is a cap), language, focus."""
    have = set(requests.columns)
    col = lambda c, back: F.coalesce(F.col(c), F.lit(back)) if c in have else F.lit(back)
    return requests.select("req_id", _read(F.col("text"), config).alias("text"), col("language", "auto").alias("language"), col("focus", "").alias("focus")).where(~T.blank(F.col("text")))


def _blank_apart(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with a text, and (req_id, error) of those without."""
    blank = T.blank(F.col("text"))
    return requests.where(~blank), requests.where(blank).select("req_id", F.lit(NOTHING).alias("error"))


def _section_user(text: Column, label: Column) -> Column:
    return F.concat(F.when(label != "", label).otherwise(F.lit("以下是待精读的内容：")), F.lit("\n\n"), text)


def quick(requests: DataFrame, provider: ModelProvider, config: Config = Config(), budget: int = OUT_QUICK, scratch: Scratch | None = None) -> DataFrame:
    """One call a document on its first 30000 characters: req_id, r (sanitised reading), error."""
    own = scratch or Scratch(requests.sparkSession)
    requests, blank = _blank_apart(requests)
    x = _texts(requests, config).withColumn("text", T.prefix(F.col("text"), QUICK_CHARS))
    p = x.select("req_id", system_prompt("section", F.col("language"), F.col("focus"), True).alias("system"), _section_user(F.col("text"), F.lit("")).alias("user"), F.lit(budget).alias("budget"))
    done = call_stage(p, provider, ["req_id"], own, config.timeout_ms / 1000).select("req_id", F.when(F.col("error").isNull(), S.section(F.col("v"), "未命名内容")).alias("r"), "error", "attempts")
    made = done.unionByName(blank, allowMissingColumns=True)
    return made if scratch else own.done(made, "readings")


def sections(requests: DataFrame, provider: ModelProvider, config: Config = Config(), kind: str = "section", scratch: Scratch | None = None, seen: Observation | None = None) -> DataFrame:
    """One call per chunk, all in parallel: req_id, index, total, v, error. Its answers stay a written table unless ``scratch`` deletes it."""
    requests, blank = _blank_apart(requests)
    x = _texts(requests, config)
    c = C.chunks(x, "req_id", config, "part" if kind == "section" else "chapter", ("language", "focus"))
    p = c.select("req_id", "index", "total", system_prompt(kind, F.col("language"), F.col("focus")).alias("system"), _section_user(F.col("text"), F.col("label")).alias("user"), F.lit(OUT_PART).alias("budget"))
    return call_stage(p, provider, ["req_id", "index", "total"], scratch, config.timeout_ms / 1000, seen).unionByName(blank, allowMissingColumns=True)


def chapters(parts: DataFrame) -> DataFrame:
    """Per document its sanitised sections in order, and the first error if any part failed."""
    s = S.section(F.col("v"), F.concat(F.lit("第 "), F.col("index").cast("string"), F.lit(" 部分")))
    x = parts.select("req_id", F.struct("index", s.alias("s")).alias("p"), F.struct("index", "error").alias("e"), "error")
    g = x.groupBy("req_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.min(F.when(F.col("error").isNotNull(), F.col("e"))).alias("e"))
    return g.select("req_id", F.transform("p", lambda c: c["s"]).alias("chapters"), F.col("e.error").alias("error"))


def _clipped(p: Column) -> Column:
    """A condensed part of a bounded size."""
    args = F.transform(p["arguments"], lambda a: F.struct(*[T.prefix(a[f], CLIP).alias(f) for f in S.ARGUMENTS[0]]))
    return F.struct(T.prefix(p["title"], CLIP_TITLE).alias("title"), *[T.prefix(p[f], CLIP).alias(f) for f in ("summary", "thesis")], args.alias("arguments"))


def _shaped(p: Column, config: Config) -> Column:
    """A condensed part as calls read it: clipped if ``max_parts`` is a cap, else whole (an answer is bounded by its own budget)."""
    return p if config.max_parts is None else _clipped(p)


def _titled(parts: Column, config: Config) -> Column:
    """Condensed parts, each with room for the titles of those that it stands for."""
    return F.transform(parts, lambda p: F.struct(*[_shaped(p, config)[f].alias(f) for f in ("title", "summary", "thesis", "arguments")], F.lit(None).cast("array<string>").alias("titles")))


def reduced(x: DataFrame, provider: ModelProvider, config: Config, scratch: Scratch) -> DataFrame:
    """``x`` (req_id, language, parts, error) with at most FAN parts each: FAN neighbours at a time become one by a call, again and again.

    A part that stands for others carries all their titles, so every one reaches the last call; a call reads at most FAN parts and those titles. A failed
    call is its document's error. As many rounds as the logarithm of ``max_parts`` (without a cap: of the most parts there are) to base FAN, less one.
    """
    x = scratch.cut(x, "wide")
    most = config.max_parts or x.agg(F.max(F.size("parts"))).first()[0] or 0
    while most > FAN:
        most = -(-most // FAN)
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / FAN).cast("int")), lambda g: F.slice("parts", g * FAN + 1, FAN))
        wide = x.where((F.size("parts") > FAN) & F.col("error").isNull()).select("req_id", "language", F.posexplode(groups).alias("g", "group"))
        user = F.concat(F.lit("以下 JSON 数组是相邻 "), F.size("group").cast("string"), F.lit(" 个部分已提取的要点，请合并为一个部分：\n\n"), F.to_json("group"))
        p = wide.select("req_id", "g", system_prompt("section", F.col("language"), F.lit("")).alias("system"), user.alias("user"), F.lit(OUT_PART).alias("budget"))
        answers = call_stage(p, provider, ["req_id", "g"], scratch, config.timeout_ms / 1000)
        titles = F.flatten(F.transform("group", lambda t: F.coalesce(t["titles"], F.array(t["title"]))))
        y = wide.select("req_id", "g", titles.alias("titles"), F.element_at("group", 1)["title"].alias("first")).join(answers, ["req_id", "g"])
        made = _shaped(F.element_at(S.condense(F.array(S.section(F.col("v"), F.col("first")))), 1), config)
        one = F.struct(*[made[f].alias(f) for f in ("title", "summary", "thesis", "arguments")], F.col("titles"))
        z = y.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("g", one.alias("p")))).alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("g", "error"))).alias("e"))
        new = z.select("req_id", F.transform("n", lambda s: s["p"]).alias("new"), F.col("e.error").alias("bad"))
        x = scratch.cut(x.join(new, "req_id", "left").select("req_id", "language", F.coalesce("new", "parts").alias("parts"), F.coalesce("error", "bad").alias("error")), "reduced")
    return x


def _final(requests: DataFrame, gathered: DataFrame, provider: ModelProvider, kind: str, config: Config, scratch: Scratch, condensed: Column | None = None) -> DataFrame:
    wide = condensed is None and (config.max_parts is None or config.max_parts > FAN)
    if wide:
        gathered = scratch.cut(gathered, "chapters")
    x = _texts(requests, config).select("req_id", T.units(F.col("text")).alias("chars"), "language", "focus").join(gathered.where("error is null"), "req_id")
    parts = S.condense(F.col("chapters")) if condensed is None else condensed
    if wide:
        parts = _titled(parts, config)
        many = x.where(F.size("chapters") > FAN).select("req_id", "language", parts.alias("parts"), "error").dropDuplicates(["req_id"])
        tree = reduced(many, provider, config, scratch).select("req_id", F.col("parts").alias("merged"), F.col("error").alias("tree_error"))
        gathered = gathered.join(tree.select("req_id", "tree_error"), "req_id", "left").withColumn("error", F.coalesce("error", "tree_error")).drop("tree_error")
        x, parts = x.join(tree, "req_id", "left").where("tree_error is null"), F.coalesce("merged", parts)
    user = F.concat(F.lit("全文共 "), F.col("chars").cast("string"), F.lit(" 字，分为 "), F.size("chapters").cast("string"), F.lit(" 个部分。以下 JSON 数组是各部分已提取的要点：\n\n"), F.to_json(parts))
    p = x.select("req_id", system_prompt(kind, F.col("language"), F.col("focus")).alias("system"), user.alias("user"), F.lit(OUT_PART).alias("budget"))
    done = call_stage(p, provider, ["req_id"], scratch, config.timeout_ms / 1000).select("req_id", "v", F.col("error").alias("final_error"))
    return gathered.join(done, "req_id", "left").withColumn("error", F.coalesce("error", "final_error")).drop("final_error")


def _split(requests: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    n = T.units(_read(F.col("text"), config))
    return requests.where(n <= SHORT_TEXT), requests.where(n > SHORT_TEXT)


def deep(requests: DataFrame, provider: ModelProvider, config: Config = Config(), book: bool = False) -> DataFrame:
    """Short texts by one call; long ones (and all of a book) by sections and a final call: req_id, kind, r, structure, citations, chapters, error.

    An article is read whole, all its parts, whatever the caps of ``config``; a book's texts and parts are capped by them.
    """
    config = config if book else replace(config, max_input_chars=None, max_parts=None)
    scratch = Scratch(requests.sparkSession)
    requests, blank = _blank_apart(requests)
    short, long = (requests.where("false"), requests) if book else _split(requests, config)
    x = _texts(short, config)
    p = x.select("req_id", system_prompt("section", F.col("language"), F.col("focus")).alias("system"), _section_user(F.col("text"), F.lit("")).alias("user"), F.lit(OUT_SHORT).alias("budget"))
    none = F.slice(F.array(S.section(F.col("v"), "")), 1, 0)
    one = call_stage(p, provider, ["req_id"], scratch, config.timeout_ms / 1000).withColumn("chapters", none).select("req_id", "chapters", "error", "v")
    many = _final(long, chapters(sections(long, provider, config, scratch=scratch)), provider, "final", config, scratch).select("req_id", "chapters", "error", "v")
    title = F.coalesce(F.try_element_at("chapters", F.lit(1))["title"], F.lit("未命名内容"))
    y = one.unionByName(many)
    made = y.select(
        "req_id", F.lit("book" if book else "article").alias("kind"), F.when(F.col("error").isNull(), S.section(F.col("v"), title)).alias("r"), S.texts(S.member(F.col("v"), "structure"), S.STEPS).alias("structure"),
        S.records(S.member(F.col("v"), "citations"), S.CITATIONS).alias("citations"), "chapters", "error",
    )
    return scratch.done(made.unionByName(blank, allowMissingColumns=True), "readings")


def knowledge_map(requests: DataFrame, provider: ModelProvider, config: Config = Config()) -> DataFrame:
    """req_id, m (sanitised map), error; long texts by sections first."""
    scratch = Scratch(requests.sparkSession)
    requests, blank = _blank_apart(requests)
    short, long = _split(requests, config)
    x = _texts(short, config)
    user = F.concat(F.lit("以下是待整理的内容：\n\n"), F.col("text"))
    p = x.select("req_id", system_prompt("map", F.col("language"), F.col("focus")).alias("system"), user.alias("user"), F.lit(OUT_PART).alias("budget"))
    one = call_stage(p, provider, ["req_id"], scratch, config.timeout_ms / 1000).select("req_id", "v", "error")
    many = _final(long, chapters(sections(long, provider, config, scratch=scratch)), provider, "map", config, scratch).select("req_id", "v", "error")
    made = one.unionByName(many).select("req_id", F.when(F.col("error").isNull(), S.knowledge_map(F.col("v"))).alias("m"), "error")
    return scratch.done(made.unionByName(blank, allowMissingColumns=True), "readings")


def feynman(requests: DataFrame, provider: ModelProvider, config: Config = Config()) -> DataFrame:
    """req_id, toc, questions, chapters, title, summary, thesis, book_map, final_explanation, review_plan, error."""
    scratch = Scratch(requests.sparkSession)
    requests, blank = _blank_apart(requests)
    _, long = _split(requests, config)
    x = _texts(long, config)
    user = F.concat(F.lit("请浏览目录并提出阅读问题：\n\n"), T.prefix(F.col("text"), STRUCTURE_CHARS))
    p = x.select("req_id", system_prompt("structure", F.col("language"), F.lit("")).alias("system"), user.alias("user"), F.lit(OUT_QUICK).alias("budget"))
    plan = call_stage(p, provider, ["req_id"], scratch, config.timeout_ms / 1000).select("req_id", S.texts(S.member(F.col("v"), "toc"), S.TOC).alias("toc"), S.texts(S.member(F.col("v"), "questions"), S.READING).alias("questions"), F.col("error").alias("plan_error"))
    parts = sections(requests, provider, config, "chapter", scratch)
    c = parts.select("req_id", F.struct("index", S.feynman_chapter(F.col("v"), F.col("index")).alias("c")).alias("p"), "error")
    g = c.groupBy("req_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda s: s["c"]).alias("chapters"), F.max("error").alias("error"))
    short = F.transform("chapters", lambda h: F.struct(h["title"].alias("title"), F.slice(h["points"], 1, 3).alias("points"), T.prefix(h["explanation"], 300).alias("explanation")))
    f = _final(requests, g, provider, "feynman", config, scratch, short).join(plan, "req_id", "left")
    first = F.try_element_at("chapters", F.lit(1))
    claim = F.coalesce(F.try_element_at(first["points"], F.lit(1))["claim"], F.lit(""))
    v = F.col("v")
    or_text = lambda name, back: F.coalesce(F.nullif(S.text(v, name), F.lit("")), back)
    none = F.array().cast("array<string>")
    made = f.select(
        "req_id", F.coalesce("toc", none).alias("toc"), F.coalesce("questions", none).alias("questions"), "chapters", or_text("title", F.when(F.col("toc").isNotNull(), "费曼读书报告").otherwise("费曼精读报告")).alias("title"),
        or_text("summary", F.coalesce(T.prefix(first["explanation"], 100), F.lit(""))).alias("summary"), or_text("thesis", claim).alias("thesis"), S.text(v, "bookMap").alias("book_map"),
        S.text(v, "finalExplanation").alias("final_explanation"), S.records(S.member(v, "reviewPlan"), S.REVIEW).alias("review_plan"), F.coalesce("error", "plan_error").alias("error"),
    )
    return scratch.done(made.unionByName(blank, allowMissingColumns=True), "readings")


def batch(requests: DataFrame, provider: ModelProvider, config: Config = Config()) -> DataFrame:
    """Compare the first ten documents of each batch (batch_id, item, text): quick readings, then one call on their condensed form."""
    scratch = Scratch(requests.sparkSession)
    x = requests.where(F.col("item") <= BATCH_ITEMS).withColumn("req_id", F.struct("batch_id", "item"))
    q = quick(x.withColumn("req_id", F.to_json("req_id")), provider, config, scratch=scratch)
    key = F.from_json("req_id", "batch_id long, item long")
    docs = q.select(key.alias("k"), "r", "error").select("k.*", "r", "error")
    g = docs.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("item", "r"))).alias("d"), F.max("error").alias("error"), F.count("*").alias("n"))
    compact = F.transform("d", lambda s: F.struct(s["r"]["title"].alias("title"), s["r"]["summary"].alias("summary"), s["r"]["thesis"].alias("thesis"), F.slice(s["r"]["arguments"], 1, 3).alias("arguments"), F.slice(s["r"]["quotes"], 1, 3).alias("quotes")))
    user = F.concat(F.lit("以下 JSON 数组是 "), F.col("n").cast("string"), F.lit(" 篇文章各自的要点：\n\n"), F.to_json(compact))
    p = g.where("error is null").select("batch_id", system_prompt("batch", F.lit("auto"), F.lit("")).alias("system"), user.alias("user"), F.lit(OUT_PART).alias("budget"))
    f = call_stage(p, provider, ["batch_id"], scratch, config.timeout_ms / 1000).select("batch_id", "v", F.col("error").alias("final_error"))
    v = F.col("v")
    y = g.join(f, "batch_id", "left")
    made = y.select(
        "batch_id", F.col("n").alias("items"), F.coalesce(F.nullif(S.text(v, "title"), F.lit("")), F.concat(F.col("n").cast("string"), F.lit(" 篇文章对比"))).alias("title"), S.comparison(S.member(v, "comparison"), S.THEMES).alias("comparison"),
        S.comparison(S.member(v, "conflicts"), S.CONFLICTS).alias("conflicts"), S.text(v, "complementarity").alias("complementarity"), S.text(v, "synthesis").alias("synthesis"), S.texts(S.member(v, "questions"), S.BATCH_QUESTIONS, False).alias("questions"), F.coalesce("error", "final_error").alias("error"),
    )
    return scratch.done(made, "readings")
