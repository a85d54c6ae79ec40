"""Queries of model JSON and sanitizers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import jsonx as J
from tessella.operators import sanitize as S
from tessella.tables import dealt



def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _talk(spark, d):
    """One array of (a, b, c) per conversation in the order of its turns; every third text is blank."""
    x = spark.read.parquet(f"{d}/conversations.parquet")
    t = F.when(F.col("turn") % 3 == 1, F.lit(" \n ")).otherwise(F.concat(F.lit(" "), F.col("text")))
    s = F.struct("turn", t.alias("a"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(F.lit(" ")).alias("b"), F.col("role").alias("c"))
    return x.groupBy((F.col("conv_id") % 20).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("conv_id", s.alias("s")))).alias("v")).select("conv_id", F.transform("v", lambda x: x["s"]).alias("v"))


def _as(v, names):
    return F.transform(v, lambda s: F.struct(*[s["abc"[i % 3]].alias(n) for i, n in enumerate(names)]))


def _records(kind):
    def query(spark, d):
        x = _talk(spark, d).select("conv_id", F.posexplode(S.struct_records(_as(F.col("v"), kind[0]), kind)).alias("pos", "r"))
        return x.select("conv_id", F.col("pos").cast("long").alias("pos"), "r.*")

    return query


def _oracle(kind):
    fields, most, keep = kind
    get = lambda i: f"regexp_replace(coalesce(x.{'abc'[i % 3]}, ''), '^\\s+|\\s+$', '', 'g')"
    made = ", ".join(f"{n} := {get(i)}" for i, n in enumerate(fields))
    ok = " OR ".join(f"x.{k} <> ''" for k in keep)
    return f"""SELECT conv_id, i - 1 AS pos, {', '.join(f'r[i].{n} AS {n}' for n in fields)} FROM (SELECT conv_id, r, unnest(range(1, len(r) + 1)) AS i FROM (
      SELECT conv_id, list_filter(list_transform(v[1:{most}], lambda x: struct_pack({made})), lambda x: {ok}) AS r FROM ({_TALK})))"""


_TALK = """SELECT conv_id % 20 AS conv_id, list(struct_pack(a := CASE WHEN turn % 3 = 1 THEN ' ' || chr(10) || ' ' ELSE ' ' || text END, b := CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END, c := role) ORDER BY conv_id, turn) AS v FROM conversations GROUP BY conv_id % 20"""


def _texts(most):
    def query(spark, d):
        x = _talk(spark, d).select("conv_id", F.posexplode(S.text_list(F.transform("v", lambda s: s["a"]), most)).alias("pos", "t"))
        return x.select("conv_id", F.col("pos").cast("long").alias("pos"), "t")

    return query


def _texts_oracle(most):
    return f"""SELECT conv_id, i - 1 AS pos, r[i] AS t FROM (SELECT conv_id, r, unnest(range(1, len(r) + 1)) AS i FROM (SELECT conv_id, list_filter(list_transform(v[1:{most}], lambda x: regexp_replace(x.a, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS r FROM ({_TALK})))"""


def _raw(spark, d):
    """Model answers around the events' JSON: as they are, fenced, in prose, with a trailing comma, cut off, with a raw line break."""
    e, p = F.col("event_id"), F.col("props")
    raw = (
        F.when(e % 6 == 0, p).when(e % 6 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(e % 6 == 2, F.concat(F.lit("Here: "), p, F.lit(" - done")))
        .when(e % 6 == 3, F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "n": [1, 2,], }'))).when(e % 6 == 4, F.expr("substr(props, 1, length(props) - 2)")).otherwise(F.lit('{"a": "x\ny"}'))
    )
    return _events(spark, d).select("event_id", raw.alias("raw"))


def parse_json(spark, d):
    v = J.parse(F.col("raw"))
    return _raw(spark, d).select("event_id", v.alias("v")).select("event_id", F.col("v").isNotNull().alias("ok"), F.try_variant_get("v", "$.a", "string").alias("a"), F.try_variant_get("v", "$.n[1]", "long").alias("n1"))


def repair_json(spark, d):
    return _raw(spark, d).select("event_id", J.repair(F.col("raw")).alias("fixed"))


def looks_truncated(spark, d):
    return _raw(spark, d).select("event_id", J.truncated(F.col("raw")).alias("cut"))


def coerce_arr(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.lit('["a", "b"]')).when(e % 4 == 1, F.lit('" one "')).when(e % 4 == 2, F.lit('"  "')).otherwise(F.lit('{"x": 1}'))
    return _events(spark, d).select("event_id", F.transform(S.items(F.parse_json(raw)), lambda v: F.trim(S.as_text(v))).alias("v")).select("event_id", F.array_join("v", "|").alias("items"))


def retry_budget(spark, d):
    b = F.col("event_id") % 16000 + 1
    up = lambda c: F.least(F.ceil(c.cast("double") * 1.5), F.lit(16000)).cast("long")
    return _events(spark, d).select("event_id", b.alias("b0"), up(b).alias("b1"), up(up(b)).alias("b2"))


_MODEL = """{"title": " T ", "summary": "s", "thesis": 7, "arguments": ["plain", {"claim": "c", "evidence": " e "}, {"quote": "q"}, 5], "quotes": [{"text": "t"}, {"context": "x"}], "concepts": "one", "questions": [" q1 ", "", 3],
 "coreConclusions": ["k1", " "], "items": ["bare", {"type": "数据", "claim": "c2", "relations": [{"to": "c"}, {"type": "导致"}, "z"]}, {"evidence": "no claim"}], "dataPoints": [{"value": "5%"}, {"period": "2020"}], "recallQuestions": ["r"],
 "points": [{"claim": "p", "data": "d"}, "q", {"data": "x"}], "gaps": ["g", " "], "comparison": [{"theme": "th", "positions": [{"doc": "A", "view": "v"}, {}]}, {"positions": []}, "no"]}"""


def _one(spark, d):
    return dealt(_events(spark, d).select("event_id"), "event_id").select("event_id", F.parse_json(F.lit(_MODEL)).alias("v"))


def sanitize_section(spark, d):
    return _one(spark, d).select("event_id", F.to_json(S.section(F.col("v"), "第 1 部分")).alias("json"))


def sanitize_map(spark, d):
    return _one(spark, d).select("event_id", F.to_json(S.knowledge_map(F.col("v"))).alias("json"))


def sanitize_feynman_chapter(spark, d):
    return _one(spark, d).select("event_id", F.to_json(S.feynman_chapter(F.col("v"), F.lit(2))).alias("json"))


def sanitize_comparison(spark, d):
    return _one(spark, d).select("event_id", F.to_json(S.comparison(S.member(F.col("v"), "comparison"), S.THEMES)).alias("json"))


def condense_parts(spark, d):
    parts = F.array(S.section(F.col("v"), "x"))
    return _one(spark, d).select("event_id", F.to_json(S.condense(parts)).alias("json"))


_KINDS = {"sanitize_arguments": S.ARGUMENTS, "sanitize_quotes": S.QUOTES, "sanitize_citations": S.CITATIONS, "sanitize_concepts": S.CONCEPTS, "sanitize_data_points": S.DATA_POINTS, "sanitize_positions": S.POSITIONS, "review_plan": S.REVIEW}
_LISTS = {"sanitize_questions": S.QUESTIONS, "structure_steps": S.STEPS, "feynman_toc": S.TOC, "map_caveats": S.CAVEATS}

QUERIES = {f.__name__: f for f in (parse_json, repair_json, looks_truncated, coerce_arr, retry_budget, sanitize_section, sanitize_map, sanitize_feynman_chapter, sanitize_comparison, condense_parts)}
QUERIES |= {k: _records(v) for k, v in _KINDS.items()} | {k: _texts(v) for k, v in _LISTS.items()}
_FIX = "CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Here: ' || props || ' - done' WHEN 3 THEN substr(props, 1, length(props) - 1) || ', \"n\": [1, 2,], }' WHEN 4 THEN substr(props, 1, length(props) - 2) ELSE '{\"a\": \"x\\ny\"}' END"
_ARG1 = '{"claim":"plain","evidence":"","quote":"","source":""},{"claim":"c","evidence":"e","quote":"","source":""}'
_SECTION = '{"title":"T","summary":"s","thesis":"","arguments":[' + _ARG1 + ',{"claim":"5","evidence":"","quote":"","source":""}],"quotes":[{"text":"t","context":"","source":""}],"concepts":[{"term":"one","explanation":""}],"questions":["q1","3"]}'
_MAP = '{"kind":"map","title":"T","summary":"s","thesis":"k1","core_question":"","core_conclusions":["k1"],"items":[{"type":"分论点","claim":"bare","evidence":"原文未提供证据","source":"","confidence":"","relations":[]},{"type":"数据","claim":"c2","evidence":"原文未提供证据","source":"","confidence":"","relations":[{"to":"c","type":"支持"}]}],"data_points":[{"value":"5%","period":"","subject":"","baseline":"","source":"","location":""}],"caveats":[],"mermaid":"","outline":"","recall_questions":["r"]}'
_CHAPTER = '{"index":2,"title":"T","points":[{"claim":"p","data":"d","evidence":"原文未提供证据"},{"claim":"q","data":"","evidence":"原文未提供证据"}],"chapter_map":"","explanation":"","gaps":["g"],"corrections":[]}'
_COMPARE = '[{"theme":"th","positions":[{"doc":"A","view":"v"}]}]'
_CONDENSED = '[{"title":"T","summary":"s","thesis":"","arguments":[' + _ARG1 + ',{"claim":"5","evidence":"","quote":"","source":""}]}]'
ORACLE_SQL = {
    "parse_json": "SELECT event_id, event_id % 6 <> 4 AS ok, CASE event_id % 6 WHEN 5 THEN 'x' || chr(10) || 'y' WHEN 4 THEN NULL ELSE json_extract_string(props, '$.a') END AS a, CASE WHEN event_id % 6 = 3 THEN 2::BIGINT END AS n1 FROM events",
    "repair_json": f"SELECT event_id, {_FIX} AS fixed FROM events",
    "looks_truncated": "SELECT event_id, event_id % 6 IN (1, 2) OR (event_id % 6 = 4 AND right(substr(props, 1, length(props) - 2), 1) NOT IN ('}', ']')) AS cut FROM events",
    "coerce_arr": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'one' ELSE '' END AS items FROM events",
    "retry_budget": "SELECT event_id, b0, b1, CAST(least(ceil(b1 * 1.5::DOUBLE), 16000) AS BIGINT) AS b2 FROM (SELECT event_id, event_id % 16000 + 1 AS b0, CAST(least(ceil((event_id % 16000 + 1) * 1.5::DOUBLE), 16000) AS BIGINT) AS b1 FROM events)",
    **{k: f"SELECT event_id, '{v}' AS json FROM events" for k, v in (("sanitize_section", _SECTION), ("sanitize_map", _MAP), ("sanitize_feynman_chapter", _CHAPTER), ("sanitize_comparison", _COMPARE), ("condense_parts", _CONDENSED))},
    **{k: _oracle(v) for k, v in _KINDS.items()},
    **{k: _texts_oracle(v) for k, v in _LISTS.items()},
}
