"""Queries of routing, labels, progress, trees and renderings, with their SQL."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import analyze as A
from tessella.operators import budget as B
from tessella.operators import chunk as C
from tessella.operators import jobs as J
from tessella.operators import render as R
from tessella.operators import route as G
from tessella.operators import sanitize as S
from tessella.providers import FixtureProvider

#: A word that some chunks have; the model is down for these.
_DOWN = "rthe"


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def route_request(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id")
    kind = F.when(i % 4 == 0, "pdf").otherwise("text")
    depth = F.element_at(F.array(*[F.lit(m) for m in B.MODES]), (i % 5 + 1).cast("int"))
    r = x.select(i.alias("req_id"), (i % 11 == 0).alias("estimate"), (i % 13).alias("batch_size"), depth.alias("depth"), kind.alias("source_kind"), T.units(F.col("text")).alias("chars"), (i % 17 != 0).alias("has_jobs"))
    r = r.withColumn("batch_size", F.when(F.col("batch_size") < 11, F.lit(0)).otherwise(F.col("batch_size")))
    return G.route(r).select("req_id", "route", "reason")


def job_label(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet")
    e = B.estimate_modes(x).where("mode = 'deep'").select("doc_id", "minutes")
    n = F.size(C.split_chunks(F.col("text")))
    y = x.select("doc_id", G.job_parts(F.lit("deep"), n, F.length("text")).alias("parts"), F.col("source"))
    return y.join(e, "doc_id").select("doc_id", G.job_label(T.source_label(F.col("source")), F.col("parts"), F.col("minutes")).alias("label"))


def progress_lines(spark, d):
    x = spark.read.parquet(f"{d}/documents.parquet").where(F.length("text") > 9000)
    return G.progress_lines(x.select("doc_id", F.least(F.ceil(F.length("text") / 6000), F.lit(20)).alias("parts")), "doc_id")


def section_progress(spark, d):
    """Lines of the sections of all documents, short ones included, as the stage gave them; parts with a certain word in them fail."""
    provider = FixtureProvider(script={_DOWN: ["!down"]})
    parts = A.sections(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("req_id"), "text"), provider)
    return G.section_lines(parts, "req_id")


def job_runs(spark, d):
    """Three jobs over the documents: one counts their chunks, one meets a document that fails, one is cancelled while it works.

    The last one begins when the others are over: its tasks hold all cores until they are cancelled, so beside it nothing else might ever begin.
    """
    docs = spark.read.parquet(f"{d}/documents.parquet")

    def chunks(job):
        job.say("counting")
        return f"{C.chunks(docs).count()} chunks"

    def broken(job):
        job.say("reading")
        last = docs.agg(F.max("doc_id")).first()[0]
        bad = F.raise_error(F.concat(F.lit("cannot read document "), F.col("doc_id").cast("string")))
        return str(docs.select(F.when(F.col("doc_id") == last, bad).otherwise(F.col("text")).alias("x")).agg(F.max("x")).first())

    def endless(job):
        job.say("waiting")
        docs.select("doc_id").mapInArrow(_wait, "doc_id long").count()
        return "never"

    jobs = [J.Job(spark, f.__name__, f) for f in (chunks, broken, endless)]
    for job in [job.start() for job in jobs[:2]]:
        job.wait()
    jobs[2].start()
    while not jobs[2].counts()["running"]:
        time.sleep(0.05)
    jobs[2].cancel("not needed")
    jobs[2].wait()
    return J.log(spark, jobs).select("label", "status", "detail", "seq", "line", (F.col("failed") > 0).alias("failed"))


def _wait(batches):
    """A reading that would take an hour a batch."""
    for b in batches:
        time.sleep(3600)
        yield b


def pdf_progress(spark, d):
    return G.pdf_progress(_events(spark, d).select("event_id", (F.col("event_id") % 90 + 1).alias("pages")), "event_id")


def job_lifecycle(spark, d):
    e = F.col("event_id")
    x = _events(spark, d).select("event_id", "event_type", "value", J.outcome(F.when(e % 4 != 0, F.concat(F.lit("boom "), e.cast("string"))), e % 3 == 0, F.when(e % 9 == 0, F.lit("")).otherwise(F.col("event_type"))).alias("o"))
    first = J.resolved_line(F.col("event_type"), e, F.when(e % 2 == 0, e % 5))
    return x.select("event_id", "o.status", "o.detail", J.last_line(F.col("o"), F.lit("# r")).alias("line"), first.alias("first"))


def job_output(spark, d):
    """Every seventh event of a user reads the output, the others are lines, some of them blank."""
    e = F.col("event_id")
    line = F.when(e % 7 != 0, F.when(e % 5 == 0, F.lit("")).otherwise(F.concat("event_type", F.lit(" "), e.cast("string"))))
    return J.drained(_events(spark, d).select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")


_KINDS = [*R.TYPES, "其他", ""]


def _items(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("turn") * 5 % 12 + F.col("conv_id") % 2).cast("int").__mod__(12) + 1)
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", kind.alias("type"), F.col("text").alias("claim"))


def group_items_by_type(spark, d):
    return R.group_by_type(_items(spark, d), "conv_id", "turn").select("conv_id", "type_order", "type", "n", F.array_join("claims", "|").alias("claims"))


def confidence_class(spark, d):
    labels = [*R.CONFIDENCE, "", "x"]
    c = F.element_at(F.array(*[F.lit(k) for k in labels]), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, d).select("event_id", R.confidence_class(c).alias("css"))


def map_relations(spark, d):
    """Maps of ten conversations each, turns as claims: each relates to others by the beginning of their text, some to what is not there."""
    x = spark.read.parquet(f"{d}/conversations.parquet").select(F.floor(F.col("conv_id") / 10).alias("map_id"), "conv_id", "turn", "text")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy("map_id").orderBy("conv_id", "turn"))).where(F.col("i") <= S.ITEMS)
    claims = F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda s: s["text"])
    n = F.size("claims")
    to = lambda k: F.substring(F.get(F.col("claims"), F.pmod(k, n)), 1, 12)
    relation = lambda t, kind: F.struct(t.alias("to"), F.lit(kind).alias("type"))
    relations = lambda i: F.array_compact(F.array(relation(to(i * 3 + 1), "支持"), F.when(i % 4 == 0, relation(F.lit("没有这句"), "反驳")), F.when(i % 5 == 2, relation(to(i + 2), "导致"))))
    kinds = F.array(*[F.lit(t) for t in R.TYPES])
    item = lambda c, i: F.struct(F.get(kinds, i * 7 % 10).alias("type"), c.alias("claim"), relations(i).alias("relations"))
    g = x.groupBy("map_id").agg(claims.alias("claims")).select("map_id", F.transform("claims", item).alias("items"))
    y = g.select("map_id", F.explode(S.relation_graph(F.col("items"), R.TYPES[0])).alias("r")).select("map_id", "r.*")
    joined = lambda a: F.array_join(F.transform(a, lambda e: e.cast("string")), ",")
    targets = F.array_join(F.transform("targets", lambda t: F.concat(F.coalesce(t["index"].cast("string"), F.lit("?")), t["type"])), ",")
    return y.select("map_id", F.col("index").cast("long").alias("index"), targets.alias("targets"), F.size("unresolved").cast("long").alias("n_unresolved"), "cyclic", F.size("conclusions").cast("long").alias("n_conclusions"), F.md5(F.array_join("conclusions", "|")).alias("conclusions"), joined("ends").alias("ends"))


def _articles(spark, d):
    """A reading per conversation: its first ten turns are arguments and quotes."""
    x = spark.read.parquet(f"{d}/conversations.parquet").withColumn("t", F.col("text"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rank <= 10")
    arg = F.struct("turn", F.struct(F.col("t").alias("claim"), F.when(F.col("turn") % 2 == 0, F.col("t")).otherwise(F.lit("")).alias("evidence"), F.lit("").alias("quote"), F.col("role").alias("source")).alias("a"))
    g = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(arg)).alias("v"))
    args = F.slice(F.transform("v", lambda s: s["a"]), 1, 10)
    quotes = F.transform(F.slice(args, 1, 8), lambda a: F.struct(a["claim"].alias("text"), F.lit("").alias("context"), a["source"].alias("source")))
    return g.select("conv_id", F.concat(F.lit("会话 <"), "conv_id", F.lit(">")).alias("title"), F.lit("s").alias("summary"), F.element_at(args, 1)["claim"].alias("thesis"), args.alias("arguments"), quotes.alias("quotes"))


def _trees(spark, d):
    none = F.expr("cast(array() as array<struct<title: string, summary: string>>)")
    return _articles(spark, d).withColumn("branches", R.article_branches(F.col("thesis"), F.col("arguments"), F.col("quotes"), none))


def mind_tree(spark, d):
    return R.mind_tree(_trees(spark, d), "conv_id")


def export_freemind(spark, d):
    return _trees(spark, d).select("conv_id", R.freemind(F.col("title"), F.col("branches")).alias("x")).select("conv_id", F.length("x").alias("chars"), F.md5("x").alias("md5"))


QUERIES = {f.__name__: f for f in (route_request, job_label, progress_lines, pdf_progress, group_items_by_type, confidence_class, mind_tree, export_freemind, job_lifecycle, job_output, section_progress, job_runs, map_relations)}


def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


from tessella.plans.budgets import ORACLE_SQL as _B  # noqa: E402
from tessella.plans.texts import _CHUNKS  # noqa: E402

_ITEMS = f"SELECT conv_id, turn, ({_KINDS!r})[CAST((turn * 5 % 12 + conv_id % 2) % 12 + 1 AS INT)] AS type, text AS claim FROM conversations"
_ART = """SELECT conv_id, '会话 <' || conv_id || '>' AS title, a[1].t AS thesis, a[1:10] AS a, a[1:8] AS q FROM (SELECT conv_id, list(struct_pack(t := text, e := CASE WHEN turn % 2 = 0 THEN text ELSE '' END, s := role) ORDER BY turn) AS a FROM conversations GROUP BY conv_id)"""
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_N = "chr(10)"
_PROGRESS = f"""WITH p AS (SELECT doc_id AS req_id, pos + 1 AS i, least(n, 20) AS n, contains(chunk, '{_DOWN}') AS down FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_CHUNKS})) WHERE pos < 20),
      q AS (SELECT *, coalesce(min(CASE WHEN down THEN i END) OVER (PARTITION BY req_id), 99) AS bad FROM p)
      SELECT req_id, CAST(i * 2 - 1 AS BIGINT) AS seq, '精读第 ' || i || '/' || n || ' 段…' AS line FROM q WHERE i <= bad UNION ALL SELECT req_id, i * 2, '完成第 ' || i || '/' || n || ' 段' FROM q WHERE i < bad UNION ALL SELECT req_id, i * 2 + 1, '汇总中…' FROM q WHERE i = n AND bad = 99"""
_RELATIONS = f"""WITH RECURSIVE i AS (SELECT map_id, row_number() OVER (PARTITION BY map_id ORDER BY conv_id, turn) - 1 AS i, text AS claim FROM (SELECT *, CAST(floor(conv_id / 10) AS BIGINT) AS map_id FROM conversations)),
  n AS (SELECT *, count(*) OVER (PARTITION BY map_id) AS n FROM i WHERE i < {S.ITEMS}),
  r AS (SELECT a.map_id, a.i, 1 AS k, '支持' AS type, substr(b.claim, 1, 12) AS tox FROM n a JOIN n b ON b.map_id = a.map_id AND b.i = (a.i * 3 + 1) % a.n UNION ALL SELECT map_id, i, 2, '反驳', '没有这句' FROM n WHERE i % 4 = 0
    UNION ALL SELECT a.map_id, a.i, 3, '导致', substr(b.claim, 1, 12) FROM n a JOIN n b ON b.map_id = a.map_id AND b.i = (a.i + 2) % a.n WHERE a.i % 5 = 2),
  t AS (SELECT r.*, (SELECT min(y.i) FROM n y WHERE y.map_id = r.map_id AND y.i <> r.i AND starts_with(y.claim, r.tox)) AS j FROM r),
  p AS (SELECT DISTINCT map_id, i, j FROM t WHERE j IS NOT NULL UNION SELECT p.map_id, p.i, t.j FROM p JOIN t ON t.map_id = p.map_id AND t.i = p.j WHERE t.j IS NOT NULL),
  e AS (SELECT p.map_id, p.i, string_agg(p.j::VARCHAR, ',' ORDER BY p.j) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.map_id = p.map_id AND t.i = p.j AND t.j IS NOT NULL)) AS ends, bool_or(p.i = p.j) AS cyclic,
    count(*) FILTER (WHERE p.j * 7 % 10 = 0 AND p.j <> p.i) AS nc, string_agg(y.claim, '|' ORDER BY p.j) FILTER (WHERE p.j * 7 % 10 = 0 AND p.j <> p.i) AS cs FROM p JOIN n y ON y.map_id = p.map_id AND y.i = p.j GROUP BY p.map_id, p.i),
  g AS (SELECT map_id, i, string_agg(coalesce(j::VARCHAR, '?') || type, ',' ORDER BY k) AS targets, count(*) FILTER (WHERE j IS NULL) AS nu FROM t GROUP BY map_id, i)
  SELECT g.map_id, g.i AS index, targets, nu AS n_unresolved, coalesce(cyclic, false) AS cyclic, coalesce(nc, 0) AS n_conclusions, md5(coalesce(cs, '')) AS conclusions, coalesce(ends, '') AS ends FROM g LEFT JOIN e USING (map_id, i)"""
ORACLE_SQL = {
    "map_relations": _RELATIONS,
    "section_progress": _PROGRESS,
    "job_runs": f"""WITH x AS (SELECT (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM ({_CHUNKS})) WHERE i <= 20) AS n, (SELECT max(doc_id) FROM documents) AS last)
      SELECT 'chunks' AS label, 'completed' AS status, NULL AS detail, unnest([1, 2])::BIGINT AS seq, unnest(['counting', '【最终报告】' || {_N} || n || ' chunks']) AS line, false AS failed FROM x
      UNION ALL SELECT 'broken', 'failed', 'cannot read document ' || last, unnest([1, 2]), unnest(['reading', '后台精读失败：cannot read document ' || last]), true FROM x
      UNION ALL SELECT 'endless', 'killed', 'not needed', unnest([1, 2]), unnest(['waiting', '已取消：not needed']), true FROM x""",
    "job_lifecycle": f"""SELECT event_id, status, detail, CASE status WHEN 'completed' THEN '【最终报告】' || {_N} || '# r' WHEN 'killed' THEN '已取消：' || detail ELSE '后台精读失败：' || detail END AS line, '已解析「' || event_type || '」（' || event_id || ' 字' || CASE WHEN event_id % 2 = 0 AND event_id % 5 > 0 THEN '，PDF 解析 ' || event_id % 5 || 'ms' ELSE '' END || '）' AS first
      FROM (SELECT *, CASE status WHEN 'killed' THEN CASE WHEN event_id % 9 = 0 THEN '已取消' ELSE event_type END WHEN 'failed' THEN 'boom ' || event_id END AS detail FROM (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'completed' WHEN event_id % 3 = 0 THEN 'killed' ELSE 'failed' END AS status FROM events))""",
    "job_output": f"""SELECT r.user_id, r.event_id, coalesce(string_agg(CASE WHEN l.event_id % 5 <> 0 THEN l.event_type || ' ' || l.event_id END, {_N} ORDER BY l.event_id), '') AS output FROM (SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS before FROM events WHERE event_id % 7 = 0) r
      LEFT JOIN events l ON l.user_id = r.user_id AND l.event_id > r.before AND l.event_id < r.event_id AND l.event_id % 7 <> 0 GROUP BY r.user_id, r.event_id""",
    "route_request": """SELECT req_id, CASE WHEN jobs AND reason IN ('batch', 'long pdf', 'long') THEN 'background' ELSE 'foreground' END AS route, reason FROM (SELECT doc_id AS req_id, doc_id % 17 <> 0 AS jobs,
      CASE WHEN doc_id % 11 = 0 THEN 'estimate' WHEN doc_id % 13 >= 11 THEN 'batch' WHEN doc_id % 5 = 0 THEN 'quick' WHEN length(text) > 9000 AND doc_id % 4 = 0 THEN 'long pdf' WHEN length(text) > 9000 THEN 'long' ELSE 'short' END AS reason FROM documents)""",
    "job_label": f"""SELECT d.doc_id, '精读「' || d.source || '」· ' || greatest(1, least(coalesce(c.n, 0), 20)) || ' 段 · 预算≈' || ({_num('m.minutes')}) || '分钟' AS label FROM documents d
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_CHUNKS}) GROUP BY doc_id) c ON c.doc_id = d.doc_id JOIN (SELECT doc_id, minutes FROM ({_B["estimate_modes"]}) WHERE mode = 'deep') m ON m.doc_id = d.doc_id""",
    "progress_lines": """WITH p AS (SELECT doc_id, CAST(least(ceil(length(text) / 6000.0::DOUBLE), 20) AS BIGINT) AS n FROM documents WHERE length(text) > 9000), e AS (SELECT doc_id, n, unnest(range(1, n + 1)) AS i FROM p)
      SELECT doc_id, i * 2 - 1 AS seq, '精读第 ' || i || '/' || n || ' 段…' AS line FROM e UNION ALL SELECT doc_id, i * 2, '完成第 ' || i || '/' || n || ' 段' FROM e UNION ALL SELECT doc_id, n * 2 + 1, '汇总中…' FROM p""",
    "pdf_progress": """WITH RECURSIVE j AS (SELECT event_id, event_id % 90 + 1 AS n FROM events), s AS (
      SELECT event_id, n, 0::BIGINT AS page, -1::BIGINT AS last, -1::BIGINT AS pct, false AS say FROM j UNION ALL
      SELECT event_id, n, page + 1, CASE WHEN f THEN p ELSE last END, p, f FROM (SELECT *, page + 1 >= n OR p >= last + 5 AS f FROM (SELECT *, CAST(floor((page + 1)::DOUBLE / n * 100 + 0.5::DOUBLE) AS BIGINT) AS p FROM (SELECT event_id, n, page, last FROM s WHERE page < n))))
      SELECT event_id, page, '解析 PDF 中… ' || pct || '%（' || page || '/' || n || ' 页）' AS line FROM s WHERE say""",
    "group_items_by_type": f"""SELECT conv_id, o AS type_order, t AS type, count(*) AS n, string_agg(claim, '|' ORDER BY turn) AS claims FROM (SELECT *, list_position({list(R.TYPES)!r}, t) - 1 AS o FROM (SELECT *, CASE WHEN type = '' THEN '分论点' ELSE type END AS t FROM ({_ITEMS}))) WHERE o >= 0 GROUP BY conv_id, o, t""",
    "confidence_class": "SELECT event_id, (['c-author', 'c-fact', 'c-infer', 'c-unknown', '', ''])[CAST(event_id % 6 + 1 AS INT)] AS css FROM events",
    "mind_tree": f"""WITH r AS ({_ART}), a AS (SELECT conv_id, unnest(range(1, len(a) + 1)) AS i, a FROM r), q AS (SELECT conv_id, unnest(range(1, len(q) + 1)) AS i, q FROM r), s AS (SELECT *, CASE WHEN thesis <> '' THEN 1 ELSE 0 END AS o FROM r)
      SELECT conv_id, '' AS path, 0 AS depth, title FROM r UNION ALL SELECT conv_id, '0', 1, '核心论点' FROM s WHERE o = 1 UNION ALL SELECT conv_id, '0.0', 2, thesis FROM s WHERE o = 1
      UNION ALL SELECT conv_id, CAST(o AS VARCHAR), 1, '论证结构' FROM s UNION ALL SELECT a.conv_id, s.o || '.' || (i - 1), 2, substr(a.a[i].t, 1, 60) FROM a JOIN s USING (conv_id)
      UNION ALL SELECT a.conv_id, s.o || '.' || (i - 1) || '.0', 3, '论据：' || substr(a.a[i].e, 1, 80) FROM a JOIN s USING (conv_id) WHERE a.a[i].e <> ''
      UNION ALL SELECT conv_id, CAST(o + 1 AS VARCHAR), 1, '金句摘录' FROM s UNION ALL SELECT q.conv_id, (s.o + 1) || '.' || (i - 1), 2, substr(q.q[i].t, 1, 60) FROM q JOIN s USING (conv_id)""",
    "export_freemind": f"""SELECT conv_id, length(x) AS chars, md5(x) AS md5 FROM (SELECT conv_id, '<map version="1.0.1">' || {_N} || '  <node TEXT="' || {_ESC.format('title')} || '">' || {_N}
      || '    <node TEXT="核心论点">' || {_N} || '      <node TEXT="' || {_ESC.format('thesis')} || '"/>' || {_N} || '    </node>' || {_N} || '    <node TEXT="论证结构">' || {_N}
      || array_to_string(list_transform(a, lambda x: '      <node TEXT="' || {_ESC.format('substr(x.t, 1, 60)')} || CASE WHEN x.e = '' THEN '"/>' ELSE '">' || {_N} || '        <node TEXT="论据：' || {_ESC.format('substr(x.e, 1, 80)')} || '"/>' || {_N} || '      </node>' END), {_N}) || {_N} || '    </node>' || {_N}
      || '    <node TEXT="金句摘录">' || {_N} || array_to_string(list_transform(q, lambda x: '      <node TEXT="' || {_ESC.format('substr(x.t, 1, 60)')} || '"/>'), {_N}) || {_N} || '    </node>' || {_N} || '  </node>' || {_N} || '</map>' AS x FROM ({_ART}))""",
}
