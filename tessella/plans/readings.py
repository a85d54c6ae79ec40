"""Model stages over whole tables with the stand-in model, and the same as SQL: its answers are arithmetic on sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.config import QUICK_CHARS, SHORT_TEXT, STRUCTURE_CHARS
from tessella.operators import analyze as A
from tessella.operators import prompts as P
from tessella.plans.texts import _CHUNKS, _t
from tessella.providers import FixtureProvider


def _requests(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("req_id"), "text")


def quick_pipeline(spark, d):
    return A.quick(_requests(spark, d), FixtureProvider()).select("req_id", "r.title", "r.thesis", F.size("r.arguments").alias("n_arguments"), "attempts", "error")


def section_map(spark, d):
    return A.sections(_requests(spark, d), FixtureProvider()).select("req_id", "index", "total", F.try_variant_get("v", "$.title", "string").alias("title"), "attempts", "error")


def deep_pipeline(spark, d):
    return A.deep(_requests(spark, d), FixtureProvider()).select("req_id", "kind", "r.title", F.size("chapters").alias("n_chapters"), F.size("citations").alias("n_citations"), "error")


def book_pipeline(spark, d):
    return A.deep(_requests(spark, d), FixtureProvider(), book=True).select("req_id", "kind", "r.title", F.size("chapters").alias("n_chapters"), "error")


def map_pipeline(spark, d):
    return A.knowledge_map(_requests(spark, d), FixtureProvider()).select("req_id", "m.title", "m.thesis", F.size("m.items").alias("n_items"), "error")


def feynman_pipeline(spark, d):
    return A.feynman(_requests(spark, d), FixtureProvider()).select("req_id", "title", F.size("chapters").alias("n_chapters"), F.size("toc").alias("n_toc"), "error")


def batch_pipeline(spark, d):
    x = _requests(spark, d).select(F.floor(F.col("req_id") / 12).alias("batch_id"), (F.col("req_id") % 12 + 1).alias("item"), "text")
    return A.batch(x, FixtureProvider()).select("batch_id", "items", "title", F.when(F.col("error").isNull(), F.size("comparison")).alias("n_themes"), "error")


def build_prompt(spark, d):
    """The system prompt of every document for each kind of call, with its language and, for some, a focus."""
    x = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "source", F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.lit(" ")).alias("focus"))
    each = F.array(*[F.struct(F.lit(name).alias("kind"), P.system_prompt(kind, F.col("lang"), F.col("focus"), quick).alias("prompt")) for name, kind, quick in _CALLS])
    return x.select("doc_id", F.explode(each).alias("p")).select("doc_id", "p.kind", F.length("p.prompt").cast("long").alias("chars"), F.md5("p.prompt").alias("md5"))


_CALLS = [("quick", "section", True), *[(k, k, False) for k in ("section", "final", "map", "structure", "chapter", "feynman", "batch")]]
QUERIES = {f.__name__: f for f in (quick_pipeline, section_map, deep_pipeline, book_pipeline, map_pipeline, feynman_pipeline, batch_pipeline, build_prompt)}


def _sentences(body: str) -> str:
    """The first six sentences that the stand-in model sees in a text."""
    return f"list_filter(list_transform(string_split(replace({body}, chr(10), ' '), '. '), lambda p: {_t('p')}), lambda p: p <> '')[1:6]"


def _cut(x: str, n: int) -> str:
    return f"substr({x}, 1, {n})"


def _title(x: str, back: str) -> str:
    return f"coalesce(nullif({_t(_cut(x, 40))}, ''), {back})"


def _first(parts: str) -> str:
    """What the last call sees of the first of ``parts``, and how many there are."""
    return f"SELECT doc_id, total, '[{{\"title\":' || to_json({_title('p[1]', chr(39) + '第 1 部分' + chr(39))})::VARCHAR || ',\"summary\":' || to_json({_t(_cut('p[1]', 80))})::VARCHAR || ',\"thesis\":' || to_json({_t(_cut('p[-1]', 80))})::VARCHAR || ',\"arguments\":[' AS j FROM ({parts}) WHERE pos = 0"


_BLANK = f"coalesce({_t('text')}, '') = ''"
_NOTHING = f"CASE WHEN {_BLANK} THEN '{A.NOTHING}' END AS error"
#: Chunks with their sentences, the first twenty of a text.
_PARTS = f"SELECT doc_id, pos, chunk, least(n, 20) AS total, {_sentences('chunk')} AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_CHUNKS})) WHERE pos < 20"
#: What the last call sees of the first part of a long text: JSON up to its arguments, one sentence as a whole, as no value has a
#: sentence's end. With a title and a thesis of one character each it still has more than the 40 characters that are cut off it.
_FIRST = _first(_PARTS)
#: The same with all parts of a text; above twenty, that many neighbours at a time become one by a call that sees the JSON of them as one sentence.
_EVERY = f"SELECT doc_id, pos, n AS total, {_sentences('chunk')} AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_CHUNKS}))"
_MERGED = f"""WITH RECURSIVE r AS (
    SELECT doc_id, total, total AS parts, j FROM ({_first(_EVERY)})
    UNION ALL
    SELECT doc_id, total, (parts + {A.FAN - 1}) // {A.FAN}, '[{{"title":' || to_json({_t(_cut('j', 40))})::VARCHAR || ',"summary":' || to_json({_t(_cut('j', 80))})::VARCHAR || ',"thesis":' FROM r WHERE parts > {A.FAN}
  ) SELECT doc_id, total, j FROM r WHERE parts <= {A.FAN}"""
_CHAPTER = f"SELECT doc_id, total, '[{{\"title\":' || to_json({_title('p[1]', chr(39) + '第 1 章' + chr(39))})::VARCHAR || ',\"points\":[{{\"claim\":' || to_json({_t(_cut('p[1]', 60))})::VARCHAR || ',\"data\":\"\",' AS j FROM ({_PARTS}) WHERE pos = 0"
_SHORT = f"SELECT doc_id, text, {_sentences('text')} AS p FROM documents WHERE length(text) <= {SHORT_TEXT} AND NOT {_BLANK}"
_EMPTY = f"FROM documents WHERE {_BLANK}"
_LONG = f"(SELECT doc_id FROM documents WHERE length(text) > {SHORT_TEXT})"
_HEADS = " UNION ALL ".join("SELECT '{}' AS kind, '{}' AS head, {} AS focused".format(name, P.head(kind, quick).replace("'", "''"), kind in P._FOCUSED) for name, kind, quick in _CALLS)
ORACLE_SQL = {
    "build_prompt": f"""SELECT doc_id, kind, length(p) AS chars, md5(p) AS md5 FROM (SELECT doc_id, kind, head || 'Language: ' || CASE lang WHEN 'zh' THEN '{P.LANGUAGES['zh']}' WHEN 'en' THEN 'English' ELSE '{P.LANGUAGES['auto']}' END || '.' || CASE WHEN focused AND doc_id % 3 = 0 AND trim(source) <> '' THEN chr(10) || 'The reader cares about: ' || trim(source) || '.' ELSE '' END AS p FROM documents, ({_HEADS}))""",
    "quick_pipeline": f"""SELECT doc_id AS req_id, {_title('p[1]', chr(39) + '未命名内容' + chr(39))} AS title, {_t(_cut('p[-1]', 80))} AS thesis, len(p) AS n_arguments, 1 AS attempts, NULL::VARCHAR AS error FROM (SELECT doc_id, {_sentences(_cut('text', QUICK_CHARS))} AS p FROM documents WHERE NOT {_BLANK})
      UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, '{A.NOTHING}' {_EMPTY}""",
    "section_map": f"SELECT doc_id AS req_id, pos + 1 AS index, total, {_cut('p[1]', 40)} AS title, 1 AS attempts, NULL::VARCHAR AS error FROM ({_PARTS}) UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, '{A.NOTHING}' {_EMPTY}",
    "deep_pipeline": f"""SELECT doc_id AS req_id, 'article' AS kind, {_title('p[1]', chr(39) + '未命名内容' + chr(39))} AS title, 0 AS n_chapters, 1 AS n_citations, NULL::VARCHAR AS error FROM ({_SHORT})
      UNION ALL SELECT doc_id, 'article', {_t(_cut('j', 40))}, total, 1, NULL FROM ({_MERGED}) WHERE doc_id IN {_LONG} UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, '{A.NOTHING}' {_EMPTY}""",
    "book_pipeline": f"SELECT doc_id AS req_id, 'book' AS kind, {_t(_cut('j', 40))} AS title, total AS n_chapters, NULL::VARCHAR AS error FROM ({_FIRST}) UNION ALL SELECT doc_id, NULL, NULL, NULL, '{A.NOTHING}' {_EMPTY}",
    "map_pipeline": f"""SELECT doc_id AS req_id, {_title('p[1]', chr(39) + '未命名知识地图' + chr(39))} AS title, {_t(_cut('p[-1]', 30))} AS thesis, len(p) AS n_items, NULL::VARCHAR AS error FROM ({_SHORT})
      UNION ALL SELECT doc_id, {_t(_cut('j', 40))}, {_t(_cut('j', 30))}, 1, NULL FROM ({_FIRST}) WHERE doc_id IN {_LONG} UNION ALL SELECT doc_id, NULL, NULL, NULL, '{A.NOTHING}' {_EMPTY}""",
    "feynman_pipeline": f"""SELECT c.doc_id AS req_id, {_t(_cut('j', 40))} AS title, total AS n_chapters, CASE WHEN length(d.text) > {SHORT_TEXT} AND len({_sentences(_cut('d.text', STRUCTURE_CHARS))}) > 0 THEN 1 ELSE 0 END AS n_toc, NULL::VARCHAR AS error FROM ({_CHAPTER}) c JOIN documents d ON d.doc_id = c.doc_id
      UNION ALL SELECT doc_id, NULL, NULL, NULL, '{A.NOTHING}' {_EMPTY}""",
    "batch_pipeline": f"""SELECT batch_id, n AS items, CASE WHEN bad THEN n || ' 篇文章对比' ELSE {_t(_cut('j', 40))} END AS title, CASE WHEN NOT bad THEN 1 END AS n_themes, CASE WHEN bad THEN '{A.NOTHING}' END AS error FROM (
      SELECT batch_id, count(*) AS n, bool_or(blank) AS bad, '[{{\"title\":' || to_json({_title('min_by(p, item)[1]', chr(39) + '未命名内容' + chr(39))})::VARCHAR || ',\"summary\":' || to_json({_t(_cut('min_by(p, item)[1]', 80))})::VARCHAR || ',\"thesis\":' || to_json({_t(_cut('min_by(p, item)[-1]', 80))})::VARCHAR || ',\"arguments\":[' AS j
      FROM (SELECT CAST(floor(doc_id / 12) AS BIGINT) AS batch_id, doc_id % 12 + 1 AS item, {_BLANK} AS blank, {_sentences(_cut('text', QUICK_CHARS))} AS p FROM documents WHERE doc_id % 12 < 10) GROUP BY batch_id)""",
}
