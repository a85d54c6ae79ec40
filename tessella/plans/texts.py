"""Queries of scalar text functions, chunking and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import chunk as C
from tessella.sources import resolve as R


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def split_paragraphs(spark, d):
    x = _read(spark, d, "documents").select("doc_id", F.posexplode(C.split_paragraphs(F.regexp_replace("text", r"\. ", ".\n\n"))).alias("pos", "para"))
    return x.select("doc_id", "pos", F.length("para").alias("chars"), F.md5("para").alias("md5"))


def split_chunks(spark, d):
    x = _read(spark, d, "documents").select("doc_id", F.posexplode(C.split_chunks(F.col("text"))).alias("pos", "chunk"))
    return x.select("doc_id", "pos", F.length("chunk").alias("chars"), F.md5("chunk").alias("md5"))


def pack_paragraphs(spark, d):
    # sentences as paragraphs exercise the packing of many short ones
    x = _read(spark, d, "documents").select("doc_id", F.posexplode(C.split_chunks(F.regexp_replace("text", r"\.\n", ".\n\n"), 1500)).alias("pos", "chunk"))
    return x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("md5"))


def cap_parts(spark, d):
    x = C.chunks(_read(spark, d, "documents"))
    return x.groupBy("doc_id").agg(F.max("total").alias("parts"), F.sum(F.length("text")).alias("chars"))


def chunk_labels(spark, d):
    x = C.chunks(_read(spark, d, "documents")).select("doc_id", "index", "total", "label")
    return x.withColumn("chapter", C.chunk_label(F.col("index"), F.col("total"), "chapter"))


def coerce_str(spark, d):
    c = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" \t"), "text", F.lit("\n "))).when(F.col("turn") % 3 == 1, F.lit("  "))
    return _read(spark, d, "conversations").select("conv_id", "turn", T.or_else(c, "无").alias("value"))


def coerce_num(spark, d):
    c = F.when(F.col("event_id") % 4 == 0, -F.col("value")).when(F.col("event_id") % 4 == 1, F.lit(float("nan"))).when(F.col("event_id") % 4 == 2, F.col("value"))
    return _read(spark, d, "events").select("event_id", T.positive(c, 7.5).alias("value"))


def escape_html(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html"))).alias("md5"))


def safe_filename(spark, d):
    return _read(spark, d, "pages").select("page_id", T.safe_filename(F.concat(F.col("url"), F.lit('  a*b "c"'))).alias("name"), T.safe_filename(F.lit("///")).alias("empty"))


def source_label(spark, d):
    c = F.when(F.col("page_id") % 3 == 0, F.lit("粘贴文本")).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise(F.substring("url", 1, 20))
    return _read(spark, d, "pages").select("page_id", T.source_label(c).alias("label"))


def fmt_seconds(spark, d):
    return _read(spark, d, "events").select("event_id", T.seconds(F.col("event_id") * 37).alias("s"))


def fmt_tokens(spark, d):
    return _read(spark, d, "events").select("event_id", T.token_label(F.col("event_id") * 3).alias("label"))


def fmt_minutes(spark, d):
    return _read(spark, d, "events").select("event_id", T.minute_label((F.col("event_id") % 2000).cast("double") / 8).alias("label"))


def relative_time(spark, d):
    return _read(spark, d, "events").select("event_id", T.relative_time(F.col("ts"), F.expr("timestamp'2024-01-20 00:00:00'")).alias("label"))


def cache_label(spark, d):
    status = F.element_at(F.array(*[F.lit(x) for x in ("hit", "fallback", "miss", "disabled", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    return _read(spark, d, "events").select("event_id", T.cache_label(status, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("label"))


def normalise_newlines(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.md5(T.newlines(F.replace("text", F.lit("\n"), F.lit("\r\n")))).alias("md5"))


def truncate_input(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.length(T.prefix(F.col("text"), 3000)).alias("chars"), F.md5(T.prefix(F.col("text"), 3000)).alias("md5"))


def _requests(spark, d) -> DataFrame:
    """A raw request per event: JSON with fields of right and wrong types."""
    i = F.col("event_id")
    depth = F.element_at(F.array(*[F.lit(x) for x in ("quick", "deep", "map", "feynman", "book", "Deep", "")]), (i % 7 + 1).cast("int"))
    text = F.concat(
        F.lit('{"url": '), F.when(i % 4 == 0, F.lit('" https://mp.weixin.qq.com/s/'))  .when(i % 4 == 1, F.lit('"https://example.com/')).otherwise(F.lit('"')), F.when(i % 4 < 2, i.cast("string")).otherwise(F.lit("")),
        F.lit('", "path": '), F.when(i % 3 == 0, F.lit('"/a/b.PDF"')).when(i % 3 == 1, F.lit('"note.md"')).otherwise(F.lit("17")), F.lit(', "text": "t'), i.cast("string"),
        F.lit('", "depth": "'), depth, F.lit('", "refresh": '), F.when(i % 2 == 0, F.lit("true")).otherwise(F.lit('"yes"')), F.lit(', "language": "en"}'),
    )
    return _read(spark, d, "events").select(i.alias("req_id"), text.alias("raw"))


def parse_input(spark, d):
    return R.parse_requests(_requests(spark, d)).select("req_id", "url", "path", "text", "depth", "export", "language", "refresh", "estimate")


def resolve_source(spark, d):
    return R.route_source(R.parse_requests(_requests(spark, d))).select("req_id", "source_kind", "source", "error")


def url_allowlist(spark, d):
    hosts = ["https://mp.weixin.qq.com/s/1", "HTTPS://MP.Weixin.QQ.com/x", "https://weixin.qq.com", "http://a.weixin.qq.com/?u", "https://evil-weixin.qq.com/", "https://weixin.qq.com.evil.io/", "https://mp.weixin.qq.com:8080/", "ftp://weixin.qq.com/", "no link"]
    u = F.when(F.col("page_id") % 10 == 9, F.col("url")).otherwise(F.element_at(F.array(*[F.lit(h) for h in hosts]), (F.col("page_id") % 9 + 1).cast("int")))
    return _read(spark, d, "pages").select("page_id", R.host(u).alias("host"), R.allowed(u).alias("ok"))


def antibot_detect(spark, d):
    t = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("text"), F.lit("请完成验证后继续"))).otherwise(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", R.antibot(t).alias("blocked"))


def scan_paste(spark, d):
    return R.pasted(_read(spark, d, "documents")).select("doc_id", "source", "source_kind", F.md5("text").alias("md5"))


_TRIM = r"'^[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+$'"


def _t(c: str) -> str:
    return f"regexp_replace({c}, {_TRIM}, '', 'g')"


#: A single paragraph at a time: the first cut of the rest, again and again, as a recursive query.
_CHUNKS = f"""WITH RECURSIVE c AS (
    SELECT doc_id, 0 AS pos, NULL::VARCHAR AS chunk, {_t("text")} AS rest FROM documents WHERE {_t("text")} <> ''
    UNION ALL
    SELECT doc_id, pos + 1, CASE WHEN length(rest) > 6000 THEN {_t("substr(rest, 1, k)")} ELSE {_t("rest")} END, CASE WHEN length(rest) > 6000 THEN substr(rest, k + 1) ELSE '' END
    FROM (SELECT *, CASE WHEN m > 3001 THEN m ELSE 6000 END AS k FROM (SELECT *, 6000 - CAST(least({", ".join(f"CASE WHEN instr(reverse(substr(rest, 1, 6000)), '{e}') = 0 THEN 99999 ELSE instr(reverse(substr(rest, 1, 6000)), '{e}') END" for e in "。！？；.!?;")}) AS BIGINT) + 1 AS m FROM c WHERE rest <> ''))
  ) SELECT doc_id, pos - 1 AS pos, chunk FROM c WHERE chunk IS NOT NULL"""
#: Greedy packing: a step takes a paragraph, or cuts a piece off one that is too long.
_WINDOW = "substr(rest, 1, 1500)"
_LAST_END = ", ".join(f"CASE WHEN instr(reverse({_WINDOW}), '{e}') = 0 THEN 99999 ELSE instr(reverse({_WINDOW}), '{e}') END" for e in "。！？；.!?;")
_PACKED = f"""WITH RECURSIVE c AS (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\\n{{2,}}|\\r\\n{{2,}}'), lambda p: {_t("p")}), lambda p: p <> '') AS ps, 1 AS i, '' AS cur, '' AS rest, -1 AS pos, NULL::VARCHAR AS chunk, false AS over FROM documents
    UNION ALL
    SELECT doc_id, ps, CASE WHEN kind IN ('long', 'full', 'join') THEN i + 1 ELSE i END, CASE kind WHEN 'cut' THEN '' WHEN 'rest' THEN {_t("rest")} WHEN 'long' THEN '' WHEN 'full' THEN ps[i] WHEN 'join' THEN CASE WHEN cur = '' THEN ps[i] ELSE cur || chr(10) || chr(10) || ps[i] END ELSE '' END,
      CASE kind WHEN 'cut' THEN substr(rest, k + 1) WHEN 'long' THEN ps[i] ELSE '' END, CASE WHEN said IS NULL THEN pos ELSE pos + 1 END, said, kind = 'end'
    FROM (SELECT *, CASE kind WHEN 'cut' THEN {_t("substr(rest, 1, k)")} WHEN 'long' THEN nullif({_t("cur")}, '') WHEN 'full' THEN {_t("cur")} WHEN 'end' THEN nullif({_t("cur")}, '') END AS said
    FROM (SELECT *, CASE WHEN m > 751 THEN m ELSE 1500 END AS k, CASE WHEN length(rest) > 1500 THEN 'cut' WHEN rest <> '' THEN 'rest' WHEN i > len(ps) THEN 'end' WHEN length(ps[i]) > 1500 THEN 'long' WHEN (CASE WHEN cur = '' THEN 0 ELSE length(cur) + 2 END) + length(ps[i]) > 1500 THEN 'full' ELSE 'join' END AS kind
    FROM (SELECT doc_id, ps, i, cur, rest, pos, 1500 - CAST(least({_LAST_END}) AS BIGINT) + 1 AS m FROM c WHERE NOT over)))
  ) SELECT doc_id, pos, chunk FROM c WHERE chunk IS NOT NULL"""
_REQ = """SELECT event_id AS req_id, CASE event_id % 4 WHEN 0 THEN ' https://mp.weixin.qq.com/s/' || event_id WHEN 1 THEN 'https://example.com/' || event_id ELSE '' END AS url,
   CASE event_id % 3 WHEN 0 THEN '/a/b.PDF' WHEN 1 THEN 'note.md' END AS path, 't' || event_id AS text, (['quick', 'deep', 'map', 'feynman', 'book', 'deep', 'deep'])[CAST(event_id % 7 + 1 AS INT)] AS depth,
   CASE WHEN event_id % 2 = 0 THEN true END AS refresh FROM events"""
_HOSTS = """SELECT page_id, CASE WHEN page_id % 10 = 9 THEN url ELSE (['https://mp.weixin.qq.com/s/1', 'HTTPS://MP.Weixin.QQ.com/x', 'https://weixin.qq.com', 'http://a.weixin.qq.com/?u', 'https://evil-weixin.qq.com/', 'https://weixin.qq.com.evil.io/', 'https://mp.weixin.qq.com:8080/', 'ftp://weixin.qq.com/', 'no link'])[CAST(page_id % 9 + 1 AS INT)] END AS u FROM pages"""

QUERIES = {f.__name__: f for f in (split_paragraphs, split_chunks, pack_paragraphs, cap_parts, chunk_labels, coerce_str, coerce_num, escape_html, safe_filename, source_label, fmt_seconds, fmt_tokens, fmt_minutes, relative_time, cache_label, normalise_newlines, truncate_input, parse_input, resolve_source, url_allowlist, antibot_detect, scan_paste)}
_N1 = "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE CAST(x AS VARCHAR) END"
ORACLE_SQL = {
    "split_paragraphs": f"SELECT doc_id, i - 1 AS pos, length(p[i]) AS chars, md5(p[i]) AS md5 FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.\n\n'), '\\n{{2,}}|\\r\\n{{2,}}'), lambda x: {_t('x')}), lambda x: length(x) > 0) AS p FROM documents))",
    "split_chunks": f"SELECT doc_id, pos, length(chunk) AS chars, md5(chunk) AS md5 FROM ({_CHUNKS})",
    "pack_paragraphs": f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, length(chunk) AS chars, md5(chunk) AS md5 FROM ({_PACKED})",
    "cap_parts": f"SELECT doc_id, least(max(n), 20) AS parts, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_CHUNKS})) WHERE pos < 20 GROUP BY doc_id",
    "chunk_labels": f"SELECT doc_id, pos + 1 AS index, least(n, 20) AS total, CASE WHEN n > 1 THEN '【第 ' || (pos + 1) || ' / ' || least(n, 20) || ' 部分】' ELSE '' END AS label, '【第 ' || (pos + 1) || ' / ' || least(n, 20) || ' 章】' AS chapter FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({_CHUNKS})) WHERE pos < 20",
    "coerce_str": f"SELECT conv_id, turn, coalesce(nullif({_t('c')}, ''), '无') AS value FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' \t' || text || '\n ' WHEN 1 THEN '  ' END AS c FROM conversations)",
    "coerce_num": "SELECT event_id, CASE WHEN c > 0 AND NOT isnan(c) THEN c ELSE 7.5::DOUBLE END AS value FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN -value WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN value END AS c FROM events)",
    "escape_html": """SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS md5 FROM pages""",
    "safe_filename": r"""SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url || '  a*b "c"', '[\\/:*?"<>|\x00-\x1f]+', '-', 'g'), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) AS name, 'report' AS empty FROM pages""",
    "source_label": "SELECT page_id, CASE WHEN c = '粘贴文本' THEN '粘贴内容' WHEN length(c) > 24 THEN substr(c, 1, 24) || '…' ELSE c END AS label FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '粘贴文本' WHEN 1 THEN url ELSE substr(url, 1, 20) END AS c FROM pages)",
    "fmt_seconds": f"SELECT event_id, {_N1} AS s FROM (SELECT event_id, floor((event_id * 37)::DOUBLE / 100 + 0.5::DOUBLE) / 10.0::DOUBLE AS x FROM events)",
    "fmt_tokens": f"SELECT event_id, CASE WHEN n >= 1000 THEN '≈' || ({_N1}) || 'k token' ELSE '≈' || n || ' token' END AS label FROM (SELECT event_id, event_id * 3 AS n, floor((event_id * 3)::DOUBLE / 1000 * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS x FROM events)",
    "fmt_minutes": f"SELECT event_id, CASE WHEN m < 1 THEN '≈<1分钟' WHEN m >= 60 THEN (SELECT '≈' || ({_N1}) || '小时' FROM (SELECT floor(m / 60 * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS x)) ELSE (SELECT '≈' || ({_N1}) || '分钟' FROM (SELECT m AS x)) END AS label FROM (SELECT event_id, (event_id % 2000)::DOUBLE / 8 AS m FROM events)",
    "relative_time": "SELECT event_id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN CAST(s // 60 AS BIGINT) || ' 分钟前' WHEN s < 86400 THEN CAST(s // 3600 AS BIGINT) || ' 小时前' WHEN s < 172800 THEN '昨天' WHEN s < 604800 THEN CAST(s // 86400 AS BIGINT) || ' 天前' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM (SELECT event_id, ts, CAST(epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "cache_label": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '缓存命中（抓取于 ' || a || '，未重新联网）' WHEN 1 THEN '回退缓存（抓取于 ' || a || '）' WHEN 2 THEN '已重新抓取并写入缓存' WHEN 3 THEN '缓存已禁用' ELSE '' END AS label FROM (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS a FROM events)",
    "normalise_newlines": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "truncate_input": "SELECT doc_id, length(substr(text, 1, 3000)) AS chars, md5(substr(text, 1, 3000)) AS md5 FROM documents",
    "parse_input": f"SELECT req_id, url, path, text, depth, 'none' AS export, 'en' AS language, refresh, NULL::BOOLEAN AS estimate FROM ({_REQ})",
    "resolve_source": f"SELECT req_id, CASE WHEN trim(url) <> '' THEN 'url' WHEN path = '/a/b.PDF' THEN 'pdf' WHEN path IS NOT NULL THEN 'file' ELSE 'text' END AS source_kind, CASE WHEN trim(url) <> '' THEN trim(url) WHEN path IS NOT NULL THEN path ELSE '粘贴文本' END AS source, CASE WHEN trim(url) <> '' AND url NOT LIKE '%weixin%' THEN 'host not allowed' END AS error FROM ({_REQ})",
    "url_allowlist": "SELECT page_id, h AS host, h IN ('mp.weixin.qq.com', 'weixin.qq.com') OR h LIKE '%.weixin.qq.com' AS ok FROM (SELECT page_id, lower(regexp_extract(u, '(?i)^https?://([^/?#]+)', 1)) AS h FROM (" + _HOSTS + "))",
    "antibot_detect": "SELECT doc_id, doc_id % 5 = 0 AND length(text) + 8 < 4000 AS blocked FROM documents",
    "scan_paste": "SELECT doc_id, '粘贴文本' AS source, 'text' AS source_kind, md5(text) AS md5 FROM documents",
}
