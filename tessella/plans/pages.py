"""Queries of HTML extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import html as H
from tessella.providers import ReplayFetcher
from tessella.sources import resolve as R
from tessella.sources import web as W


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _digest(spark, d, f):
    return _pages(spark, d).select("page_id", f(F.col("html")).alias("x")).select("page_id", F.length("x").alias("chars"), F.md5("x").alias("md5"))


def html_title(spark, d):
    return _pages(spark, d).select("page_id", H.title(F.col("html")).alias("title"))


def content_region(spark, d):
    return _digest(spark, d, H.content_region)


def strip_blocks(spark, d):
    return _digest(spark, d, H.strip_blocks)


def block_breaks(spark, d):
    return _digest(spark, d, H.block_breaks)


def img_alt(spark, d):
    return _digest(spark, d, H.img_alt)


def strip_tags(spark, d):
    return _digest(spark, d, H.strip_tags)


def collapse_ws(spark, d):
    return _digest(spark, d, H.collapse)


def decode_entities(spark, d):
    return _digest(spark, d, H.decode_entities)


def html_to_text(spark, d):
    return H.html_to_text(_pages(spark, d)).select("page_id", "title", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def scan_url(spark, d):
    """The pages table stands for what was fetched: text with the title in front where the text lacks it."""
    x = H.html_to_text(_pages(spark, d))
    return x.select("page_id", F.md5(R.with_title(F.col("title"), F.col("text"))).alias("md5"))


def fetch_pages(spark, d):
    """Links of the pages table fetched from a replay of what it recorded, by the replay's rules; links of one domain are refused."""
    x = _pages(spark, d).select("page_id", "url", F.col("html").alias("recorded"))
    out = W.fetch_pages(x, ReplayFetcher(), lambda url: F.endswith(R.host(url), F.lit(".example.com")) | F.endswith(R.host(url), F.lit(".example.org")))
    return out.select("page_id", "status", "agent", "calls", "retried", F.md5("title").alias("title_md5"), F.md5("text").alias("md5"), "error")


_NAMED = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&apos;": "''", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…"}


def _entities(c: str) -> str:
    for k, v in _NAMED.items():
        c = f"replace({c}, '{k}', '{v}')"
    return f"replace({c}, '&amp;', '&')"


def _strip(c: str) -> str:
    for tag in H.BLOCKS:
        c = f"regexp_replace({c}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({c}, '(?i)<({'|'.join(H.STRAY)})[^>]*/?>', ' ', 'g')"


def _breaks(c: str) -> str:
    for p, to in (("<h[1-6][^>]*>", "\n\n"), (f"</({H.CLOSING})[^>]*>", "\n"), ("<br\\s*/?>", "\n"), ("</(td|th)>", " "), ("<li[^>]*>", "\n- "), (f"<({H.OPENING})[^>]*>", "\n")):
        c = f"regexp_replace({c}, '(?i){p}', '{to}', 'g')"
    return c


_IMG = """regexp_replace({}, '(?i)<img[^>]*alt\\s*=\\s*["'']([^"'']*)["''][^>]*>', '[图：\\1]', 'g')"""


def _collapse(c: str) -> str:
    for p, to in (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


_TITLE = "trim(regexp_replace(" + _entities("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
#: Every page has one article element, never nested; short ones give way to the body.
_REGION = "CASE WHEN length(regexp_replace(regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1), '<[^>]+>', '', 'g')) > 200 THEN regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1) WHEN regexp_matches(html, '(?is)<body[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) ELSE html END"
_TEXT = _collapse(_entities(f"regexp_replace({_IMG.format(_breaks(_strip('r')))}, '<[^>]+>', ' ', 'g')"))


def _sql(x: str) -> str:
    return f"SELECT page_id, length(x) AS chars, md5(x) AS md5 FROM (SELECT page_id, {x} AS x FROM pages)"


#: The replay's rules on the number in a link: what the service answers, what a browser does, and which answer counts.
_NO_SERVICE = "n % 9 = 1"
_WALL = "n % 7 = 2 AND n % 11 <> 3"
_FETCH = f"""WITH p AS (SELECT page_id, url, html, regexp_extract(url, '/([0-9]+)', 1)::BIGINT AS n, regexp_matches(lower(regexp_extract(url, '(?i)^https?://([^/?#]+)', 1)), '[.]example[.](com|org)$') AS ok, {_TITLE} AS t, {_REGION} AS r FROM pages),
  q AS (SELECT *, {_TEXT} AS x, {_NO_SERVICE} AND n % 2 = 0 AS dead, n % 11 = 3 AS gone, {_WALL} AND (n % 9 <> 1 OR n % 14 = 2) AS walled, {_WALL} AND n % 14 <> 2 AND n % 9 <> 1 AND (n % 13 = 4 OR n % 17 <> 5 AND {_TEXT} <> '') AS passed, n % 13 = 4 AS plain, n % 17 = 5 AS bare FROM p),
  v AS (SELECT *, CASE WHEN walled AND (NOT passed OR plain OR t = '') THEN '验证' WHEN plain OR bare THEN '' ELSE t END AS title, CASE WHEN walled AND NOT passed THEN '环境异常，请完成验证' WHEN plain THEN 'plain ' || n WHEN bare THEN '' ELSE x END AS body FROM q),
  w AS (SELECT *, CASE WHEN NOT ok THEN 'host not allowed' WHEN dead THEN '{W.FAILED}no provider' WHEN gone THEN '{W.STATUS[0]}404{W.STATUS[1]}' WHEN body = '' THEN '{W.EMPTY}' END AS error FROM v)"""


QUERIES = {f.__name__: f for f in (html_title, content_region, strip_blocks, block_breaks, img_alt, strip_tags, collapse_ws, decode_entities, html_to_text, scan_url, fetch_pages)}
ORACLE_SQL = {
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "content_region": _sql(_REGION),
    "strip_blocks": _sql(_strip("html")),
    "block_breaks": _sql(_breaks("html")),
    "img_alt": _sql(_IMG.format("html")),
    "strip_tags": _sql("regexp_replace(html, '<[^>]+>', ' ', 'g')"),
    "collapse_ws": _sql(_collapse("html")),
    "decode_entities": _sql(_entities("html")),
    "html_to_text": f"SELECT page_id, title, length(x) AS chars, md5(x) AS md5 FROM (SELECT page_id, title, {_TEXT} AS x FROM (SELECT page_id, {_TITLE} AS title, {_REGION} AS r FROM pages))",
    "scan_url": f"SELECT page_id, md5(CASE WHEN title <> '' AND NOT contains(x, title) THEN title || '\n\n' || x ELSE x END) AS md5 FROM (SELECT page_id, title, {_TEXT} AS x FROM (SELECT page_id, {_TITLE} AS title, {_REGION} AS r FROM pages))",
    "fetch_pages": f"""{_FETCH} SELECT page_id, CASE WHEN ok AND NOT dead THEN CASE WHEN gone THEN 404 ELSE 200 END END AS status, CASE WHEN NOT ok OR dead THEN NULL WHEN {_NO_SERVICE} OR taken THEN 'browser' ELSE 'service' END AS agent,
      CASE WHEN ok THEN 1 + (({_NO_SERVICE})::INT) + ((walled AND NOT dead AND NOT gone)::INT) END AS calls, CASE WHEN ok THEN walled AND NOT dead AND NOT gone END AS retried,
      CASE WHEN error IS NULL THEN md5(title) END AS title_md5, CASE WHEN error IS NULL THEN md5(CASE WHEN title <> '' AND NOT contains(body, title) THEN title || '

' || body ELSE body END) END AS md5, error FROM (SELECT *, passed AND NOT dead AND NOT gone AS taken FROM w)""",
}
