"""Scalar text functions as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes of the token heuristic, in UTF-16 units, and tokens per character of each.
CJK = r"[\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
LATIN = r"[\x20-\x7e]"
ASTRAL = r"[\x{10000}-\x{10ffff}]"
TOKENS_CJK, TOKENS_LATIN, TOKENS_OTHER = 0.6, 0.25, 0.5
#: White space as the trimming functions see it: Unicode white space and the byte order mark.
SPACE = r"[\s\x{feff}]"


def trim(c: Column) -> Column:
    """Without white space (any Unicode one) at either end."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def trim_of(c: Column) -> Column:
    """``trim`` of a column or a variable that costs nothing to name again: only a text with white space at an end is searched for it."""
    ends = F.concat(F.substring(c, 1, 1), F.right(c, F.lit(1)))
    return F.when(ends.rlike(f"(?U){SPACE}"), trim(c)).otherwise(c)


def blank(c: Column) -> Column:
    """Null, or nothing but white space as ``trim`` sees it; the first other character settles it."""
    return F.coalesce(~c.rlike(rf"(?U)[^\s\x{{feff}}]"), F.lit(True))


def beyond_ascii(c: Column) -> Column:
    """What is not printable ASCII; nearly all of most texts goes in a few long runs."""
    return F.regexp_replace(c, LATIN + "+", "")


def count_of(c: Column, kind: str) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, kind + "+", ""))).cast("long")


def units(c: Column) -> Column:
    """Length in UTF-16 units: a character beyond U+FFFF counts twice."""
    return F.length(c).cast("long") + count_of(beyond_ascii(c), ASTRAL)


def prefix(c: Column, n: int) -> Column:
    """The first n UTF-16 units; half of a character at the cut is left out."""
    raw = F.substring(F.encode(c, "UTF-16BE"), 1, 2 * n)
    last = F.hex(F.substring(raw, 2 * n - 1, 1))
    cut = F.when(last.between("D8", "DB"), F.substring(raw, 1, 2 * n - 2)).otherwise(raw)
    return F.when(F.length(c) * 2 <= n, c).when(c.rlike(ASTRAL), F.decode(cut, "UTF-16BE")).otherwise(F.substring(c, 1, n))


def newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def class_counts(c: Column) -> tuple[Column, Column, Column]:
    """UTF-16 units that are CJK, printable ASCII, and anything else."""
    rest = beyond_ascii(c)
    cjk = count_of(rest, CJK)
    return cjk, (F.length(c) - F.length(rest)).cast("long"), F.length(rest).cast("long") + count_of(rest, ASTRAL) - cjk


def tokens(c: Column) -> Column:
    return weighed(*class_counts(c))


def weighed(cjk: Column, latin: Column, other: Column) -> Column:
    """Tokens of counted units."""
    return F.ceil(cjk * F.lit(TOKENS_CJK) + latin * F.lit(TOKENS_LATIN) + other * F.lit(TOKENS_OTHER)).cast("long")


def round_half_up(c: Column, scale: int = 1) -> Column:
    """floor(x * scale + 0.5) / scale, on doubles."""
    return F.floor(c * F.lit(float(scale)) + F.lit(0.5)).cast("double") / F.lit(float(scale))


def or_else(c: Column, fallback: str = "") -> Column:
    """Trimmed text, or the fallback for null and blank."""
    return F.coalesce(F.nullif(trim(c), F.lit("")), F.lit(fallback))


def positive(c: Column, fallback: float) -> Column:
    """A finite number above 0, or the fallback."""
    ok = c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < F.lit(float("inf")))
    return F.when(ok, c).otherwise(F.lit(fallback))


def number(c: Column) -> Column:
    """A double as it is written without a needless fraction: 3.0 as 3, 3.5 as 3.5."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def escape_html(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def safe_filename(c: Column, fallback: str = "report", most: int = 40) -> Column:
    """Illegal and control characters and white space become single dashes; cut to ``most`` after trimming dashes."""
    c = F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1f]+', "-")
    c = F.regexp_replace(c, rf"(?U){SPACE}+", "-")
    c = F.regexp_replace(F.regexp_replace(c, "-+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(c, 1, most), F.lit("")), F.lit(fallback))


#: The labels of pasted text.
PASTED, PASTED_LABEL = "粘贴文本", "粘贴内容"


def source_label(c: Column) -> Column:
    s = or_else(c)
    return F.when((s == "") | (s == PASTED), F.lit(PASTED_LABEL)).when(units(s) > 24, F.concat(prefix(s, 24), F.lit("…"))).otherwise(s)


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with one decimal, as text; null and not-a-number as 0."""
    s = F.floor(ms.cast("double") / 100 + 0.5) / F.lit(10.0)
    return F.when(ms.isNull() | F.isnan(ms.cast("double")), F.lit("0")).otherwise(number(s))


def token_label(n: Column) -> Column:
    k = round_half_up(n.cast("double") / 1000, 10)
    return F.when(n >= 1000, F.concat(F.lit("≈"), number(k), F.lit("k token"))).otherwise(F.concat(F.lit("≈"), number(F.floor(n.cast("double") + 0.5).cast("double")), F.lit(" token")))


def minute_label(m: Column) -> Column:
    hours = round_half_up(m / 60, 10)
    return F.when(m < 1, F.lit("≈<1分钟")).when(m >= 60, F.concat(F.lit("≈"), number(hours), F.lit("小时"))).otherwise(F.concat(F.lit("≈"), number(m), F.lit("分钟")))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in words; older than a week as a date. Both are timestamps; ``now`` is always given."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    m, h = F.floor(s / 60), F.floor(s / 3600)
    d = F.floor(s / 86400)
    return (
        F.when(s < 60, F.lit("刚刚"))
        .when(m < 60, F.concat(m.cast("string"), F.lit(" 分钟前")))
        .when(h < 24, F.concat(h.cast("string"), F.lit(" 小时前")))
        .when(d == 1, F.lit("昨天"))
        .when(d < 7, F.concat(d.cast("string"), F.lit(" 天前")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def cache_label(status: Column, fetched_at: Column) -> Column:
    at = F.substring(F.replace(F.coalesce(fetched_at, F.lit("")), F.lit("T"), F.lit(" ")), 1, 16)
    return (
        F.when(status == "hit", F.concat(F.lit("缓存命中（抓取于 "), at, F.lit("，未重新联网）")))
        .when(status == "fallback", F.concat(F.lit("回退缓存（抓取于 "), at, F.lit("）")))
        .when(status == "miss", F.lit("已重新抓取并写入缓存"))
        .when(status == "disabled", F.lit("缓存已禁用"))
        .otherwise(F.lit(""))
    )
