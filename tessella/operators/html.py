"""HTML to text as JVM string expressions: region choice by a fold over tags, the rest by ordered replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T

#: Named entities.
ENTITIES = {
    "nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "hellip": "…", "ldquo": "“", "rdquo": "”", "lsquo": "‘",
    "rsquo": "’", "middot": "·", "times": "×", "divide": "÷", "copy": "©", "reg": "®", "laquo": "«", "raquo": "»", "bull": "•", "deg": "°", "emsp": " ", "ensp": " ",
}
#: Opening tags that may hold the article, in order of preference.
REGIONS = [
    r"""(?i)<div[^>]*id\s*=\s*["'](?:js_content|content_views|article-root|js_content_root|root)["'][^>]*>""",
    r"""(?i)<div[^>]*class\s*=\s*["'][^"']*(?:rich_media_content|article-content|RichText|Post-RichTextContainer|markdown-body|article-body|entry-content|content)[^"']*["'][^>]*>""",
    r"(?i)<article(?:\s[^>]*)?>",
    r"(?i)<main(?:\s[^>]*)?>",
]
LEAST_REGION = 200
#: Elements that go with their contents, and those whose stray tags go too.
BLOCKS = ("script", "style", "noscript", "svg", "iframe", "form", "nav", "footer", "aside", "button", "select", "textarea")
STRAY = ("script", "style", "noscript", "svg", "iframe")
CLOSING = "p|div|section|article|li|tr|h[1-6]|blockquote|pre|ul|ol|figure|figcaption|header|footer|table|details"
OPENING = "p|div|section|article|blockquote|pre|table"
#: Fixed value: the form of an entity.
ENTITY = r"&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"


def decode_entities(c: Column) -> Column:
    """Named and numeric entities in one pass: what an entity gives is never read as one again.

    A number without ``x`` counts as far as its decimal digits go. Numbers that are no character, and unknown names, stay as they are.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def char(e: Column) -> Column:
        hexa = F.startswith(e, F.lit("&#x"))
        digits = F.when(hexa, F.conv(F.substring(e, 4, 20), 16, 10)).otherwise(F.regexp_extract(e, "^&#([0-9]+)", 1))
        code = F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 9, digits).try_cast("long")
        ok = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(F.lit(63).cast("long"))), 8, "0")), "UTF-32")
        number = F.when(ok, made).otherwise(e)
        return F.when(F.startswith(e, F.lit("&#")), number).otherwise(F.coalesce(F.try_element_at(names, F.lower(F.regexp_replace(e, "[&;]", ""))), e))

    def whole(t: Column) -> Column:
        between, found = F.split(t, ENTITY, -1), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
        return F.array_join(F.zip_with(between, found, lambda x, e: F.concat(x, F.when(e.isNull(), F.lit("")).otherwise(char(e)))), "")

    # one element array: the text is named once, however often it is read
    return F.when(F.contains(c, F.lit("&")), F.element_at(F.transform(F.array(c), whole), 1)).otherwise(c)


def title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return T.trim(F.regexp_replace(decode_entities(F.regexp_replace(raw, "<[^>]+>", " ")), r"(?U)[\s\x{feff}]+", " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def balanced(html: Column, opening: str) -> Column:
    """What the first match of ``opening`` encloses, counting tags of its name; to the end if it is never closed. '' without a match."""

    def step(s: Column, t: Column) -> Column:
        closes = F.startswith(t, F.lit("</"))
        depth = s["depth"] + F.when(closes, -1).when(F.length(t) > 1, F.when(F.startswith(t, F.lit("<")), 1).otherwise(0)).otherwise(0)
        return F.when(s["depth"] == 0, s).otherwise(F.struct(depth.alias("depth"), (s["at"] + F.when(depth == 0, 0).otherwise(F.length(t))).alias("at")))

    def inside(rest: Column, name: Column) -> Column:
        # pieces: an opening or closing tag of the name, or all up to the next of them
        tag = F.concat(F.lit("<"), name, F.lit(r"(?:\s|>)|</"), name, F.lit(r"\s*>"))
        tags = F.regexp_extract_all(rest, F.concat(F.lit("(?s)"), tag, F.lit("|(?:(?!"), tag, F.lit(").)++")), F.lit(0))
        end = F.aggregate(tags, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at")), _only_tags(name, step))
        return F.substr(rest, F.lit(1), end["at"])

    def found(tag: Column) -> Column:
        rest = F.substr(html, F.position(tag, html) + F.length(tag))
        return F.when(tag == "", F.lit("")).otherwise(let(rest, lambda r: inside(r, F.regexp_extract(tag, "^<([a-zA-Z0-9]+)", 1))))

    return let(F.regexp_extract(html, opening, 0), found)


def _only_tags(name: Column, step):
    """The fold's step for tags of ``name``; other pieces only move the place."""

    def run(s: Column, t: Column) -> Column:
        own = F.startswith(t, F.concat(F.lit("<"), name)) | F.startswith(t, F.concat(F.lit("</"), name))
        short = F.length(t) <= F.length(name) + 8
        other = F.when(s["depth"] == 0, s).otherwise(F.struct(s["depth"].alias("depth"), (s["at"] + F.length(t)).alias("at")))
        return F.when(own & short & t.rlike(r"^</?[a-zA-Z0-9]+\s*>?$"), step(s, t)).otherwise(other)

    return run


def content_region(html: Column) -> Column:
    """The first candidate region with more than 200 characters outside tags, else the body, else everything."""
    enough = lambda p: F.when(F.length(F.regexp_replace(p, "<[^>]+>", "")) > LEAST_REGION, p)
    found = [F.when(html.rlike(opening), let(balanced(html, opening), enough)) for opening in REGIONS]
    body = F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1))
    return F.coalesce(*found, body, html)


def strip_blocks(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?is)<({'|'.join(BLOCKS)})[^>]*>.*?</\1>", " ")
    return F.regexp_replace(c, rf"(?i)<({'|'.join(STRAY)})[^>]*/?>", " ")


def block_breaks(c: Column) -> Column:
    for pattern, to in (("<h[1-6][^>]*>", "\n\n"), (f"</({CLOSING})[^>]*>", "\n"), (r"<br\s*/?>", "\n"), ("</(td|th)>", " "), ("<li[^>]*>", "\n- "), (f"<({OPENING})[^>]*>", "\n")):
        c = F.regexp_replace(c, "(?i)" + pattern, to)
    return c


def img_alt(c: Column) -> Column:
    return F.regexp_replace(c, r"""(?i)<img[^>]*alt\s*=\s*["']([^"']*)["'][^>]*>""", "[图：$1]")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


def collapse(c: Column) -> Column:
    for pattern, to in (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return T.trim(c)


def body_text(html: Column) -> Column:
    return collapse(decode_entities(strip_tags(img_alt(block_breaks(strip_blocks(content_region(html)))))))


def html_to_text(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, title, text of each page."""
    return pages.select(key, title(F.col("html")).alias("title"), body_text(F.col("html")).alias("text"))
