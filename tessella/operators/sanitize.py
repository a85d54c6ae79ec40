"""Model output into fixed schemas: cap first, then coerce, then drop; on variants as they come from the parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as T

#: What stands for evidence that the text lacks, and for a missing type of item or relation.
NO_EVIDENCE, NO_TYPE, NO_RELATION = "原文未提供证据", "分论点", "支持"
#: Fields of each kind of record, the most of them, and which of the fields keep one.
ARGUMENTS = (("claim", "evidence", "quote", "source"), 10, ("claim", "evidence"))
QUOTES = (("text", "context", "source"), 8, ("text",))
CITATIONS = (("claim", "source", "quote"), 8, ("claim", "quote"))
CONCEPTS = (("term", "explanation"), 10, ("term",))
DATA_POINTS = (("value", "period", "subject", "baseline", "source", "location"), 30, ("value",))
POSITIONS = (("doc", "view"), 12, ("doc", "view"))
REVIEW = (("interval", "focus", "method"), 5, ("interval",))
ITEMS, RELATIONS, POINTS = 40, 6, 10
QUESTIONS, CONCLUSIONS, RECALL, CAVEATS, STEPS, TOC, READING, GAPS, BATCH_QUESTIONS = 8, 5, 5, 15, 12, 30, 6, 6, 5
THEMES, CONFLICTS, SUMMARY_CHARS = 8, 6, 100


def member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column, name: str, fallback: str = "") -> Column:
    """A member that is a text, trimmed; the fallback for anything else and for blanks."""
    is_text = F.schema_of_variant(member(v, name)) == "STRING"
    return T.or_else(F.when(is_text, F.try_variant_get(v, f"$.{name}", "string")), fallback)


def items(v: Column) -> Column:
    """An array as it is, a text as an array of it, anything else as none."""
    kind = F.schema_of_variant(v)
    one = F.array(F.parse_json(F.concat(F.lit('"'), F.lit('"'))))
    return F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")).when((kind == "STRING") & (T.or_else(F.try_variant_get(v, "$", "string")) != ""), F.array(v)).otherwise(F.slice(one, 1, 0))


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def as_text(v: Column) -> Column:
    """Any value as a text."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v), F.lit("null"))


def records(v: Column, kind: tuple) -> Column:
    """Array of structs; a value that is no object stands in the first field."""
    fields, most, keep = kind

    def one(x: Column) -> Column:
        first = F.when(is_object(x), text(x, fields[0])).otherwise(T.or_else(as_text(x)))
        return F.struct(first.alias(fields[0]), *[F.when(is_object(x), text(x, f)).otherwise(F.lit("")).alias(f) for f in fields[1:]])

    def good(s: Column) -> Column:
        ok = s[keep[0]] != ""
        for k in keep[1:]:
            ok = ok | (s[k] != "")
        return ok

    return F.filter(F.transform(F.slice(items(v), 1, most), one), good)


def struct_records(c: Column, kind: tuple) -> Column:
    """The same for an array of structs that already has the fields; null is an empty array."""
    fields, most, keep = kind
    cleaned = F.transform(F.slice(c, 1, most), lambda x: F.struct(*[T.or_else(x[f]).alias(f) for f in fields]))

    def good(s: Column) -> Column:
        ok = s[keep[0]] != ""
        for k in keep[1:]:
            ok = ok | (s[k] != "")
        return ok

    return F.coalesce(F.filter(cleaned, good), F.slice(F.array(F.struct(*[F.lit("").alias(f) for f in fields])), 1, 0))


def texts(v: Column, most: int, trimmed: bool = True) -> Column:
    cut = F.slice(items(v), 1, most)
    return F.filter(F.transform(cut, lambda x: T.trim(as_text(x))), lambda t: t != "") if trimmed else F.transform(cut, as_text)


def text_list(c: Column, most: int) -> Column:
    """Trimmed, not blank, of the first ``most`` of an array of texts."""
    return F.filter(F.transform(F.slice(c, 1, most), T.trim), lambda t: t != "")


def section(v: Column, fallback_title: Column | str = "") -> Column:
    """Title, summary, thesis, arguments, quotes, concepts, questions of one reading."""
    back = F.lit(fallback_title) if isinstance(fallback_title, str) else fallback_title
    title = F.coalesce(F.nullif(text(v, "title"), F.lit("")), back)
    return F.struct(
        title.alias("title"), text(v, "summary").alias("summary"), text(v, "thesis").alias("thesis"), records(member(v, "arguments"), ARGUMENTS).alias("arguments"),
        records(member(v, "quotes"), QUOTES).alias("quotes"), records(member(v, "concepts"), CONCEPTS).alias("concepts"), texts(member(v, "questions"), QUESTIONS).alias("questions"),
    )


def map_items(v: Column) -> Column:
    """Knowledge items: a claim is needed; relations need a target."""

    def relation(r: Column) -> Column:
        kind = F.when(is_object(r), text(r, "type", NO_RELATION)).otherwise(T.or_else(as_text(r), NO_RELATION))
        return F.struct(F.when(is_object(r), text(r, "to")).otherwise(F.lit("")).alias("to"), kind.alias("type"))

    def one(x: Column) -> Column:
        own = lambda f, back="": F.when(is_object(x), text(x, f, back)).otherwise(F.lit(back))
        claim = F.when(is_object(x), text(x, "claim")).otherwise(T.or_else(as_text(x)))
        relations = F.filter(F.transform(F.slice(items(member(x, "relations")), 1, RELATIONS), relation), lambda r: r["to"] != "")
        return F.struct(own("type", NO_TYPE).alias("type"), claim.alias("claim"), own("evidence", NO_EVIDENCE).alias("evidence"), own("source").alias("source"), own("confidence").alias("confidence"), relations.alias("relations"))

    return F.filter(F.transform(F.slice(items(v), 1, ITEMS), one), lambda s: s["claim"] != "")


def knowledge_map(v: Column) -> Column:
    conclusions, recall = texts(member(v, "coreConclusions"), CONCLUSIONS), texts(member(v, "recallQuestions"), RECALL)
    return F.struct(
        F.lit("map").alias("kind"), text(v, "title", "未命名知识地图").alias("title"), T.prefix(text(v, "summary"), SUMMARY_CHARS).alias("summary"), F.coalesce(F.try_element_at(conclusions, F.lit(1)), F.lit("")).alias("thesis"),
        text(v, "coreQuestion").alias("core_question"), conclusions.alias("core_conclusions"), map_items(member(v, "items")).alias("items"), records(member(v, "dataPoints"), DATA_POINTS).alias("data_points"),
        texts(member(v, "caveats"), CAVEATS).alias("caveats"), text(v, "mermaid").alias("mermaid"), text(v, "xmindOutline").alias("outline"), recall.alias("recall_questions"),
    )


def feynman_chapter(v: Column, index: Column) -> Column:
    def point(x: Column) -> Column:
        claim = F.when(is_object(x), text(x, "claim")).otherwise(T.or_else(as_text(x)))
        own = lambda f, back="": F.when(is_object(x), text(x, f, back)).otherwise(F.lit(back))
        return F.struct(claim.alias("claim"), own("data").alias("data"), own("evidence", NO_EVIDENCE).alias("evidence"))

    points = F.filter(F.transform(F.slice(items(member(v, "points")), 1, POINTS), point), lambda s: s["claim"] != "")
    title = F.coalesce(F.nullif(text(v, "title"), F.lit("")), F.concat(F.lit("第 "), index.cast("string"), F.lit(" 章")))
    return F.struct(
        index.alias("index"), title.alias("title"), points.alias("points"), text(v, "chapterMap").alias("chapter_map"), text(v, "explanation").alias("explanation"),
        texts(member(v, "gaps"), GAPS).alias("gaps"), texts(member(v, "corrections"), GAPS).alias("corrections"),
    )


def comparison(v: Column, most: int) -> Column:
    """Themes with the positions of documents; records that are no objects have no theme."""

    def positions(p: Column) -> Column:
        made = F.transform(F.slice(items(p), 1, POSITIONS[1]), lambda x: F.struct(text(x, "doc").alias("doc"), text(x, "view").alias("view")))
        return F.filter(made, lambda s: (s["doc"] != "") | (s["view"] != ""))

    made = F.transform(F.slice(items(v), 1, most), lambda c: F.struct(text(c, "theme").alias("theme"), positions(member(c, "positions")).alias("positions")))
    return F.filter(made, lambda c: c["theme"] != "")


def condense(parts: Column) -> Column:
    """Of each part the title, summary, thesis and first three arguments."""
    return F.transform(parts, lambda p: F.struct(p["title"].alias("title"), p["summary"].alias("summary"), p["thesis"].alias("thesis"), F.slice(p["arguments"], 1, 3).alias("arguments")))


def relation_graph(items: Column, conclusion: str) -> Column:
    """Sanitised items with what their relations lead to: index, claim, type, targets (index or null, type), unresolved, cyclic, conclusions, ends.

    A relation names the beginning of another claim: its target is the first other item that begins so. What an item reaches is
    spread along relations until nothing changes (item by item, a bit per item, so at most 63 of them: there are ITEMS): ``cyclic``
    items reach themselves, ``conclusions`` are the claims of the given type among the others, ``ends`` the indices that lead nowhere.
    """
    bit = lambda m, k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1)) == 1
    first = lambda to, i: F.try_element_at(F.filter(F.transform(items, lambda y, j: F.when((j != i) & F.startswith(y["claim"], to), j)), lambda j: j.isNotNull()), F.lit(1))
    linked = F.transform(items, lambda x, i: F.struct(i.alias("index"), x["claim"].alias("claim"), x["type"].alias("type"), F.transform(x["relations"], lambda r: F.struct(first(r["to"], i).alias("index"), r["type"].alias("type"), r["to"].alias("to"))).alias("targets")))
    mask = lambda x: F.aggregate(x["targets"], F.lit(0).cast("long"), lambda m, t: F.when(t["index"].isNull(), m).otherwise(m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), t["index"]))))

    def reached(direct: Column) -> Column:
        ks = F.transform(direct, lambda m, k: k)
        return F.aggregate(ks, direct, lambda reach, k: F.transform(reach, lambda m: F.when(bit(m, k), m.bitwiseOR(F.get(reach, k))).otherwise(m)))

    def told(linked: Column, direct: Column, reach: Column) -> Column:
        def one(x: Column) -> Column:
            i = x["index"]
            own = F.get(reach, i)
            others = F.filter(linked, lambda y: bit(own, y["index"]))
            found = F.transform(F.filter(others, lambda y: (y["type"] == conclusion) & (y["index"] != i)), lambda y: y["claim"])
            ends = F.transform(F.filter(others, lambda y: F.get(direct, y["index"]) == 0), lambda y: y["index"])
            unresolved = F.transform(F.filter(x["targets"], lambda t: t["index"].isNull()), lambda t: t["to"])
            return F.struct(i.alias("index"), x["claim"].alias("claim"), x["type"].alias("type"), x["targets"].alias("targets"), unresolved.alias("unresolved"), bit(own, i).alias("cyclic"), found.alias("conclusions"), ends.alias("ends"))

        return F.transform(linked, one)

    # each value is computed once, however often what follows reads it
    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return once(linked, lambda a: once(F.transform(a, mask), lambda d: once(reached(d), lambda r: told(a, d, r))))
