"""Reading the JSON that a model wrote: fences, prose around it, raw control characters, trailing commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import text as T

#: Shortest first: a string literal (its escapes possessive, so that no input is walked twice), or what lies between.
_PIECES = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^"\\]++|\\.?'


def repair(c: Column) -> Column:
    """Raw line breaks, carriage returns and tabs inside string literals, escaped."""

    def piece(p: Column) -> Column:
        fixed = p
        for raw, to in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            fixed = F.replace(fixed, F.lit(raw), F.lit(to))
        return F.when(F.startswith(p, F.lit('"')), fixed).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_PIECES), F.lit(0)), piece), "")


def no_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def unfenced(c: Column) -> Column:
    c = T.trim(c)
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


def parse(c: Column) -> Column:
    """The first candidate that is JSON, as a variant: the whole text, then from the first { to the last }; each as it is,
    repaired, and both without trailing commas. Null if none is."""
    tries = []
    whole = unfenced(c)
    outer = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    for raw in (whole, F.nullif(outer, F.lit(""))):
        for x in (raw, repair(raw), no_trailing_commas(raw), no_trailing_commas(repair(raw))):
            tries.append(F.try_parse_json(x))
    return F.coalesce(*tries)


def truncated(c: Column) -> Column:
    """Not blank, and not closed by a bracket."""
    t = T.trim(c)
    return (t != "") & ~F.right(t, F.lit(1)).isin("}", "]")
