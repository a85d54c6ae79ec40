"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns per text. Further candidates (provider tokens, key blocks, long mixed strings) are
noisy: documentation samples, licence hashes and test fixtures look the same. Their values are hashed and aggregated
over the whole corpus by distinct repositories (documents) and owners (sources): a candidate whose value belongs to one
owner looks live and is added; a value that several owners copy is an example and is not. Base spans always stay;
their ownership is reported. Counting is two grouped aggregations (value x owner, then value), both combined before the
shuffle, so one value that a third of all rows hold is one row per task.

Cases: null text is empty; a null source is an owner of its own, apart from the empty one; repeated rows are one
repository; spans of one start come in the order of the kinds; a very long text is one row of a task, searched in time
in proportion to its length; an empty table gives an empty result; columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import Scratch, own_columns, row_key, spare_names

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Order of the kinds among spans of one start.
KINDS = ("assign", "access", "hex", "key_block", "provider", "jwt", "mixed")
ADDED = {
    "key_block": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    "provider": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])"),
}
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: A value of at least this many owners is a widely copied example.
EXAMPLE_OWNERS = 3


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value): leftmost non-overlapping matches of each base pattern, then those long enough."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    # a run of hexadecimal characters of the wanted length is a maximal run that is at least as long
    out += [(m.start(), 2, m.end(), m[0]) for m in _LONG_HEX.finditer(text)]
    return sorted(out)


def added_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that no base span and no earlier kind overlaps."""
    out: list[tuple[int, int, int, str]] = []
    # what is taken, as disjoint ranges in order
    starts, ends = [], []
    for a, _, b, _ in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for number, kind in enumerate(KINDS[3:], 3):
        for m in ADDED[kind].finditer(text):
            v = m[0]
            if kind == "mixed" and not (any(c.isdigit() for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v)):
                continue
            at = bisect_left(starts, m.end())
            if not at or ends[at - 1] <= m.start():
                out.append((m.start(), number, m.end(), v))
                starts.insert(at, m.start())
                ends.insert(at, m.end())
    return sorted(out)


def _value(v: str) -> int:
    return int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        for lo in range(0, n, 512):
            part = batch.slice(lo, 512)
            found = []
            for text in part.column(4):
                t = text.as_py() or ""
                base = base_spans(t)
                found.append([{"start": s, "kind": k, "end": e, "value": _value(v)} for s, k, e, v in base + added_spans(t, base)])
            yield pa.record_batch([part.column(i) for i in range(4)] + [pa.array(found, _SPAN)], names=["k1", "k2", "doc_id", "source", "found"])


def scan(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, spans (array of start, kind, end, owners, repositories, live) for every row of ``docs``."""
    d = own_columns(docs, "doc_id", "source", "text")
    keyed = d.select(*row_key(), "doc_id", F.to_json(F.array(F.col("source").cast("string"))).alias("source"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(keyed.mapInArrow(_scan, f"k1 long, k2 long, doc_id {kind}, source string, found array<struct<start: long, kind: int, end: long, value: long>>"), "candidates")
    each = rows.where("size(found) > 0").select("k1", "k2", "source", F.explode("found").alias("f")).select("k1", "k2", "source", "f.*")
    one = each.select("value", "source", "k1", "k2").distinct()
    per_owner = one.groupBy("value", "source").agg(F.count("*").alias("n"))
    # a table of its own, so that the join's partition of a value that very many texts hold can be split
    owned = scratch.cut(per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories")), "owned")
    judged = each.join(owned, "value").withColumn("live", F.col("owners") < EXAMPLE_OWNERS)
    judged = judged.where("kind < 3 or live")
    per_row = judged.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("spans"))
    return scratch.done(rows.select("k1", "k2", "doc_id").join(per_row, ["k1", "k2"], "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, owners: bigint, repositories: bigint, live: boolean>>)"))))


_NAMES = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


def result(docs: DataFrame) -> DataFrame:
    x = scan(docs).withColumn("base", F.expr("filter(spans, s -> s.kind < 3)"))
    count = lambda k: F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)")
    join = lambda c: F.expr(f"array_join(transform({c}, s -> concat({_NAMES}[s.kind], ':', s.start, ':', s.end)), ',')")
    return x.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(join("base"), 256).alias("base_sha256"), join("spans").alias("spans"),
        F.expr("cast(size(filter(spans, s -> s.live)) as bigint)").alias("n_live"), F.expr("cast(size(filter(spans, s -> not s.live)) as bigint)").alias("n_copied"),
    )


def _redact(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, spans = batch.column(at), batch.column(batch.schema.get_field_index(column))
            out = []
            for t, s in zip(texts.to_pylist(), spans.to_pylist()):
                if t is not None and s:
                    parts, end = [], 0
                    for x in s:
                        if x["end"] > end:
                            parts.append(t[end : max(end, x["start"])])
                            if x["start"] >= end:
                                parts.append("[SECRET]")
                            end = x["end"]
                    t = "".join(parts) + t[end:]
                out.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(out, texts.type)
            yield pa.record_batch(columns, schema=batch.schema)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[SECRET]`` in the text (overlapping spans by one); a column n_chars follows the text."""
    k1, k2, spans = spare_names(docs, "k1", "k2", "spans")
    found = scan(docs).where("size(spans) > 0").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)).dropDuplicates([k1, k2])
    key = row_key()
    x = docs.withColumns({k1: key[0], k2: key[1]}).join(found, [k1, k2], "left").drop(k1, k2)
    x = x.mapInArrow(_redact(spans), x.schema).drop(spans)
    return x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else x
