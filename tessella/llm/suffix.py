"""Exact repeated substrings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``least`` bytes that covers it starts anywhere else in the corpus too. The corpus is split so
that equal strings meet in one task, without moving the whole corpus:

1. Anchors. Every window of ``least`` bytes names the position of its least ANCHOR-byte hash (leftmost of equals) as
   its anchor; equal windows name equal anchors at equal places. Windows with one anchor are neighbours; the bytes that
   they cover are the anchor's context, and each window lies in exactly one context.
2. Anchors that occur once are done. Contexts that are equal byte for byte (by a 128-bit hash) repeat as a whole; one
   copy of each stays to be compared with contexts that only partly agree. Counts are grouped aggregations, combined
   before the shuffle.
3. Shards. What is left, by anchor, is cut out of the texts and dealt to tasks. An anchor with more than HOT_BYTES of
   contexts (a line that very many texts share) is dealt by the hashes of its windows instead: no task needs to hold it.
4. In each shard the contexts are joined, suffix-sorted, and transformed. Intervals are expanded breadth first, one more
   byte to the left a level, by the runs of one byte in the transform; a level's new interval borders are the suffixes whose common prefix with their
   predecessor has exactly that length. Expansion stops at ``least``: borders never reached are common prefixes
   of at least that length, and both suffixes start a repeated string.

Cases: null text is empty; matches never cross texts; repeated rows are copies of each other, so all their long
strings repeat; of equal hashes the leftmost counts; a very long text is read CHUNK windows at a time (a context ends there,
which changes no result) and its bytes are one row; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.store import Scratch, own_columns, row_key

LEAST, ANCHOR = 400, 64
#: Bytes of contexts that a shard has on average, and of one anchor's contexts that it takes at most.
SHARD_BYTES, HOT_BYTES = 1 << 20, 2 << 20
#: Window starts of one text that are looked at together.
CHUNK = 1 << 19
#: Bytes of rows that are looked at side by side.
BESIDE = 1 << 16
#: Bits of a place within them, and of the hash compared.
_PLACE_BITS = np.uint64(21)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value in every run of ``width``, by block-wise running minima.

    Values are compared by the bits that a position leaves free in 64; the leftmost of equals counts.
    """
    n, bits = len(h) - width + 1, max(_PLACE_BITS, np.uint64(int(len(h) - 1).bit_length()))
    blocks = -(-len(h) // width)
    packed = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    packed[: len(h)] = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    grid = packed.reshape(blocks, width)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    fore = np.minimum.accumulate(grid, 1).ravel()
    low = np.minimum(back[:n], fore[width - 1 : width - 1 + n])
    return (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def contexts(data: np.ndarray, offsets: np.ndarray, least: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, first and last window start (within the row), and two hashes of the bytes, of every context."""
    if len(offsets) == 2 and len(data) >= least + CHUNK:
        # a very long text, some window starts after the other; a context may end at each cut
        parts = []
        for lo in range(0, len(data) - least + 1, CHUNK):
            row, h, first, last, w1, w2 = contexts(data[lo : lo + CHUNK + least - 1], np.array([0, min(CHUNK + least - 1, len(data) - lo)]), least, anchor)
            parts.append((row, h, first + lo, last + lo, w1, w2))
        return tuple(np.concatenate(x) for x in zip(*parts))
    sums = A.prefix_sums(data)
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    width = least - anchor + 1
    # rows side by side, some at a time so that their arrays stay in a processor's cache
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BESIDE, "right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a >= least:
            pos = np.arange(a, b - anchor + 1)
            h = A.span_hashes(sums, pos, pos + anchor)
            spot = sliding_least(h, width)
            # windows that leave their row are none
            for end in (offsets[lo + 1 : hi + 1] - a).tolist():
                spot[max(0, end - least + 1) : end] = -1
            first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
            last = np.append(first[1:], len(spot)) - 1
            real = spot[first] >= 0
            first, last = first[real], last[real]
            row = np.searchsorted(offsets, a + first, "right") - 1
            lead = (spot[first] - first).astype(np.uint64)
            whole = A.span_hashes(sums, a + first, a + last + least)
            whole2 = A.mix(whole ^ (A.span_hashes(sums, a + first, a + (first + last + least) // 2) * A.BASE) + lead + (last - first).astype(np.uint64) * A.U(1 << 20))
            begin = offsets[row] - a
            for to, v in zip(out, (row, h[spot[first]], first - begin, last - begin, whole, whole2)):
                to.append(v)
        lo = hi
    if not out[0]:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in out)


def suffix_order(text: np.ndarray, depth: int, separators: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more, by prefix doubling from a few symbols on.

    Symbols below ``separators`` occur once each, ascending. Keys carry their place in the low bits, so that sorting them
    sorts the places too, and only suffixes that equal others so far are sorted again. Suffixes that agree up to
    ``depth`` stand in any order; they share every interval of strings up to ``depth``.
    """
    n = len(text)
    place = n.bit_length()
    low = (1 << place) - 1
    # all separators are 0, and nothing behind one counts: the places then order what agrees up to one
    code = np.maximum(text - (separators - 1), 0)
    bits = int(code.max()).bit_length()
    k = max(1, min((63 - place) // bits, depth))
    pad = np.concatenate([code, np.zeros(k, np.int64)])
    key, real = code.copy(), code > 0
    for j in range(1, k):
        key <<= bits
        key += pad[j : n + j] * real
        real &= pad[j : n + j] > 0
    key <<= place
    key |= np.arange(n)
    key.sort()
    order = (key & low).astype(np.int32)
    key >>= place
    new = ~real[order]
    new[0] = True
    new[1:] |= key[1:] != key[:-1]
    # a suffix's rank is the first place of those that equal it so far
    slots = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        if k >= depth or not len(slots):
            return order
        who = order[slots]
        key = (rank[who].astype(np.int64) << place) | rank[np.minimum(who + k, n)]
        if 3 * place <= 63:
            key <<= place
            key |= who
            key.sort()
            who = (key & low).astype(np.int32)
            key >>= place
        else:
            s = np.argsort(key)
            key, who = key[s], who[s]
        order[slots] = who
        new = np.ones(len(who), bool)
        new[1:] = key[1:] != key[:-1]
        rank[who] = np.maximum.accumulate(np.where(new, slots, 0))
        k *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, least: int, separators: int) -> np.ndarray:
    """True at i > 0 if suffixes order[i - 1] and order[i] share at least ``least`` symbols.

    Symbols below ``separators`` occur once each; they end every common prefix and are never extended by.
    """
    n = len(text)
    # the transform, in a few bits: all separators are 0
    bwt = np.maximum(text[order - 1] - separators + 1, 0).astype(np.uint16)
    by_symbol = np.argsort(bwt, kind="stable")
    # LF: where the suffix one symbol longer stands
    lf = np.empty(n, np.int32)
    lf[by_symbol] = np.arange(n, dtype=np.int32)
    # runs of one symbol in the transform: images of a run are consecutive, so its first place and a shift give them all
    turn = np.ones(n, bool)
    turn[1:] = bwt[1:] != bwt[:-1]
    run = np.cumsum(turn, dtype=np.int32) - np.int32(1)
    start = np.append(np.flatnonzero(turn), n).astype(np.int32)
    shift = lf[start[:-1]] - start[:-1]
    symbols = bwt[start[:-1]]
    if symbols.max() < 256:
        symbols = symbols.astype(np.uint8)
    reached = np.zeros(n + 1, bool)
    reached[: separators + 1] = reached[n] = True
    # strings of one symbol: each separator, then a run of suffixes for every other symbol
    first = bwt[by_symbol[separators:]]
    hi = separators + np.concatenate([np.flatnonzero(first[1:] != first[:-1]) + 1, [n - separators]])
    hi = np.concatenate([np.arange(1, separators + 1), hi]).astype(np.int32)
    lo = np.concatenate([[0], hi[:-1]]).astype(np.int32)
    reached[hi] = True
    for _ in range(least - 1):
        # the level's intervals cut at runs, one symbol longer; images of one interval and symbol are consecutive
        head = run[lo]
        count = run[hi - 1] - head + 1
        ends = np.cumsum(count)
        which = np.repeat(np.arange(len(lo), dtype=np.int32), count)
        piece = np.arange(ends[-1], dtype=np.int32) + (head - ends + count).astype(np.int32)[which]
        # intervals stand in order, so by symbol (a radix sort) their images do
        s = np.argsort(symbols[piece], kind="stable")
        symbol = symbols[piece[s]]
        real = int(np.searchsorted(symbol, 1))
        s, symbol = s[real:], symbol[real:]
        if not len(s):
            break
        piece, which = piece[s], which[s]
        new = np.ones(len(piece), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (which[1:] != which[:-1])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(piece)) - 1
        whose, a, z = which[a], piece[a], piece[z]
        lo, hi = np.maximum(start[a], lo[whose]) + shift[a], np.minimum(start[z + 1], hi[whose]) + shift[z]
        fresh = ~reached[hi]
        lo, hi = lo[fresh], hi[fresh]
        reached[hi] = True
        if not len(lo):
            break
    return ~reached[:n]


def repeated_starts(parts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of ``least`` bytes that occurs twice or more in ``parts``: part number and start, for every occurrence."""
    size = np.array([len(p) for p in parts])
    text = np.empty(int(size.sum()) + len(parts), np.int64)
    ends = np.cumsum(size + 1) - 1
    begin = ends - size
    for p, b in zip(parts, begin.tolist()):
        text[b : b + len(p)] = p
    text[ends] = 0
    # the bytes that occur, numbered in order behind the separators
    seen = np.bincount(text, minlength=256) > 0
    text = (np.cumsum(seen) - 1 + len(parts))[text]
    text[ends] = np.arange(len(parts))
    order = suffix_order(text, least, len(parts))
    long = long_prefixes(text, order, least, len(parts))
    hit = long.copy()
    hit[:-1] |= long[1:]
    at = np.sort(order[hit])
    part = np.searchsorted(ends, at)
    return part, at - begin[part]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    brk = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], brk + 1])].tolist(), starts[np.append(brk, len(starts) - 1)].tolist()))


_RUNS = "k1 long, k2 long, lo long, hi long"


def _anchors(least: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in A.slices(batch):
                row, h, first, last, w1, w2 = contexts(s.data, s.offsets, least, anchor)
                take = pa.array((row + s.lo).astype(np.int32))
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(x.view(np.int64)) for x in (h, first, last, w1, w2)]], names=["k1", "k2", "anchor", "lo", "hi", "c1", "c2"])

    return run


def _cut_out(least: int):
    """Texts with their wanted contexts -> one row per context with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                want = part.column(3).to_pylist()
                rows, anchors, starts, raw, hot = [], [], [], [], []
                for i, (text, w) in enumerate(zip(part.column(2), want)):
                    data = text.as_py()
                    for x in w:
                        rows.append(i)
                        anchors.append(x["anchor"])
                        starts.append(x["lo"])
                        hot.append(x["hot"])
                        raw.append(data[x["lo"] : x["hi"] + least])
                take = pa.array(rows, pa.int32())
                yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), pa.array(anchors, pa.int64()), pa.array(starts, pa.int64()), pa.array(hot, pa.bool_()), pa.array(raw, pa.binary())], names=["k1", "k2", "anchor", "lo", "hot", "bytes"])

    return run


def _shard(least: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("bytes").to_pylist()]
        part, at = repeated_starts(parts, least)
        k1, k2, lo = (table.column(c).to_numpy() for c in ("k1", "k2", "lo"))
        out = []
        cuts = np.searchsorted(part, np.arange(len(parts) + 1))
        for i in range(len(parts)):
            for a, b in _runs(at[cuts[i] : cuts[i + 1]]):
                out.append((i, lo[i] + a, lo[i] + b + least))
        who = np.array([o[0] for o in out], np.int64)
        return pa.table({"k1": pa.array(k1[who]), "k2": pa.array(k2[who]), "lo": pa.array([o[1] for o in out], pa.int64()), "hi": pa.array([o[2] for o in out], pa.int64())})

    return run


def _windows(least: int):
    """Contexts of hot anchors -> one row per window with a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(3)[i].as_py(), np.uint8)
                sums, at = A.prefix_sums(data), np.arange(len(data) - least + 1)
                w1 = A.span_hashes(sums, at, at + least)
                w2 = A.mix(w1 ^ A.span_hashes(sums, at, at + least // 2) * A.BASE)
                take = pa.array(np.full(len(at), i, np.int32))
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(at + batch.column(2)[i].as_py())], names=["k1", "k2", "w1", "w2", "lo"])

    return run


def repeats(docs: DataFrame, scratch: Scratch, least: int = LEAST, anchor: int = ANCHOR) -> DataFrame:
    """k1, k2, lo, hi: byte ranges that strings of ``least`` bytes occurring twice or more cover (they may overlap)."""
    texts = own_columns(docs, "doc_id", "text").select(*row_key(), F.encode("text", "UTF-8").alias("text"))
    all_ = scratch.cut(texts.mapInArrow(_anchors(least, min(anchor, least)), "k1 long, k2 long, anchor long, lo long, hi long, c1 long, c2 long"), "anchors")
    # anchors that occur once are done; of the others contexts are counted by content. Both counts combine before they move
    # counts by anchor are tables of their own, so that a join's partition of a hot anchor can be split
    often = scratch.cut(all_.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    again = scratch.cut(all_.join(often, "anchor", "left_semi"), "repeated")
    scratch.drop(all_, often)
    content = scratch.cut(again.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one")), "contents")
    kinds = content.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("one.hi") - F.col("one.lo") + least).alias("n_bytes"))
    kinds = scratch.cut(kinds.where("kinds > 1"), "kinds")
    whole = content.where("copies > 1").select("anchor", "c1", "c2")
    copies = again.join(whole, ["anchor", "c1", "c2"], "left_semi").select("k1", "k2", "lo", (F.col("hi") + least).alias("hi"))
    # one copy of each content goes into the comparison; copies that repeat as a whole need no other result
    compare = content.join(kinds, "anchor").select("anchor", "one.*", (F.col("n_bytes") > HOT_BYTES).alias("hot"))
    wanted = compare.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "lo", "hi", "hot")).alias("want"))
    raw = texts.join(wanted, ["k1", "k2"]).mapInArrow(_cut_out(least), "k1 long, k2 long, anchor long, lo long, hot boolean, bytes binary")
    raw = scratch.cut(raw.dropDuplicates(["k1", "k2", "lo"]), "bytes")
    size = raw.where("not hot").agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    cold = raw.where("not hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = cold.groupBy("shard").applyInArrow(_shard(least), _RUNS)
    windows = raw.where("hot").select("k1", "k2", "lo", "bytes").mapInArrow(_windows(least), "k1 long, k2 long, w1 long, w2 long, lo long")
    twice = scratch.cut(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "twice")
    hot = windows.join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "lo", (F.col("lo") + least).alias("hi"))
    return copies.union(found).union(hot)


def _remove(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept, spans = [], [], [], [], []
            for text, got in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                data, runs = text.as_py() or b"", []
                for x in sorted((r["lo"], r["hi"]) for r in got.as_py() or []):
                    if runs and x[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x[1])
                    else:
                        runs.append([x[0], x[1]])
                edges = [0, *[e for r in runs for e in r], len(data)]
                rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(rest))
                n_spans.append(len(runs))
                kept.append(hashlib.sha256(rest).hexdigest())
                spans.append([{"lo": a, "hi": b} for a, b in runs])
            yield pa.record_batch(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                names=names,
            )

    return run


def removals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed) of every row."""
    d = own_columns(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    runs = repeats(docs, scratch, least).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    x = d.select(*row_key(), "doc_id", F.encode("text", "UTF-8").alias("text")).join(runs, ["k1", "k2"], "left").select("doc_id", "text", "runs")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    return scratch.done(x.mapInArrow(_remove(names), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>"))


def result(docs: DataFrame) -> DataFrame:
    return removals(docs).drop("spans")
