"""Best-fit packing by bin completion.

Only lengths decide a packing, so it is planned on the histogram of piece lengths (at most CAPACITY rows, whatever the
corpus holds). A plan is a list of patterns with multiplicities. The incumbent is best-fit decreasing. While it needs more
sequences than the lower bound, bin completion searches for a better one, at every size alike: around the largest piece
left, fillings of the rest of the sequence are enumerated by rising waste (sums that the lengths left can make follow from
a subset-sum table), dominated ones are left out (a filling is dominated if an unused length can take the place of some
of its pieces of no greater total), and fillings that waste more than an improvement can afford are pruned. A branch takes a pattern
as often as its pieces last; single copies are further branches. Best-fit decreasing completes every DEEP-th node, and a
better completion becomes the incumbent. The search ends at the lower bound, when all branches are cut, or after NODES nodes;
packing is NP-hard, so with the last of these the plan may be above the optimum, but never above best-fit decreasing.
Pieces then get their places in parallel: their rank among pieces of one length (per block, plus the blocks before it)
says which pattern and which copy of it they belong to.

Cases: null text is empty (one token, the end mark); repeated rows are packed each, ties go by row key, piece and place in
the input; a very long text is one row of a task (about 12 bytes an id); an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import Scratch, own_columns, row_key

CAPACITY, END = 1024, 2
#: Nodes of the search beyond best-fit decreasing, and levels between completions by it.
NODES, DEEP = 4000, 16
BLOCK_ROWS = 10_000


#: From runs of white space of this length on, and for strings of special tokens, ``tokenizers`` itself gives the ids.
LONG_SPACE = 4096


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The ``tokenizers`` file, its byte-level BPE run by tiktoken (same vocabulary, merges and ids, four times as fast), and what only the former reads right."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    file = json.load(open(path))
    special = [t["content"] for t in file.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile("|".join([rf"\s{{{LONG_SPACE}}}", *map(re.escape, special)]))
    return Tokenizer.from_file(path), fast, odd


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a document as ``tokenizers`` gives them, with the end mark."""
    whole, fast, odd = _encoder(path)
    text = text or ""
    ids = whole.encode(text, add_special_tokens=False).ids if odd.search(text) else fast.encode_ordinary(text)
    return np.array([*ids, END], "<u4")


def cut_points(n: int, capacity: int = CAPACITY) -> list[int]:
    """Starts of the pieces of n ids: whole if it fits, otherwise pieces of ``capacity`` after a first, perhaps shorter one."""
    if n <= capacity:
        return [0]
    head = n % capacity or capacity
    return [0, *range(head, n, capacity)]


def _sums(room: int, have: list[int], count: dict[int, int]) -> list[int]:
    """Per place i the sums up to ``room`` that pieces of have[i:] can make, as bits."""
    mask, out = (1 << (room + 1)) - 1, [1]
    for x in reversed(have):
        bits, n, k = out[-1], min(count[x], room // x), 1
        while n > 0:
            t = min(k, n)
            bits |= (bits << (x * t)) & mask
            n, k = n - t, 2 * k
        out.append(bits)
    return out[::-1]


def _dominated(filling: tuple[int, ...], slack: int, have: list[int], count: dict[int, int]) -> bool:
    """True if an unused piece can replace pieces of no greater total (none, one shorter, or several), within the slack."""
    some, several = 1, 0  # sums of subsets, and of subsets of two pieces or more
    for x in filling:
        several |= several << x | some >> 1 << 1 << x
        some |= some << x
    # sums up to ``slack`` above a subset's own; a single piece of equal length is no other filling
    reach, width = some << 1, 1
    while slack and width < slack:
        t = min(width, slack - width)
        reach |= reach << t
        width += t
    reach = several | (reach if slack else 0)
    used: dict[int, int] = {}
    for x in filling:
        used[x] = used.get(x, 0) + 1
    return any(reach >> x & 1 and count[x] > used.get(x, 0) for x in have)


def enumerate_fillings(room: int, have: list[int], count: dict[int, int], most_waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated multisets of lengths that fit into ``room`` and waste at most ``most_waste``, by rising waste, larger pieces first.

    ``have``: lengths in falling order.
    """
    have = [x for x in have if x <= room and count[x] > 0]
    reach = _sums(room, have, count)
    negative = [-x for x in have]

    def exact(i: int, left: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        for j in range(max(i, bisect_left(negative, -left)), len(have)):
            if not reach[j] >> left & 1:
                return
            x = have[j]
            for n in range(min(count[x], left // x), 0, -1):
                if reach[j + 1] >> (left - n * x) & 1:
                    for rest in exact(j + 1, left - n * x):
                        yield (x,) * n + rest

    for waste in range(min(most_waste, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for f in exact(0, room - waste):
                if not _dominated(f, waste, have, count):
                    yield f


def fillings(room: int, have: list[int], count: dict[int, int]) -> list[tuple[int, ...]]:
    """All undominated fillings of ``room``."""
    return list(enumerate_fillings(room, have, count, room))


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """The better of total length / capacity and, for each k, pieces over capacity - k that need a sequence of their own (Martello and Toth)."""
    total = sum(x * n for x, n in hist.items())
    bound = -(-total // capacity)
    for k in sorted({min(x, capacity - x) for x in hist if x != capacity}):
        big = sum(n for x, n in hist.items() if x > capacity - k)
        mid = [(x, n) for x, n in hist.items() if capacity - k >= x > capacity // 2]
        small = sum(x * n for x, n in hist.items() if capacity // 2 >= x >= k)
        room = sum((capacity - x) * n for x, n in mid)
        bound = max(bound, big + sum(n for _, n in mid) + max(0, -(-(small - room) // capacity)))
    return bound


Plan = list[tuple[int, tuple[int, ...]]]


def best_fit(hist: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, all pieces of a length and all sequences of equal contents at once."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(room: int, n: int, pattern: tuple[int, ...]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((n, pattern))

    for x in sorted((x for x in hist if hist[x] > 0), reverse=True):
        left = hist[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                room, n, pattern = capacity, -(-left // (capacity // x)), ()
            else:
                room = rooms[at]
                n, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            # the fullest sequence that a piece fits in stays the fullest: it takes as many as fit
            each = room // x
            full = min(n, left // each)
            if full:
                put(room - each * x, full, pattern + (x,) * each)
            left, n = left - full * each, n - full
            if n and left < each:
                if left:
                    put(room - left * x, 1, pattern + (x,) * left)
                    left, n = 0, n - 1
                if n and pattern:
                    put(room, n, pattern)
    return [g for room in open_ for g in open_[room]]


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """(copies, lengths in falling order) of every pattern; each piece of ``hist`` is in exactly one."""
    hist = {x: n for x, n in hist.items() if n > 0}
    bound = lower_bound(hist, capacity)
    best = best_fit(hist, capacity)
    return _search(hist, capacity, best, bound) if sum(n for n, _ in best) > bound else best


def _branches(capacity: int, count: dict[int, int], most_waste: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(copies, pattern) around the largest piece left: each as often as it can be, then once."""
    have = sorted((x for x in count if count[x] > 0), reverse=True)
    big, own = have[0], dict(count)
    own[big] -= 1
    for most in (True, False):
        for f in enumerate_fillings(capacity - big, have, own, most_waste):
            pattern = (big, *f)
            copies = min(count[x] // pattern.count(x) for x in set(pattern))
            waste = capacity - sum(pattern)
            copies = min(copies, most_waste // waste) if waste else copies
            if most or copies > 1:
                yield (copies if most else 1), pattern


def _search(hist: dict[int, int], capacity: int, incumbent: Plan, bound: int) -> Plan:
    """Branch and bound: depth first over patterns with their copies."""
    total = sum(x * n for x, n in hist.items())
    best, best_n = incumbent, sum(n for n, _ in incumbent)
    count, used, wasted, path = dict(hist), 0, 0, []
    spare = lambda: (best_n - 1) * capacity - total - wasted  # noqa: E731  waste that an improvement can still afford
    stack = [_branches(capacity, count, spare())]
    for node in range(NODES):
        if not stack or best_n == bound:
            break
        child = next(stack[-1], None) if spare() >= 0 else None
        if child is None or child[0] * (capacity - sum(child[1])) > spare():
            stack.pop()
            if path:
                n, pattern = path.pop()
                used, wasted = used - n, wasted - n * (capacity - sum(pattern))
                for x in pattern:
                    count[x] += n
            continue
        n, pattern = child
        path.append(child)
        used, wasted = used + n, wasted + n * (capacity - sum(pattern))
        for x in pattern:
            count[x] -= n
        left = {x: k for x, k in count.items() if k > 0}
        if not left or node % DEEP == 0:
            rest = best_fit(left, capacity)
            if used + sum(k for k, _ in rest) < best_n:
                best = [*path, *rest]
                best_n = sum(k for k, _ in best)
        big = sum(k for x, k in left.items() if 2 * x > capacity)
        fits = left and used + max(big, -(-sum(x * k for x, k in left.items()) // capacity)) < best_n
        stack.append(_branches(capacity, count, spare()) if fits else iter(()))
    return best


def _slots(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Per (length, first rank), sorted: pieces a sequence has of that length, first sequence, offset of the first."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for copies, lengths in patterns:
        at = 0
        for x in dict.fromkeys(lengths):
            k = lengths.count(x)
            rows.append(((x << 44) + used.get(x, 0), k, first, at))
            used[x] = used.get(x, 0) + copies * k
            at += k * x
        first += copies
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    d = own_columns(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                owner, piece, start, length, crc, salt, raw = [], [], [], [], [], [], []
                for i, text in enumerate(part.column(3)):
                    ids = token_ids(text.as_py(), tokenizer)
                    at = cut_points(len(ids), capacity)
                    for j, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
                        body = ids[a:b].tobytes()
                        for to, v in ((owner, i), (piece, j), (start, a), (length, b - a), (crc, zlib.crc32(body)), (salt, seen)):
                            to.append(v)
                        if with_ids:
                            raw.append(body)
                    seen += 1
                take = pa.array(owner, pa.int32())
                cols = [part.column(i).take(take) for i in (0, 1, 2)] + [pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc, salt)]
                yield pa.record_batch(cols + ([pa.array(raw, pa.binary())] if with_ids else []), names=["k1", "k2", "doc_id", "piece", "start", "length", "ids_crc32", "salt", *["ids"] * with_ids])

    schema = f"k1 long, k2 long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, salt long" + ", ids binary" * with_ids
    return d.select(*row_key(), "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(pieces(docs, tokenizer, capacity, with_ids), "pieces")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    # the salt spreads even rows that repeat in every column
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k1", "k2", "piece", "salt"), F.lit(blocks)))
    counts = scratch.cut(rows.groupBy("block", "length").agg(F.count("*").alias("n")), "counts")
    hist = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    start, per, first, offset = _slots(plan(hist, capacity))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("block", "length", "before")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("block", "length").orderBy("k1", "k2", "piece", "salt")) - 1)
    ranked = ranked.join(before, ["block", "length"]).withColumn("r", F.col("r") + F.col("before"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            length, rank = t.column("length").to_numpy(), t.column("r").to_numpy()
            at = np.searchsorted(start, (length << 44) + rank, "right") - 1
            i = rank - (start[at] & ((1 << 44) - 1)) if len(at) else rank
            seq, off = first[at] + i // per[at], offset[at] + i % per[at] * length
            yield pa.record_batch([t.column(c) for c in out] + [pa.array(seq), pa.array(off)], names=[*out, "sequence_id", "offset"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return scratch.done(ranked.select(*out, "r").mapInArrow(run, schema))
