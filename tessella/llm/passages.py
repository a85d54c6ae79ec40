"""Near-duplicate passages by compact windows.

A text is the sequence of hashes of its 5-word shingles. Under a hash function every run of shingles has a least value;
all runs [i, j] with l <= i <= c <= j <= r share the least value at c: one compact window (l, c, r) stands for them. The
windows that hold a run of at least LEAST shingles are the nodes of the Cartesian tree of the values whose range is that
long, which are exactly the least positions of all runs of LEAST shingles; their number is about 2 n / LEAST.

1. HASHES functions give windows (value, text, extent). The extent is [l, r], at most REACH on either side of c: a
   shortest passage with its least value at c lies inside. Equal texts are one class throughout (named by a hash of
   their words), so copies add nothing.
2. Windows of one value meet by their extents (an interval join within the value). Equal extents, by a 128-bit hash,
   share a passage at once: every class is linked with one of them, and one extent of each content goes on.
3. Values with two or three different extents give their pairs of classes, verified on the whole texts: maximal ranges
   of shingles of one text, at least LEAST long, whose Jaccard similarity with the range of the other text that their
   common shingles span is at least SIMILARITY; at least SIMILARITY * LEAST different shingles must be common, so a few
   words over and over are no passage.
4. Values with more extents are solved on the extents themselves by the same test: extents are compared until all that
   share a passage are connected; what is connected already is not compared again, so a passage that k texts share costs
   about k tests. Groups of more than LARGE extents are joined to their most frequent one first; what that does not
   link is compared, in blocks, with all the others. The pairs found are verified on the whole texts as in 3 for their
   full ranges; what the extents showed stays a link in any case.

A range of 50 words at similarity 0.8 shares the value of one function with probability 0.8, so 1 of 600 such pairs
meets under none of the four functions; identical passages always meet. Longer ranges hold several windows for every function.

Cases: null, empty and short texts (under 50 words) have no passages; repeated rows are copies; a null doc_id takes
part, and gets a null doc_id in the result; of equal values the leftmost is least; a very long text is one row of a task,
with arrays of about 100 times its bytes; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.near_dup import numbered, with_ids
from tessella.llm.store import Scratch, components
from tessella.llm.suffix import sliding_least

SHINGLE, WORDS, HASHES, SIMILARITY = 5, 50, 4, 0.8
#: Shingles of the shortest passage, and different ones that a passage has in common with another at least.
LEAST = WORDS - SHINGLE + 1
COMMON = SIMILARITY * LEAST
#: Share of shingles of a passage that the other text has, and number in the shortest.
SHARE = 2 * SIMILARITY / (1 + SIMILARITY)
HITS = SHARE * LEAST
_SEED = A.seeds(HASHES, 41)
_CODEC = pa.Codec("zstd")
#: Pairs whose texts a task reads together.
PAIRS = 256
#: Values of up to FEW extents give pairs, of up to LARGE are solved whole, beyond in blocks of about BLOCK.
FEW, LARGE, BLOCK = 3, 16384, 16384
#: Extents that a task solves together, on average.
TOGETHER = 8192
#: A shingle of more extents of a group than this is not looked up; 36 of them are no passage.
RARE = 16
#: Shingles on either side of a window's least one: a shortest passage that holds it, on either text, lies inside.
REACH = int(LEAST / SIMILARITY) + 1


def shingle_sequences(s: A.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all rows in order, where each row's begin, a hash of each row's words, and its number of words."""
    data = A.LOWER[s.data]
    starts, ends, first = A.word_bounds(data, s.offsets)
    words = A.span_hashes(A.prefix_sums(data), starts, ends)
    h, begin = A.shingle_hashes(words, first, SHINGLE)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    total = np.concatenate([[np.uint64(0)], np.cumsum(A.mix(words + A.mix(place.astype(np.uint64) + A.U(1))))])
    n = np.diff(first)
    return h, begin, A.mix((total[first[1:]] - total[first[:-1]]) ^ n.astype(np.uint64)), n


def compact_windows(value: np.ndarray, begin: np.ndarray, least: int, reach: int | None = None) -> tuple[np.ndarray, ...]:
    """Row, c, l, r (places in ``value``) of every compact window that holds a run of ``least`` values of its row.

    Of equal values the leftmost is least. With ``reach``, l and r lie at most that far from c.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(value) < least:
        return none
    size = np.diff(begin)
    runs = np.maximum(size - least + 1, 0)
    at = np.repeat(begin[:-1] - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
    if not len(at):
        return none
    low = sliding_least(value, least)[at]
    # the least places of consecutive runs only move on
    c = low[np.concatenate([[True], low[1:] != low[:-1]])]
    row = np.searchsorted(begin, c, "right") - 1
    first, last = np.asarray(begin)[row], np.asarray(begin)[row + 1] - 1
    left, right = (first, last) if reach is None else (np.maximum(first, c - reach), np.minimum(last, c + reach))
    left, right = left.copy(), right.copy()
    # the nearest lesser value on either side has a longer range, so it is one of these places too: all climb in step
    v, n = value[c], len(c)
    for step, edge in ((-1, left), (1, right)):
        active, other = np.arange(n), np.arange(n) + step
        while len(active):
            j = other[active]
            inside = (j >= 0) & (j < n)
            active, j = active[inside], j[inside]
            inside = (c[j] >= left[active]) & (c[j] <= right[active]) & (row[j] == row[active])
            active, j = active[inside], j[inside]
            stop = v[j] <= v[active] if step < 0 else v[j] < v[active]
            edge[active[stop]] = c[j[stop]] - step
            active = active[~stop]
            other[active] += step
    return row, c, left, right


def _repeats(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an equal shingle stands last before every place (-1: nowhere), and up to every place how many have one at most 2 REACH places before."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    before = np.full(len(h), -1)
    before[order[1:][same]] = order[:-1][same]
    near = (before >= 0) & (np.arange(len(h)) - before <= 2 * REACH)
    return before, np.concatenate([[0], np.cumsum(near)])


def _varied(before: np.ndarray, near: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True where the range [lo, hi) has COMMON different shingles or more."""
    good = (hi - lo) - (near[hi] - near[lo]) >= COMMON
    unsure = np.flatnonzero(~good & (hi - lo >= COMMON))
    for part in np.array_split(unsure, max(1, len(unsure) // 4096)):
        at = lo[part, None] + np.arange(2 * REACH + 1)[None, :]
        inside = at < hi[part, None]
        good[part] = (inside & (before[np.where(inside, at, 0)] < lo[part, None])).sum(1) >= COMMON
    return good


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch):
            h, begin, name, _ = shingle_sequences(s)
            p, inverse = A.powers(len(h) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(h ^ A.BASE) * p[: len(h)])])
            before, near = _repeats(h)
            for k in range(HASHES):
                row, c, lo, hi = compact_windows(A.mix(h ^ _SEED[k]), begin, LEAST, REACH)
                if not len(c):
                    continue
                value, hi = A.mix(h[c] ^ _SEED[k] ^ A.BASE), hi + 1
                content = A.mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))
                # windows of one text with equal extents say the same
                _, one = np.unique(A.mix(content ^ value) + A.mix(row.astype(np.uint64)), return_index=True)
                one = one[_varied(before, near, lo[one], hi[one])]
                cols = [value[one].view(np.int64), content[one].view(np.int64), name[row[one]].view(np.int64), lo[one] - begin[row[one]], (hi - lo)[one].astype(np.int16)]
                yield pa.record_batch([pa.array(x) for x in cols], names=["value", "content", "name", "at", "size"])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch):
            _, _, name, n = shingle_sequences(s)
            yield pa.record_batch([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(name.view(np.int64)), pa.array(n)], names=["node", "name", "n_words"])


def _named_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch):
            _, _, name, n = shingle_sequences(s)
            keep = pa.array(n >= WORDS)
            # packed: texts move up to three times
            packed = [s.offsets[i + 1].item() - s.offsets[i].item() for i in range(len(n))]
            packed = [k.to_bytes(8, "little") + _CODEC.compress(s.text(i), asbytes=True) if n[i] >= WORDS else None for i, k in enumerate(packed)]
            yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(packed, pa.binary())], names=["name", "text"]).filter(keep)


def dense_ranges(hit: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Ranges [a, b) that begin on a hit, and end on one if they can, at least ``least`` long, in which hits are at least ``share``; disjoint, greedily longest."""
    cost = share / (1 - share)
    score = np.concatenate([[0.0], np.cumsum(np.where(hit, 1.0, -cost))])
    if len(hit) < least or (score[least:] - np.minimum.accumulate(score)[:-least]).max() < -1e-9:
        return []
    best = np.maximum.accumulate(score[::-1])[::-1]
    out, done = [], 0
    # a range that begins inside a run of hits is never better than one from the run's start
    for a in np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]])).tolist():
        a = max(a, done)
        if a + least > len(hit) or not hit[a] or best[a + least] < score[a] - 1e-9:
            continue
        # the farthest end from which the score since a is not negative
        ends = score[a + least :] >= score[a] - 1e-9
        # on a hit where the length allows it
        on_hit = ends & hit[a + least - 1 :]
        ends = np.flatnonzero(on_hit if on_hit.any() else ends)
        b = a + least + int(ends[-1])
        # not across a gap that no shorter range could cross
        drop = np.flatnonzero(score[a + 1 : b + 1] < score[a] - cost * SHINGLE * 2)
        if len(drop):
            ends = ends[ends + least <= drop[0]]
            if not len(ends):
                continue
            b = a + least + int(ends[-1])
        out.append((a, b))
        done = b
    return out


def may_be_dense(hit: np.ndarray) -> np.ndarray:
    """Which rows of ``hit`` may have a range as ``dense_ranges`` finds it for a passage."""
    if hit.shape[1] < LEAST:
        return np.zeros(len(hit), bool)
    score = np.zeros((len(hit), hit.shape[1] + 1), np.float32)
    np.cumsum(np.where(hit, np.float32(1), np.float32(-SHARE / (1 - SHARE))), axis=1, out=score[:, 1:])
    return (score[:, LEAST:] - np.minimum.accumulate(score, axis=1)[:, :-LEAST]).max(1) >= -1e-2


def similar_ranges(x: np.ndarray, y: np.ndarray, order: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Ranges of shingles of ``x`` with a range of ``y`` (``order``: of y's values), of similarity SIMILARITY and more."""
    order = np.argsort(y) if order is None else order
    ranked = y[order]
    at = np.minimum(np.searchsorted(ranked, x), len(y) - 1)
    hit = ranked[at] == x
    if hit.sum() < HITS:
        return []
    place = np.where(hit, order[at], -1)
    out = []
    for a, b in dense_ranges(hit, LEAST, SHARE):
        spots = np.sort(place[a:b][hit[a:b]])
        # shingles that also stand elsewhere in y would stretch the range: keep what lies around its middle
        mid = spots[len(spots) // 2]
        spots = spots[np.abs(spots - mid) <= (b - a)]
        lo, hi = int(spots[0]), int(spots[-1]) + 1
        p, q = np.unique(x[a:b]), np.unique(y[lo:hi])
        both = len(np.intersect1d(p, q, assume_unique=True))
        # a few shingles over and over are no passage
        if both >= SIMILARITY * max(LEAST, len(p) + len(q) - both):
            out.append((a, b, lo, hi))
    return out


def _unpacked(packed: list[bytes]) -> list[np.ndarray]:
    """Shingles of packed texts."""
    texts = [_CODEC.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in packed]
    out = []
    for s in A.slices(pa.record_batch([pa.array(texts, pa.large_binary())], names=["text"])):
        h, begin, _, _ = shingle_sequences(s)
        out += [h[a:b].copy() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    return out


def _both_ways(a: int, b: int, of_a: tuple[np.ndarray, np.ndarray], of_b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(name, other, lo, hi) of the word ranges that two texts share; what either direction finds holds for both."""
    (x, x_order), (y, y_order) = of_a, of_b
    out = []
    for p, q, r, t in similar_ranges(x, y, y_order):
        out += [(a, b, p, q + SHINGLE - 1), (b, a, r, t + SHINGLE - 1)]
    for p, q, r, t in similar_ranges(y, x, x_order):
        out += [(b, a, p, q + SHINGLE - 1), (a, b, r, t + SHINGLE - 1)]
    return out


def _extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every wanted extent of a packed text its shingles in order (32 bits of each)."""
    for part in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        want = part.column(2)
        flat, per_text = want.flatten(), np.diff(want.offsets.to_numpy())
        text = np.repeat(np.arange(part.num_rows), per_text)
        value, content, often, at, size = (flat.field(k).to_numpy().astype(np.int64) for k in range(5))
        own = _unpacked(part.column(1).to_pylist())
        begin = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        own = (np.concatenate(own) >> A.U(32)).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(size)])
        items = own[np.repeat(begin[text] + at - ends[:-1], size) + np.arange(ends[-1])]
        raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(items.tobytes())])
        yield pa.record_batch([pa.array(value), pa.array(content), pa.array(often), part.column(0).take(pa.array(text)), pa.array(at), raw], names=["value", "content", "often", "name", "at", "extent"])


_LINKS = "name long, other long, lo long, hi long"


class _Extents:
    """The extents of some windows of one value, and what links them."""

    def __init__(self, names: np.ndarray, at: np.ndarray, parts: list[np.ndarray]):
        self.names, self.at, self.parts = names, at, parts
        self.order: list[np.ndarray | None] = [None] * len(parts)
        self.comp = np.arange(len(parts))
        self._sets: list[np.ndarray] | None = None
        self.links: list[tuple[int, int, int, int]] = []

    def _sorted(self, i: int) -> np.ndarray:
        if self.order[i] is None:
            self.order[i] = np.argsort(self.parts[i])
        return self.order[i]

    @property
    def sets(self) -> list[np.ndarray]:
        if self._sets is None:
            self._sets = [np.unique(x) for x in self.parts]
            # an extent without repeated shingles needs as many different ones as hits
            self.least = np.array([HITS if len(x) == len(y) else COMMON for x, y in zip(self._sets, self.parts)])
        return self._sets

    def near(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs have enough in common for a passage."""
        both = self.common(left, right)
        return both >= np.minimum(self.least[left][:, None], self.least[right][None, :])

    def promising(self, i: int, js: np.ndarray) -> np.ndarray:
        """Those of ``js`` that may share a passage with i: either's hits in the other are dense somewhere."""
        sets, x = self.sets, self.parts[i]
        out = []
        for some in np.array_split(js, max(1, len(js) // 512)):
            size = np.array([len(self.parts[j]) for j in some.tolist()])
            inside = np.arange(size.max())[None, :] < size[:, None]
            items = np.zeros(inside.shape, np.uint32)
            items[inside] = np.concatenate([self.parts[j] for j in some.tolist()])
            at = np.minimum(np.searchsorted(sets[i], items), len(sets[i]) - 1)
            good = may_be_dense((sets[i][at] == items) & inside)
            other = np.flatnonzero(~good)
            if len(other):
                theirs = [sets[j] for j in some[other].tolist()]
                key = np.repeat(np.arange(len(theirs)), [len(t) for t in theirs]).astype(np.uint64) << A.U(32) | np.concatenate(theirs)
                want = np.arange(len(theirs)).astype(np.uint64)[:, None] << A.U(32) | x[None, :]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                good[other] = may_be_dense(key[at] == want)
            out.append(some[good])
        return np.concatenate(out)

    def try_link(self, i: int, j: int) -> None:
        """Connect i and j if they share a passage."""
        if self.comp[i] == self.comp[j] or self.names[i] == self.names[j]:
            return
        x, y = self.parts[i], self.parts[j]
        got = [(a, b, c, d) for a, b, c, d in similar_ranges(x, y, self._sorted(j))] or [(c, d, a, b) for a, b, c, d in similar_ranges(y, x, self._sorted(i))]
        if got:
            self.comp[self.comp == self.comp[j]] = self.comp[i]
            p, q, s, t = self.names[i], self.names[j], self.at[i], self.at[j]
            for a, b, c, d in got:
                self.links += [(p, q, s + a, s + b + SHINGLE - 1), (q, p, t + c, t + d + SHINGLE - 1)]

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of different shingles that each of ``left`` has in common with each of ``right``."""
        sides, items = (left, right), []
        for side in sides:
            sets = [self.sets[i] for i in side.tolist()]
            items.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)))
        both = np.zeros((len(left), len(right)), np.float32)
        # what only one side has never counts
        known = np.intersect1d(items[0][1], items[1][1])
        width = 2048
        for lo in range(0, len(known), width):
            some = known[lo : lo + width]
            m = []
            for side, (owner, item) in zip(sides, items):
                at = np.minimum(np.searchsorted(some, item), len(some) - 1)
                hit = some[at] == item
                m.append(np.zeros((len(side), len(some)), np.float32))
                m[-1][owner[hit], at[hit]] = 1
            both += m[0] @ m[1].T
        return both

    def sharing(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For members of ``left``, those of ``right`` that may have COMMON different shingles in common with it.

        Shingles of more than RARE members are left out of an index. Whoever has fewer than COMMON of those has a rarer one in
        common with every partner; the others are compared among themselves.
        """
        if len(left) * len(right) <= 1 << 16:
            yield from zip(left.tolist(), (right[row] for row in self.near(left, right)))
            return
        sets = self.sets
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        frequent = np.bincount(owner[df[col] > RARE], minlength=len(sets))
        keep = (df[col] > 1) & (df[col] <= RARE)
        owner, col = owner[keep], col[keep]
        order = np.lexsort((owner, col))
        owner, col = owner[order], col[order]
        n, pairs = len(sets), []
        is_left, is_right = np.zeros(n, bool), np.zeros(n, bool)
        is_left[left], is_right[right] = True, True
        for step in range(1, RARE):
            same = col[step:] == col[:-step]
            a, b = owner[:-step][same], owner[step:][same]
            ok = (is_left[a] & is_right[b]) | (is_left[b] & is_right[a])
            pairs.append(np.unique(a[ok] * n + b[ok]))
        a, b = np.divmod(np.unique(np.concatenate(pairs)), n)
        a, b = np.where(is_left[a] & is_right[b], a, b), np.where(is_left[a] & is_right[b], b, a)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        if len(a):
            cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            yield from zip(a[cuts].tolist(), np.split(b, cuts[1:]))
        heavy = frequent >= COMMON
        left, right = left[heavy[left]], right[heavy[right]]
        for lo in range(0, len(left), 256):
            some = left[lo : lo + 256]
            yield from zip(some.tolist(), (right[row] for row in self.near(some, right)))

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Connect whatever pairs of ``left`` and ``right`` share a passage, unless they are connected by others."""
        if not len(left) or not len(right):
            return
        for i, js in self.sharing(left, right):
            js = js[(self.comp[js] != self.comp[i]) & (self.names[js] != self.names[i])]
            for j in self.promising(i, js).tolist() if len(js) else ():
                self.try_link(i, j)


def _links(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array([int(v) for v in c], pa.int64()) for c in cols], names=["name", "other", "lo", "hi"])


def aligned_runs(parts: list[np.ndarray], group: np.ndarray, hubs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per part, against the hub of its group: number of shingles that the hub has, and the longest run that stands in both alike (start in the part, start in the hub, length)."""
    hub_items = np.concatenate(hubs)
    hub_size = np.array([len(x) for x in hubs])
    hub_key = np.repeat(np.arange(len(hubs)), hub_size).astype(np.uint64) << A.U(32) | hub_items
    hub_place = np.arange(len(hub_items)) - np.repeat(np.cumsum(hub_size) - hub_size, hub_size)
    order = np.argsort(hub_key, kind="stable")
    hub_key, hub_place = hub_key[order], hub_place[order]
    size = np.array([len(x) for x in parts])
    start = np.cumsum(size) - size
    key = np.repeat(group, size).astype(np.uint64) << A.U(32) | np.concatenate(parts)
    at = np.minimum(np.searchsorted(hub_key, key), len(hub_key) - 1)
    hit = hub_key[at] == key
    place = np.where(hit, hub_place[at], -2)
    goes_on = np.zeros(len(key), bool)
    goes_on[1:] = hit[1:] & hit[:-1] & (place[1:] == place[:-1] + 1)
    goes_on[start] = False
    index = np.arange(len(key))
    run = np.where(hit, index - np.maximum.accumulate(np.where(goes_on, 0, index)) + 1, 0)
    longest = np.maximum.reduceat(run, start)
    # the first place where a part's longest run ends
    ends = np.flatnonzero(run == np.repeat(longest, size))
    end = ends[np.searchsorted(ends, start)]
    first = end - longest + 1
    return np.add.reduceat(hit.astype(np.int64), start), first - start, place[first], longest


def against_hubs(names: np.ndarray, at: np.ndarray, parts: list[np.ndarray], group: np.ndarray, hub_names: np.ndarray, hub_at: np.ndarray, hubs: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Which parts share a passage with the hub of their group (another text's), and the ranges of both."""
    linked, links = np.zeros(len(parts), bool), []
    if not len(parts):
        return linked, links
    hits, a, c, longest = aligned_runs(parts, group, hubs)
    other = (names != hub_names[group]) & (hits >= COMMON)
    for i in np.flatnonzero(other & (longest >= LEAST)).tolist():
        g, n = int(group[i]), int(longest[i])
        p, q, s, t = names[i], hub_names[g], at[i], hub_at[g]
        if len(set(parts[i][a[i] : a[i] + n].tolist())) >= COMMON:
            linked[i] = True
            links += [(p, q, s + a[i], s + a[i] + n + SHINGLE - 1), (q, p, t + c[i], t + c[i] + n + SHINGLE - 1)]
    rest = np.flatnonzero(other & ~linked)
    rest = rest[np.argsort(group[rest], kind="stable")]
    for some in np.split(rest, np.flatnonzero(np.diff(group[rest])) + 1) if len(rest) else ():
        g = int(group[some[0]])
        own = _Extents(np.concatenate([hub_names[[g]], names[some]]), np.concatenate([hub_at[[g]], at[some]]), [hubs[g], *[parts[i] for i in some.tolist()]])
        for j in own.promising(0, np.arange(1, len(some) + 1)).tolist():
            own.try_link(0, j)
            linked[some[j - 1]] = own.comp[j] == own.comp[0]
        links += own.links
    return linked, links


def _unpacked_extents(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column.to_pylist()]


def _solve(table: pa.Table) -> pa.Table:
    """All values of a bucket: each group's extents against its most frequent one, then what that did not link against the rest."""
    value, content, often, names = (table.column(c).to_numpy() for c in ("value", "content", "often", "name"))
    # of equally frequent ones the least name, so that the texts of a class meet the same text in all their windows
    order = np.lexsort((content, names, -often, value))
    value, raw = value[order], _unpacked_extents(table.column("extent"))
    parts = [raw[i] for i in order.tolist()]
    names, at = (table.column(c).to_numpy()[order] for c in ("name", "at"))
    cuts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
    size = np.diff(np.append(cuts, len(value)))
    group = np.repeat(np.arange(len(cuts)), size)
    linked, out = against_hubs(names, at, parts, group, names[cuts], at[cuts], [parts[i] for i in cuts.tolist()])
    linked[cuts] = True
    done = np.logical_and.reduceat(linked, cuts)
    for g in np.flatnonzero(~done).tolist():
        a, b = int(cuts[g]), int(cuts[g] + size[g])
        own = _Extents(names[a:b], at[a:b], parts[a:b])
        own.comp[linked[a:b]] = 0
        own.compare(np.flatnonzero(~linked[a:b]), np.arange(b - a))
        out += own.links
    return _links(out)


def _with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extents of large groups with their group's most frequent one: the links with it; a row without names for an extent without."""
    for batch in batches:
        if not batch.num_rows:
            continue
        value, content, names, at, hub_names, hub_at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("value", "content", "name", "at", "hname", "hat"))
        kinds, first, group = np.unique(value, return_index=True, return_inverse=True)
        hubs = [np.frombuffer(batch.column(batch.schema.get_field_index("hextent"))[i].as_py(), "<u4") for i in first.tolist()]
        linked, links = against_hubs(names, at, _unpacked_extents(batch.column(batch.schema.get_field_index("extent"))), group, hub_names[first], hub_at[first], hubs)
        odd = np.flatnonzero(~linked)
        rows = _links(links).combine_chunks()
        none = pa.nulls(len(odd), pa.int64())
        blank = pa.nulls(len(links), pa.int64())
        yield from pa.table([pa.concat_arrays([pa.array(value[odd]), blank]), pa.concat_arrays([pa.array(content[odd]), blank]), *[pa.concat_arrays([none, *rows.column(k).chunks]) for k in range(4)]], names=["value", "content", "name", "other", "lo", "hi"]).combine_chunks().to_batches()


def _block(table: pa.Table) -> pa.Table:
    """Links of the extents of a block that the group's most frequent one did not link, with the others."""
    odd, content, linked = (table.column(c).to_numpy(zero_copy_only=False) for c in ("as_odd", "content", "linked"))
    # an extent may be on both sides
    content, first, number = np.unique(content, return_index=True, return_inverse=True)
    raw = _unpacked_extents(table.column("extent"))
    group = _Extents(table.column("name").to_numpy()[first], table.column("at").to_numpy()[first], [raw[i] for i in first.tolist()])
    main = np.flatnonzero(linked[first])
    if len(main):
        group.comp[main] = main[0]
    group.compare(np.unique(number[odd]), np.unique(number[~odd]))
    return _links(group.links)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # pairs come sorted by one side, and many share the other: texts of a part are read once, those of the last part kept
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in (b.slice(lo, PAIRS) for b in batches for lo in range(0, b.num_rows, PAIRS)):
        out: list[tuple[int, int, int, int]] = []
        a, b, ta, tb = (part.column(part.schema.get_field_index(c)) for c in ("a", "b", "ta", "tb"))
        pairs = list(zip(a.to_pylist(), b.to_pylist()))
        where = {n: (t, i) for t, names in ((ta, a), (tb, b)) for i, n in enumerate(names.to_pylist())}
        kept = {n: x for n, x in kept.items() if n in where}
        new = [n for n in where if n not in kept]
        for n, own in zip(new, _unpacked([where[n][0][where[n][1]].as_py() for n in new])):
            kept[n] = own, np.argsort(own).astype(np.int32)
        for x, y in pairs:
            out += _both_ways(x, y, kept[x], kept[y])
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["name", "other", "lo", "hi"])


def passages(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(name, other, lo, hi): word ranges of a class of equal texts that repeat in another, enough to connect all that do; and (node, name, n_words) of the rows."""
    texts = numbered(docs)
    w = scratch.cut(texts.select("node", "text").mapInArrow(_windows, "value long, content long, name long, at long, size short"), "windows")
    # values of a single class are done. What is counted by value is a table of its own, so that a join's partition of a hot value can be split
    often = scratch.cut(w.groupBy("value").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi").select("value"), "often")
    met = scratch.cut(w.join(often, "value", "left_semi"), "meetings")
    scratch.drop(w)
    # extents by content: equal ones are linked, one of each goes on
    kinds = met.groupBy("value", "content").agg(F.min(F.struct("name", "at", "size")).alias("one"), F.max(F.struct("name", "at")).alias("last"), F.count("*").alias("often"))
    kinds = scratch.cut(kinds.select("value", "content", "one.*", F.col("last.name").alias("last"), F.col("last.at").alias("last_at"), "often"), "extents")
    end = lambda at: (F.col(at) + F.col("size") + SHINGLE - 1).alias("hi")
    same = kinds.where("name < last").select("value", "content", F.col("name").alias("other"))
    equal = met.join(same, ["value", "content"]).where("name != other").select("name", "other", F.col("at").alias("lo"), end("at"))
    equal = equal.union(kinds.where("name < last").select("name", F.col("last").alias("other"), F.col("at").alias("lo"), end("at")))
    equal = scratch.cut(equal.distinct(), "equal")
    scratch.drop(met)
    per_value = scratch.cut(kinds.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    kinds = scratch.cut(kinds.join(per_value, "value").drop("last", "last_at"), "groups")
    all_pairs = F.expr("flatten(transform(v, (x, i) -> transform(slice(v, i + 2, size(v)), y -> struct(x as a, y as b))))")
    few = kinds.where(F.col("n") <= FEW).groupBy("value").agg(F.array_sort(F.collect_set("name")).alias("v")).select(F.explode(all_pairs).alias("p")).select("p.a", "p.b").distinct()
    few = scratch.cut(few, "pairs")
    more = kinds.where(F.col("n") > FEW)
    need = few.select(F.explode(F.array("a", "b")).alias("name")).union(more.select("name")).distinct()
    named = texts.select("node", "text").mapInArrow(_named_texts, "name long, text binary")
    pool = scratch.cut(named.join(need, "name").dropDuplicates(["name"]), "pool")
    want = more.groupBy("name").agg(F.collect_list(F.struct("value", "content", "often", "at", "size")).alias("want"))
    extents = pool.join(want, "name").select("name", "text", "want").mapInArrow(_extents, "value long, content long, often long, name long, at long, extent binary")
    extents = scratch.cut(extents.join(per_value, "value"), "extents")
    middle, large = extents.where(F.col("n") <= LARGE), extents.where(F.col("n") > LARGE)
    buckets = max(1, middle.count() // TOGETHER)
    shown = middle.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(buckets))).groupBy("bucket").applyInArrow(_solve, _LINKS)
    # large groups: each extent with the most frequent one, then what that did not link with all, block against block
    hub = large.groupBy("value").agg(F.max(F.struct("often", (-F.col("name")).alias("least"), "content", "name", "at", "extent")).alias("h")).select("value", F.col("h.content").alias("hcontent"), F.col("h.name").alias("hname"), F.col("h.at").alias("hat"), F.col("h.extent").alias("hextent"))
    hubs = scratch.cut(large.join(hub, "value").where("content != hcontent").select("value", "content", "name", "at", "extent", "hname", "hat", "hextent").mapInArrow(_with_hub, "value long, content long, " + _LINKS), "hubs")
    odd = hubs.where("name is null").select("value", "content")
    left = large.join(odd.groupBy("value").agg(F.count("*").alias("n_odd")), "value").join(odd.withColumn("odd", F.lit(True)), ["value", "content"], "left")
    left = left.withColumn("linked", F.col("odd").isNull()).withColumn("ni", F.ceil(F.col("n_odd") / BLOCK).cast("int")).withColumn("nj", F.ceil(F.col("n") / BLOCK).cast("int"))
    spread = F.xxhash64("content")
    as_other = left.withColumn("j", F.pmod(spread, F.col("nj")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, ni - 1)"))).withColumn("as_odd", F.lit(False))
    as_odd = left.where("odd").withColumn("i", F.pmod(spread, F.col("ni")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, nj - 1)"))).withColumn("as_odd", F.lit(True))
    cols = ["value", "i", "j", "as_odd", "linked", "content", "name", "at", "extent"]
    rest = as_other.select(*cols).union(as_odd.select(*cols)).groupBy("value", "i", "j").applyInArrow(_block, _LINKS)
    shown = scratch.cut(shown.union(hubs.where("name is not null").drop("value", "content")).union(rest), "shown")
    pairs = few.union(shown.where("name < other").select(F.col("name").alias("a"), F.col("other").alias("b"))).distinct()
    both = pairs.join(pool.withColumnsRenamed({"name": "a", "text": "ta"}), "a").join(pool.withColumnsRenamed({"name": "b", "text": "tb"}), "b")
    found = scratch.cut(both.mapInArrow(_verify, _LINKS).union(shown).union(equal), "ranges")
    rows = scratch.cut(texts.mapInArrow(_names, "node long, name long, n_words long"), "names")
    return found, rows


def result(docs: DataFrame) -> DataFrame:
    """One row per document with a passage that another document repeats: doc_id, class_id (least doc_id reachable over
    shared passages), n_links (other texts of the class), n_copies (rows with the same words), spans (word ranges)."""
    scratch = Scratch(docs.sparkSession)
    found, rows = passages(docs, scratch)
    long = rows.where(F.col("n_words") >= WORDS)
    classes = long.groupBy("name").agg(F.min("node").alias("rep"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words"))
    classes = scratch.cut(classes, "classes")
    comp = components(found.select(F.col("name").alias("a"), F.col("other").alias("b")), scratch)
    comp = classes.join(comp.withColumnRenamed("node", "name"), "name", "left").select("name", F.coalesce("component", "name").alias("component"), "rep", "n_copies", "n_words")
    least = comp.groupBy("component").agg(F.min("rep").alias("class_node"), (F.count("*") - 1).alias("n_links"))
    spans = found.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    each = comp.join(least, "component").join(spans, "name", "left").where("n_copies > 1 or n_links > 0")
    x = long.select("node", "name").join(each, "name")
    x = with_ids(x, docs, "node", "class_node")
    merged = F.expr(
        """transform(aggregate(if(n_copies > 1, array(struct(0L as lo, n_words as hi)), spans), cast(array() as array<struct<lo: bigint, hi: bigint>>),
        (acc, s) -> if(size(acc) > 0 and s.lo <= element_at(acc, -1).hi,
            concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).lo as lo, greatest(element_at(acc, -1).hi, s.hi) as hi))), concat(acc, array(s)))), s -> concat(s.lo, ':', s.hi))"""
    )
    return scratch.done(x.select("doc_id", F.col("least_id").alias("class_id"), "n_links", "n_copies", F.array_join(merged, ",").alias("spans")))
