"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A window of words is read by a random walk (Chakraborty, Goldenberg, Koucky): step j writes the word it stands on and
moves on if a random bit of (j, word) says so. Windows at a small edit distance give outputs at a small Hamming
distance. Each repetition has its own walk and samples SAMPLES output positions; equal samples are a hit, and
several hits near one place (for items under FEW_WORDS words a single one) a candidate. Windows
of item size are covered by the starts of all walks in the texts against walks from every word of every item, so one
stretch with few edits anywhere in an item is enough. Candidates are confirmed by exact edit distances of the item to
the best place in the text around it (Myers' bit vectors). The rule is stated in words, the letters of the embedding: a text
holds an item if at most MOST_EDITS of the item's words are inserted, deleted or replaced; or, for typing errors, at most
MOST_TYPOS of its words and MOST_EDITS of its characters.

Repetitions follow from the target recall: with one word in ten edited a walk keeps its samples with probability about
0.25 somewhere in an item of sixteen words, so ceil(log(1 - recall) / log(1 - 0.25)) are made. Tests measure the recall over
all pairs that the rule accepts, by kind of edit and length of item.

Texts are scanned once per block of items; a block holds at most BLOCK_WORDS words of items, which bounds what is sent
to the executors and what the driver holds; each block's matches are written before the next block is read. Walks whose first samples
no item has are dropped at once, so nearly all words cost two look-ups.

Cases: null texts match nothing; items of fewer than LEAST_WORDS words match only the same words, items of none nothing; repeated rows
and repeated items are reported each once per (row key, item_id), at the place of fewest edits, of equal ones the first; a very long text is
one row of a task, with arrays of about 100 times its bytes; empty tables give an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.store import Scratch, own_columns, row_key, spare_names

RECALL, SAMPLES, MOST_EDITS, MOST_TYPOS, LEAST_WORDS, BLOCK_WORDS = 0.95, 5, 0.2, 0.4, 4, 400_000
#: Starts with a hit near one place that make a candidate: a leaked item of many words has one at most of them, of items
#: under FEW_WORDS words a single one is enough.
MIN_HITS, FEW_WORDS = 2, 20
#: Steps of the walks; an item uses the longest walk whose three quarters it has as words.
WALKS = (16, 8, 4)
_SPACE = re.compile(r"[\x20\x09-\x0d]+")


def repetitions(recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - 0.25))


def plain(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in _SPACE.sub(" ", text).strip(" "))


def sampled_steps(steps: int, repetition: int) -> list[int]:
    """The first step and SAMPLES - 1 others in order."""
    rng = np.random.default_rng(1000 * steps + repetition)
    return [0, *sorted(rng.choice(np.arange(1, steps), min(SAMPLES, steps) - 1, replace=False).tolist())]


def walk_keys(words: np.ndarray, last: np.ndarray, at: np.ndarray, steps: int, repetition: int, tables: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Start positions (of ``at``) that survive and the keys of their samples.

    ``last``: per start the first position behind its text (words from there on read as 0).
    ``tables``: per sample the bit table of keys that items have; a start whose key so far is in none is dropped.
    """
    odd = A.seeds(steps, 77 + 13 * repetition + steps)
    wanted = sampled_steps(steps, repetition)
    here, key = at.copy(), np.full(len(at), A.U(repetition + 1), np.uint64)
    n = 0
    for j in range(wanted[-1] + 1):
        word = np.where(here < last, words[np.minimum(here, len(words) - 1)], A.U(0))
        if j == wanted[n]:
            key = A.mix(key * A.BASE + word)
            if tables is not None:
                stay = tables[n][(key >> A.U(44)).astype(np.int64)]
                at, here, last, key, word = at[stay], here[stay], last[stay], key[stay], word[stay]
                if not len(at):
                    break
            n += 1
        here = here + ((word * odd[j]) >> A.U(63)).astype(np.int64)
    return at, key


def _slack(item: str) -> int:
    """Words by which an item's place may shift by edits before a hit."""
    return 2 + (item.count(" ") + 1) // 4


class Index:
    """Walk keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], recall: float):
        self.items = [(i, plain(t)) for i, t in items]
        self.groups = []
        self.slack = np.array([_slack(t) for _, t in self.items], np.int64)
        self.least_hits = np.array([1 if t.count(" ") + 1 < FEW_WORDS else MIN_HITS for _, t in self.items], np.int64)
        data = [t.encode() for _, t in self.items]
        off = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
        joined = np.frombuffer(b"".join(data), np.uint8)
        starts, ends, first = A.word_bounds(joined, off)
        words = A.span_hashes(A.prefix_sums(joined), starts, ends)
        n_words = np.diff(first)
        self.words = [words[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
        owner = np.repeat(np.arange(len(data)), n_words)
        place = np.arange(len(words)) - first[owner]
        #: Per number of words under LEAST_WORDS: keys of the items, sorted, and whose they are.
        self.short = []
        for n in range(1, LEAST_WORDS):
            mine = np.flatnonzero(n_words == n)
            if len(mine):
                keys = _run_keys(words, first[mine], n)
                order = np.argsort(keys, kind="stable")
                self.short.append((n, keys[order], mine[order]))
        for k, steps in enumerate(WALKS):
            n = n_words[owner]
            most = WALKS[k - 1] * 3 // 4 if k else 1 << 60
            mine = np.flatnonzero((n >= max(LEAST_WORDS, steps * 3 // 4)) & (n < most))
            for r in range(repetitions(recall)) if len(mine) else ():
                # only walks that stay inside their item: a text goes on where an item ends
                ends_at = _prefix_keys(words, mine, steps, r, len(sampled_steps(steps, r)))[1]
                ok = mine[ends_at < first[owner[mine] + 1]]
                if not len(ok):
                    continue
                tables, full = [], None
                for m in range(1, len(sampled_steps(steps, r)) + 1):
                    full = _prefix_keys(words, ok, steps, r, m)[0]
                    t = np.zeros(1 << 20, bool)
                    t[(full >> A.U(44)).astype(np.int64)] = True
                    tables.append(t)
                order = np.argsort(full, kind="stable")
                self.groups.append((steps, r, tables, full[order], owner[ok][order], place[ok][order]))

    def candidates(self, words: np.ndarray, row: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Rows (text, item number, word position where the item would begin) with hits from enough starts close to one place."""
        hits = [np.zeros((0, 4), np.int64)]
        for steps, r, tables, keys, owner, place in self.groups:
            at, key = walk_keys(words, last, np.arange(len(words)), steps, r, tables)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            n = hi - lo
            hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            hits.append(np.stack([row[np.repeat(at, n)], owner[hit], np.repeat(at, n) - place[hit], np.repeat(at, n)], 1))
        # repetitions that hit at one start say the same: starts are counted
        for size, keys, owner in self.short:
            at = np.flatnonzero(np.arange(len(words)) + size <= last)
            key = _run_keys(words, at, size)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            n = hi - lo
            hit = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            hits.append(np.stack([row[at], owner[hit], at, at], 1))
        all_ = np.unique(np.concatenate(hits), axis=0)
        if not len(all_):
            return all_[:, :3]
        # cells as wide as a search's slack, on two grids: hits of one place fill a cell of one of them
        wide = self.slack[all_[:, 1]]
        good = np.zeros(len(all_), bool)
        for shift in (0, 1):
            cell = np.stack([all_[:, 0], all_[:, 1], (all_[:, 2] + shift * (wide // 2)) // wide], 1)
            _, which, count = np.unique(cell, axis=0, return_inverse=True, return_counts=True)
            good |= count[which.ravel()] >= self.least_hits[all_[:, 1]]
        return np.unique(all_[good, :3], axis=0)


def _run_keys(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n words from each start."""
    key = np.full(len(at), A.U(n), np.uint64)
    for j in range(n):
        key = A.mix(key * A.BASE + words[at + j])
    return key


def _prefix_keys(words: np.ndarray, at: np.ndarray, steps: int, r: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first m samples, and where the walks stand at the last of them."""
    odd, wanted = A.seeds(steps, 77 + 13 * r + steps), sampled_steps(steps, r)[:m]
    here, key = at.copy(), np.full(len(at), A.U(r + 1), np.uint64)
    for j in range(wanted[-1] + 1):
        word = words[np.minimum(here, len(words) - 1)]
        if j in wanted:
            key = A.mix(key * A.BASE + word)
        if j == wanted[-1]:
            break
        here = here + ((word * odd[j]) >> A.U(63)).astype(np.int64)
    return key, here


def best_place(pattern: Sequence, text: Sequence) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text`` (characters or words), and the end of the first such place."""
    m = len(pattern)
    peq: dict = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _matches(index: Index, s: A.Slice) -> Iterator[tuple[int, int, int, int, int]]:
    """Row of the slice, item number, distance, and the word range looked at, for every confirmed pair."""
    data = A.LOWER[s.data]
    starts, ends, first = A.word_bounds(data, s.offsets)
    if not len(starts):
        return
    words = A.span_hashes(A.prefix_sums(data), starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = index.candidates(words, row, first[row + 1])
    done: dict[tuple[int, int], int] = {}
    for i, item, begin in found.tolist():
        _, pattern = index.items[item]
        n = pattern.count(" ") + 1
        # one look covers all starts nearby: candidates of one place lie next to each other
        if begin < done.get((i, item), -(1 << 60)):
            continue
        slack = int(index.slack[item]) if n >= LEAST_WORDS else 0
        lo, hi = max(int(first[i]), begin - slack), min(int(first[i + 1]), begin + n + 2 * slack)
        if lo >= hi:
            continue
        done[(i, item)] = begin + max(1, slack // 2)
        edited, _ = best_place(index.words[item], words[lo:hi].tolist())
        if edited > (MOST_TYPOS * n if n >= LEAST_WORDS else 0):
            continue
        text = plain(data[starts[lo] : ends[hi - 1]].tobytes().decode("utf-8", "replace"))
        best, _ = best_place(pattern, text)
        if edited <= MOST_EDITS * n or best <= MOST_EDITS * len(pattern):
            yield i, item, best, int(starts[lo] - s.offsets[i]), int(ends[hi - 1] - s.offsets[i])


def leaks(docs: DataFrame, benchmark: DataFrame, recall: float = RECALL, scratch: Scratch | None = None) -> DataFrame:
    """k1, k2, doc_id, item_id, edits, item_chars, from_byte, to_byte: each text with each item that it holds, once."""
    items = own_columns(benchmark, "item_id", "text").where("text is not null").select("item_id", "text", F.size(F.split("text", r"[\x20\x09-\x0d]+")).alias("n"))
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    d = own_columns(docs, "doc_id", "text")
    kind, ikind = d.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"k1 long, k2 long, doc_id {kind}, item_id {ikind}, edits int, item_chars int, from_byte long, to_byte long"
    keyed = d.select(*row_key(), "doc_id", "text")
    out, scratch = None, scratch or Scratch(docs.sparkSession)
    for b in range(blocks):
        own = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()]
        hits = keyed.mapInArrow(_scanner(own, recall), schema)
        # of several blocks each is written, so that only one block's items are held at a time
        hits = scratch.cut(hits, "hits") if blocks > 1 else hits
        out = hits if out is None else out.union(hits)
    best = out.groupBy("k1", "k2", "doc_id", "item_id").agg(F.min(F.struct("edits", "item_chars", "from_byte", "to_byte")).alias("m"))
    return best.select("k1", "k2", "doc_id", "item_id", "m.*")


def _scanner(items: list[tuple[int, str]], recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items, recall)
        for batch in batches:
            for s in A.slices(batch) if index.groups or index.short else ():
                got = list(_matches(index, s))
                if got:
                    take = pa.array([s.lo + g[0] for g in got], pa.int32())
                    ids = pa.array([index.items[g[1]][0] for g in got])
                    yield pa.record_batch(
                        [batch.column(c).take(take) for c in range(3)] + [ids, pa.array([g[2] for g in got], pa.int32()), pa.array([len(index.items[g[1]][1]) for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())],
                        names=["k1", "k2", "doc_id", "item_id", "edits", "item_chars", "from_byte", "to_byte"],
                    )

    return run


def result(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession)
    out = leaks(docs, benchmark, scratch=scratch).select("doc_id", "item_id", "edits", "item_chars", "from_byte", "to_byte")
    return scratch.done(out, "leaks") if scratch.paths else out


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that hold no item. They hang on a small table of keys, which is in ``scratch`` to be dropped once they are written."""
    k1, k2 = spare_names(docs, "k1", "k2")
    own, scratch = Scratch(docs.sparkSession), scratch or Scratch(docs.sparkSession)
    bad = leaks(docs, benchmark, scratch=own).select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    key = row_key()
    bad = scratch.cut(bad, "leaks")
    own.drop(*own.paths.values())
    return docs.withColumns({k1: key[0], k2: key[1]}).join(bad, [k1, k2], "left_anti").drop(k1, k2)
