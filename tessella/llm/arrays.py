"""Vectorised text work on Arrow batches: UTF-8 bytes, words and hashes as numpy arrays, no Python strings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 1 << 20

#: Separators of words: space and the five controls from tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), so that every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants from a fixed seed, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * BASE + U(seed * 0x9E37 + 0x1234567)) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i from 0 to n."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, base in (("p", BASE), ("i", inverse)):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


@dataclass
class Slice:
    """Some rows of a batch: ``data`` holds their texts' bytes, ``offsets[i]:offsets[i+1]`` those of row lo + i."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a batch into runs of rows of at most ``most`` bytes of text (a longer text stands alone); null is empty."""
    array = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    n = len(array)
    if not n:
        return
    _, off, data = array.buffers()
    off = np.frombuffer(off, np.int64, n + 1 + array.offset)[array.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    valid = ~np.asarray(array.is_null().to_numpy(zero_copy_only=False), bool)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], valid[lo:hi])
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per row the number of the first word of it (one more at the end)."""
    inside = ~SEPARATOR[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = inside[first]
    last = first[1:] - 1
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE**i, from which any span's polynomial hash follows by a difference."""
    p, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within rows, and per row where its run begins (one more at the end).

    A row with 1 to size - 1 words has one run: the whole row. A row without words has none.
    """
    n_words = np.diff(first)
    p, _ = powers(len(words) + size)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    width = np.repeat(np.minimum(n_words, size), counts)
    sums = np.zeros(len(words) + 1, U)
    _, inverse = powers(len(words) + size)
    np.cumsum(words * p[: len(words)], out=sums[1:])
    h = (sums[at + width] - sums[at]) * inverse[at]
    return mix(h + width.astype(U)), begin
