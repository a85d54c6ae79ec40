"""Shards of operator 7: the work of sorting and expansion, shards too large for packed keys, rows side by side."""

import random

import numpy as np
import pytest
from tessella.llm import suffix


class Counting:
    """numpy, counting the elements that ``repeat`` makes and ``argsort`` reads."""

    def __init__(self):
        self.made = self.read = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def repeat(self, *args):
        out = np.repeat(*args)
        self.made += len(out)
        return out

    def argsort(self, x, **kind):
        self.read += len(x)
        return np.argsort(x, **kind)


def test_expansion_follows_runs(monkeypatch):
    """Near copies: intervals are expanded by runs of the transform, and suffixes are not argsorted again at every depth."""
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(3000))
    parts = []
    for _ in range(12):
        copy = bytearray(base)
        for at in range(rng.randrange(300), 3000, 300):
            copy[at] = 33
        parts.append(np.frombuffer(bytes(copy), np.uint8))
    size = sum(map(len, parts))
    monkeypatch.setattr(suffix, "np", counted := Counting())
    part, at = suffix.repeated_starts(parts, 200)
    assert len(part) and counted.made < 4 * size and counted.read < 4 * size


@pytest.mark.parametrize("letters", [1, 3, 256])
def test_suffix_order(letters):
    rng = np.random.default_rng(letters)
    parts = [rng.integers(0, letters, n) for n in (5, 1, 30, 30, 80)]
    parts[3][:20] = parts[2][5:25]
    text = np.concatenate([np.append(p + len(parts), k) for k, p in enumerate(parts)])
    for depth in (1, 4, 30, 200):
        order = suffix.suffix_order(text, depth, len(parts)).tolist()
        cut = [text[i : i + depth].tolist() for i in order]
        assert sorted(order) == list(range(len(text))) and cut == sorted(cut)


def test_shard_of_more_than_two_million_bytes():
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 256, n).astype(np.uint8) for n in (1 << 21, 3000, 700)]
    parts[0][1000:1450] = parts[1][200:650]
    parts[2][:430] = parts[1][2000:2430]
    part, at = suffix.repeated_starts(parts, 400)
    want = [(0, i) for i in range(1000, 1051)] + [(1, i) for i in [*range(200, 251), *range(2000, 2031)]] + [(2, i) for i in range(31)]
    assert list(zip(part.tolist(), at.tolist())) == want


@pytest.mark.parametrize("beside", [1, 100, 1 << 16])
def test_contexts_of_rows_side_by_side(monkeypatch, beside):
    rng = random.Random(beside)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (60, 0, 29, 30, 31, 200, 5, 90)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(suffix, "BESIDE", beside)
    got = list(zip(*(x.tolist() for x in suffix.contexts(data, off, 30, 8))))
    alone = [suffix.contexts(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 30, 8) for t in texts]
    assert got == [(r, *c[1:]) for r, x in enumerate(alone) for c in zip(*(y.tolist() for y in x))]
    assert [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 29)] == [(r, k) for r, _, a, b, _, _ in got for k in range(a, b + 1)]
