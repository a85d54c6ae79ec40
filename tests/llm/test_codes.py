"""Product codes against plain Python, and annuli against all distances."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from tessella.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, same int"


def brute(rows):
    kept = [(i, [math.floor(256 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 22 for x in v)]
    dim = max(16, -(-max((len(v) for _, v, _ in kept), default=0) // 16) * 16)
    kept = [(i, v + [0] * (dim - len(v)), lab) for i, v, lab in kept]
    w = dim // 16
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    ids = sorted(first)[:64]
    if not ids:
        return []
    books = [[first[i][p * w : p * w + w] for i in ids] for p in range(16)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(16):
                part = v[p * w : p * w + w]
                groups[p, near(p, part)[1]].append(part)
        for (p, k), parts in groups.items():
            books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    made, by = [], defaultdict(int)
    for i, v, lab in kept:
        found = [near(p, v[p * w : p * w + w]) for p in range(16)]
        made.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        by[lab] += made[-1][2]
    return [(i, c, e, by[lab], sha) for i, c, e, lab in made]


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(partitions)
    assert sorted(map(str, map(tuple, codes.result(df).collect()))) == sorted(map(str, brute(rows)))


def vector(rng, n=32, spread=1.0):
    return [float(np.float32(rng.gauss(0, spread))) for _ in range(n)]


@pytest.mark.parametrize("n,count", [(32, 200), (20, 90), (64, 40)])
def test_random_vectors(spark, n, count):
    rng = random.Random(n)
    check(spark, [(rng.randrange(10_000), vector(rng, n), rng.choice([None, 1, 2, 3])) for _ in range(count)])


def test_cases(spark):
    """Null, empty and broken vectors, ties, repeated rows and ids, null ids and labels, one label for most rows."""
    rng = random.Random(2)
    v = [vector(rng, 16, 0.02) for _ in range(5)]
    rows = [(i, v[i % 5], 1) for i in range(150)] + [(3, v[3], 1), (3, v[4], 2), (None, v[0], None), (None, v[1], None)]
    rows += [(-5, None, 1), (-6, [1.0, None], 1), (-7, [float("nan")], 1), (-8, [float("inf")] * 16, 2), (-9, [1e30], 2), (-10, [], 4), (-11, [0.5, -0.5], 4)]
    check(spark, rows)


def test_empty_and_without_ids(spark):
    check(spark, [])
    check(spark, [(None, [1.0, 2.0], 1)])


def test_annuli_find_what_all_distances_find():
    rng = np.random.default_rng(1)
    for spread, width in ((3, 4), (300, 4), (100_000, 2), (1, 1)):
        book, x = rng.integers(-spread, spread + 1, (64, width)), rng.integers(-spread, spread + 1, (3000, width))
        a = codes.Annuli(book)
        index, d = a.nearest(x)
        all_d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (index == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
    assert a.evaluated < 3000 * 64
