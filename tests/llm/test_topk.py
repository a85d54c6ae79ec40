"""Exact top-k search against all inner products."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from tessella.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score int"


def brute(rows, k=20):
    kept = sorted({(i, tuple(math.floor(64 * float(x)) for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(64 * x) < 1 << 22 for x in v)})
    out = defaultdict(list)
    for i, v in kept:
        if i % 20 == 0:
            out[i] += [(-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i]
    return sorted((i, n + 1, j, -s) for i, found in out.items() for n, (s, j) in enumerate(sorted(found)[:k]))


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(partitions)
    assert sorted(map(tuple, topk.result(df).collect())) == brute(rows)


def unit(rng, n=24, centre=None, spread=0.1):
    v = rng.normal(0, 1, n) if centre is None else centre + rng.normal(0, spread, n)
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    check(spark, [(i, unit(rng)) for i in range(500)])


def test_clusters_over_many_blocks(spark, monkeypatch):
    """Far clusters: whole blocks are passed over, and nothing is lost."""
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "GROUP", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (12, 24))
    check(spark, [(i, unit(rng, 24, centres[i % 12])) for i in range(900)])


def test_lengths_differ_widely(spark, monkeypatch):
    """Inner products, not angles: long vectors win."""
    monkeypatch.setattr(topk, "BLOCK", 50)
    rng = np.random.default_rng(3)
    check(spark, [(i, (np.array(unit(rng, 8)) * float(rng.choice([0.1, 1, 30]))).tolist()) for i in range(400)])


def test_cases(spark, monkeypatch):
    """Nulls, broken components, repeated rows and ids, one vector for most rows (ties by id), short vectors, negative ids."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(4)
    same = unit(rng, 16)
    rows = [(i, same) for i in range(200)] + [(i, unit(rng, 16)) for i in range(200, 300)]
    rows += [rows[0], rows[0], rows[7], (20, unit(rng, 16)), (40, None), (60, [1.0, None]), (-20, [float("nan")]), (-40, [float("inf")]), (-60, [1e30] * 16), (None, same), (-80, [0.5]), (-100, []), (-120, [0.0] * 16)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])], [(20, [1.0]), (40, [2.0]), (3, [-1.0])], [(0, []), (1, [])]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_bounds_exclude_rows_of_far_clusters():
    """The search evaluates what it must: pruning is seen in the rows that bounds leave."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (8, 32)) * 3
    x = np.floor(64 * np.array([centres[i % 8] + rng.normal(0, 0.05, 32) for i in range(800)])).astype(np.int64)
    space = topk.Space(x[:200], int((x * x).sum(1).max()), 1)
    block = object.__new__(topk.Pack)
    block.ids, block.x, block.d = np.arange(800), x.astype(np.int32), space.distances(x, space.lift(x)).astype(np.float32)
    asked = block.queries(space)
    q, j, s = topk.search(space, asked, block, np.full(len(asked.ids), -np.inf), 20)
    score = asked.x.astype(np.int64) @ x.T
    for n in range(len(asked.ids)):
        want = sorted((-score[n, i], i) for i in range(800) if i != asked.ids[n])[:20]
        assert [(-b, a) for a, b in zip(j[q == n], s[q == n])] == want
    # a floor from elsewhere that no row reaches ends the search at the block
    high = np.full(len(asked.ids), float(score.max() + 10_000))
    assert not len(topk.search(space, asked, block, high, 20)[0])
