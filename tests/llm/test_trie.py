"""The trie of conversations against one built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tessella.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, k1 string, depth int, top string"


def brute(rows, share=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if share else 0
        made[c] = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def order(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def same(spark, rows, partitions=3, share=True):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(partitions)
    made = trie.nodes(df, share).drop("k1", "k2") if not share else trie.result(df)
    assert sorted(map(tuple, made.collect()), key=order) == sorted(brute(rows, share), key=order)


def random_rows(seed, convs=260, words=3, turns=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if words > 3 else "user", " ".join("ab"[rng.randrange(2)] * rng.randrange(1, words) for _ in range(2))))
    return rows


@pytest.mark.parametrize("seed,words", [(1, 2), (2, 3), (3, 9)])
def test_random_conversations(spark, seed, words):
    same(spark, random_rows(seed, words=words))


def test_without_sharing(spark):
    same(spark, random_rows(5, words=2), share=False)


def test_cases(spark):
    """Null roles, texts, turns and ids, repeated rows and turns, texts of more than one UTF-16 unit a character, turnless results, negative ids."""
    rows = [(100, None, None, None), (100, 0, "user", "é😀"), (100, 1, "user", None), (101, 0, "user", "x"), (101, 0, "user", "x"), (None, 0, "user", "lost"), (7, 3, "a", "b"), (7, 1, "ab", ""), (8, 1, "a", "b")]
    rows += [(c, 0, "user", "once") for c in range(200, 240)] + [(-150, 0, "u", "n"), (-150, 1, "u", "m"), (-100, 0, "u", "base"), (-100, 1, "u", "base two")]
    same(spark, rows)


def test_one_conversation_has_most_rows(spark, monkeypatch):
    """Longer than a chunk, over several parts; its copies share all nodes."""
    monkeypatch.setattr(trie, "CHUNK", 16)
    rng = random.Random(9)
    long = [(c, t, "user", f"turn {t}") for c in (100, 103, 104) for t in range(300 - c % 5)]
    rows = long + [(101, 5, "user", "same")] * 60 + [r for r in random_rows(4, 120, 2) if not 100 <= r[0] < 105]
    rng.shuffle(rows)
    same(spark, rows, 5)


def test_chain_of_light_nodes(spark):
    """Halving groups: as many levels as a conversation can have."""
    rows = [(c, t, "u", str(c >> (6 - t))) for c in range(64) for t in range(7)]
    same(spark, rows, share=False)


def test_empty(spark):
    assert trie.result(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.result(spark.createDataFrame([("1", "0", "u", "a"), ("x", "0", "u", "b")], "conv_id string, turn string, role string, text string")).count() in (1, 2)
