"""Trees of condensations over many parts, and what relations of map items lead to."""

import json
import random
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessella.config import Config
from tessella.operators import analyze as A
from tessella.operators import sanitize as S
from tessella.providers import FixtureProvider

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
#: What a call may read: FAN parts of two texts and three arguments of four, their names, and all titles (eight characters and three marks each).
LIMIT = A.FAN * (A.CLIP_TITLE + 14 * A.CLIP + 300) + 900 * 11


def long_text(n):
    """n paragraphs, each a part of its own, the k-th with its number."""
    return "\n\n".join(f"part{k:04d} " + "x" * 90 + "." for k in range(n))


def echo(system, user):
    """A part's number is its title; long values everywhere else. The last call tells which titles it saw, and no call may be larger than LIMIT."""
    if len(user) > LIMIT:
        return "too large"
    seen = sorted(set(re.findall(r"part\d{4}", user)))
    big = "y" * 5000
    if user.startswith("全文共"):
        listed = json.loads(user.split("\n\n", 1)[1])
        return json.dumps({"title": f"{len(seen)} titles in {len(listed)} parts", "thesis": ",".join(seen)})
    return json.dumps({"title": seen[0], "summary": big, "thesis": big, "arguments": [{"claim": big, "evidence": big, "quote": big, "source": big}] * 4})


def test_every_title_reaches_the_last_call(spark):
    """900 parts: two rounds of twenty neighbours at a time, three parts in the last call, no call beyond its size."""
    config = Config(chunk_chars=100, max_parts=8000)
    docs = spark.createDataFrame([(1, long_text(900)), (2, long_text(25)), (3, long_text(7)), (4, " ")], "req_id long, text string")
    got = {r.req_id: r for r in A.deep(docs, FixtureProvider(answer=echo), config, book=True).collect()}
    assert {k: r.error for k, r in got.items()} == {1: None, 2: None, 3: None, 4: A.NOTHING}
    assert got[1].r.title == "900 titles in 3 parts" and got[2].r.title == "25 titles in 2 parts" and got[3].r.title == "7 titles in 7 parts"
    assert got[1].r.thesis == ",".join(f"part{k:04d}" for k in range(900)) and len(got[1].chapters) == 900


def test_a_failed_call_of_the_tree_is_its_documents_error(spark):
    docs = spark.createDataFrame([(1, long_text(30)), (2, long_text(41).replace("part", "good"))], "req_id long, text string")
    p = FixtureProvider(answer=lambda s, u: json.dumps({"title": re.findall(r"(?:part|good)\d{4}", u)[0]}), script={"个部分已提取的要点，请合并为一个部分：\n\n[{\"title\":\"part": ["!down"]})
    got = {r.req_id: r for r in A.deep(docs, p, Config(chunk_chars=100, max_parts=60), book=True).collect()}
    assert "down" in got[1].error and got[1].r is None and got[2].error is None and got[2].r.title == "good0000"


def graph(claims):
    """By hand: (claim, type, [(to, type)]) to what each reaches."""
    direct = []
    for i, (_, _, rel) in enumerate(claims):
        direct.append([next((j for j, (c, _, _) in enumerate(claims) if j != i and c.startswith(to)), None) for to, _ in rel])
    out = []
    for i in range(len(claims)):
        seen, todo = set(), [j for j in direct[i] if j is not None]
        while todo:
            j = todo.pop()
            if j not in seen:
                seen.add(j)
                todo += [k for k in direct[j] if k is not None]
        out.append((direct[i], [to for (to, _), j in zip(claims[i][2], direct[i]) if j is None], i in seen, [claims[j][0] for j in sorted(seen) if claims[j][1] == "核心结论" and j != i], [j for j in sorted(seen) if all(k is None for k in direct[j])]))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_relations_lead_where_a_walk_does(spark, n):
    rng = random.Random(n)
    claims = [(f"{chr(97 + i % 26)}{i} says", rng.choice(["核心结论", "事实"]), []) for i in range(n)]
    for _, _, rel in claims:
        for _ in range(rng.choice([0, 0, 1, 2])):
            rel.append((rng.choice(claims)[0][: rng.choice([1, 2, 9])] if rng.random() < 0.9 else "nowhere", "支持"))
    df = spark.createDataFrame([(1, claims), (2, [])], "id int, items array<struct<claim: string, type: string, relations: array<struct<to: string, type: string>>>>")
    got = {r.id: r.g for r in df.select("id", S.relation_graph(F.col("items"), "核心结论").alias("g")).collect()}
    assert got[2] == []
    assert [([t["index"] for t in g.targets], g.unresolved, g.cyclic, g.conclusions, g.ends) for g in got[1]] == graph(claims)
    assert [(g["index"], g.claim) for g in got[1]] == [(i, c[0]) for i, c in enumerate(claims)]


def test_relations_of_a_sanitised_map(spark):
    raw = json.dumps({"items": [{"type": "核心结论", "claim": "tea helps"}, {"type": "事实", "claim": "cups were counted", "relations": [{"to": "tea", "type": "支持"}, {"to": "milk"}, {"to": ""}]}, {"claim": ""}, {"type": "案例", "claim": "one cup", "relations": [{"to": "cups"}]}]})
    m = spark.createDataFrame([(raw,)], "raw string").select(S.knowledge_map(F.parse_json("raw")).alias("m"))
    g = m.select(S.relation_graph(F.col("m.items"), "核心结论").alias("g")).first().g
    assert [(x.claim, x.conclusions, x.unresolved, x.ends) for x in g] == [("tea helps", [], [], []), ("cups were counted", ["tea helps"], ["milk"], [0]), ("one cup", ["tea helps"], [], [0])]
