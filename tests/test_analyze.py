import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.config import Config
from tessella.operators import analyze as A
from tessella.providers import CORRECTION, FixtureProvider, pick_model

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module
DDL = "req_id long, text string"
SMALL = Config(chunk_chars=400)


def section(title):
    return json.dumps({"title": title, "thesis": "t", "arguments": [{"claim": f"c{i}"} for i in range(12)], "structure": ["a", " ", "b"], "citations": [{"claim": "x", "source": "第3页"}]})


def test_budgets_grow_and_stop():
    assert [A.next_budget(2500), A.next_budget(3750)] == [3750, 5625]
    assert A.next_budget(12000) == 16000


def test_pick_model():
    assert pick_model(("a", "b"), {}) == ("a", "b")
    assert pick_model(None, {"p": ["m1", "m2"]}) == ("p", "m1")
    with pytest.raises(ValueError):
        pick_model(None, {})


@pytest.mark.parametrize(
    "answers,attempts,budget",
    [(["{}"], 1, 100), (["no", "{}"], 2, 150), (["[broken]", "{}"], 2, 100), (["!rate limit", '{"a": 1'[:-1], "{}"], 3, 225), (['```json\n{"a": 1,}\n```'], 1, 100)],
)
def test_attempts(answers, attempts, budget):
    got = A.call_json(FixtureProvider(script={"text": answers}), A._parses, "s", "text", 100)
    assert (got["attempts"], got["budget"], got["error"]) == (attempts, budget, None)


def test_every_reason_is_kept():
    got = A.call_json(FixtureProvider(script={"text": ["!upstream rate limit exceeded", '{"cut": ', "} prose }"]}), A._parses, "s", "text", 100)
    assert got["answer"] is None and "upstream rate limit exceeded" in got["error"] and "cut off" in got["error"] and "not JSON" in got["error"] and got["error"].endswith("} prose }")
    assert CORRECTION


def test_short_texts_take_one_call_long_ones_a_call_per_part(spark):
    docs = spark.createDataFrame([(1, "short text."), (2, "字" * 10000), (3, None), (4, " ")], DDL)
    got = {r.req_id: r for r in A.deep(docs, FixtureProvider(answer=lambda s, u: section(u[:20]))).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert all(got[i].error == A.NOTHING and got[i].r is None for i in (3, 4))
    assert got[1].chapters == [] and len(got[2].chapters) == 2
    assert got[2].chapters[0].title.startswith("【第 1 / 2 部分】") and len(got[2].r.arguments) == 10
    assert got[2].structure == ["a", "b"] and got[1].citations[0].source == "第3页"


def test_failed_parts_fail_their_document_only(spark):
    docs = spark.createDataFrame([(1, "bad " * 3000), (2, "good " * 3000)], DDL)
    got = {r.req_id: r for r in A.deep(docs, FixtureProvider(answer=lambda s, u: section("x"), script={"bad bad": ["!down"]})).collect()}
    assert "down" in got[1].error and got[1].r is None
    assert got[2].error is None and got[2].r.title == "x"


def test_book_always_goes_by_parts(spark):
    docs = spark.createDataFrame([(1, "A sentence. " * 100)], DDL)
    r = A.deep(docs, FixtureProvider(), SMALL, book=True).first()
    assert r.kind == "book" and len(r.chapters) == 4 and r.error is None


def test_quick_map_feynman(spark):
    docs = spark.createDataFrame([(1, "One thing. Another thing. " * 20), (2, "Long part. " * 1000)], DDL)
    p = FixtureProvider()
    assert {r.req_id: r.r.title for r in A.quick(docs, p).collect()} == {1: "One thing", 2: "Long part"}
    maps = {r.req_id: r.m for r in A.knowledge_map(docs, p).collect()}
    assert maps[1]["items"][0].type == "事实" and maps[1]["items"][0].evidence == "原文未提供证据" and maps[2].thesis
    f = {r.req_id: r for r in A.feynman(docs, p).collect()}
    assert f[1].toc == [] and f[2].toc and len(f[2].chapters) == 2 and f[2].review_plan[0].interval == "第1天"
    assert f[1].title and f[1].error is None


def test_batch_compares_ten_documents(spark):
    docs = spark.createDataFrame([(b, i, f"Text {i}. Two. ") for b in (1, 2) for i in range(1, 13)], "batch_id long, item long, text string")
    got = {r.batch_id: r for r in A.batch(docs, FixtureProvider()).collect()}
    assert set(got) == {1, 2} and got[1]["items"] == 10 and got[1].comparison[0].positions and got[1].error is None


def test_blank_texts_are_rows_with_an_error(spark):
    docs = spark.createDataFrame([(1, "short text."), (2, None), (3, " \n ")], DDL)
    provider = FixtureProvider()
    for f in (A.quick, A.sections, A.deep, lambda r, p: A.deep(r, p, book=True), A.knowledge_map, A.feynman):
        got = f(docs, provider).collect()
        assert sorted(r.req_id for r in got) == [1, 2, 3]
        assert {r.req_id: r.error for r in got} == {1: None, 2: A.NOTHING, 3: A.NOTHING}
    b = spark.createDataFrame([(1, 1, "a b."), (2, 1, " "), (2, 2, "c d.")], "batch_id long, item long, text string")
    assert {r.batch_id: r.error for r in A.batch(b, provider).collect()} == {1: None, 2: A.NOTHING}


def test_every_rule_of_a_prompt_is_said(spark):
    """Counts, lengths and labels that answers are held to, for each kind of call."""
    from pyspark.sql import functions as F

    from tessella.operators import prompts as P

    want = {
        "section": ["第N部分", "one or two sentences", "【第N页】", "Close reading"], "final": ["3 to 8 most important supporting claims", "3 to 8 most important claims", "keep it in citations"],
        "map": ["at most 100 characters", "1 to 3 conclusions", *P.TYPES, *P.CONFIDENCE, *P.RELATION_TYPES, "原文未提供证据", "never invented data", "5 questions", "tabs", "no cause"],
        "structure": ["3 to 6"], "chapter": ["child of twelve", "原文未提供证据", "mindmap"], "feynman": [*P.INTERVALS, "mindmap"], "batch": ["3 to 6", "2 to 4 sentences", "1 to 3", "real ones only"],
    }
    for kind, said in want.items():
        assert [x for x in said if x not in P.head(kind)] == [], kind
    assert "at most 3 arguments, 3 quotes, 4 concepts and 3 questions" in P.head("section", True)
    df = spark.createDataFrame([("zh", " tea "), ("xx", " "), (None, None)], "lang string, focus string")
    got = [r[0].split("\n") for r in df.select(P.system_prompt("section", F.col("lang"), F.col("focus"))).collect()]
    assert got[0][-2:] == ["Language: 简体中文.", "The reader cares about: tea."] and got[1][-1] == got[2][-1] == "Language: the language of the text."
    assert "cares" not in df.select(P.system_prompt("final", F.col("lang"), F.col("focus"))).first()[0]


def test_parts_are_made_without_a_join(spark):
    """Language and focus travel with the chunks; texts are not shuffled to meet them."""
    docs = spark.createDataFrame([(1, "One. " * 3000), (2, " ")], "req_id long, text string")
    seen = []

    class Kept(A.Scratch):
        def cut(self, df, name="table"):
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
            return super().cut(df, name)

    A.sections(docs, FixtureProvider(), scratch=Kept(spark))
    assert len(seen) == 1 and "Join" not in seen[0]


def test_quick_trims_equal_the_plain_one(spark):
    rows = [(t,) for t in (None, "", " ", "　a", "a\n", "﻿a b﻿", "a​", "\x85é", "中 ", " \U0001f600", "\x1c")]
    t = F.col("t")
    x = spark.createDataFrame(rows, "t string")
    assert x.where(~T.trim(t).eqNullSafe(T.trim_of(t)) | ((T.or_else(t) == "") != T.blank(t))).count() == 0


def test_answers_of_one_file_are_sanitised_on_all_cores(spark, tmp_path):
    from tessella.plans import records

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert records._one(spark, tmp_path).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_an_article_is_read_to_its_end(spark, tmp_path):
    """Texts of more than 20 parts and of more than 400,000 characters: every part has its call, values reach the next one uncut, rows equal the SQL."""
    import duckdb

    from tessella.plans import readings

    sentence = "A sentence of the text goes on and on to some hundred characters, so that parts end behind one of these. "
    docs = [(0, sentence * 1500 + "Its end."), (1, sentence * 4000 + "Its end."), (2, sentence * 100), (3, "Short. Text."), (4, " ")]
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(folder))
    found = readings.deep_pipeline(spark, str(tmp_path))
    rows = found.collect()
    chapters = {r.req_id: r.n_chapters for r in rows}
    assert 20 < chapters[0] < 30 and chapters[1] > 60 and chapters[2] < 20 and chapters[3] == 0
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    want = con.execute(f"select {', '.join(found.columns)} from ({readings.ORACLE_SQL['deep_pipeline']})").fetchall()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))

    def told(system, user):
        if not user.startswith("全文共") and "合并为一个部分" not in user:
            return json.dumps({"title": "end" if "Its end" in user else "part", "summary": "s" * 5000, "thesis": "t"})
        parts = json.loads(user.split("\n\n", 1)[1])
        ends = sum(p["title"] == "end" or "end" in p.get("titles", []) for p in parts)
        return json.dumps({"title": f"{len(parts)} read, {ends} of them the end", "summary": "s" * min(len(p["summary"]) for p in parts)})

    x = spark.createDataFrame(docs[:2], DDL)
    got = {r.req_id: r for r in A.deep(x, FixtureProvider(answer=told)).collect()}
    assert {k: (r.error, r.r.title) for k, r in got.items()} == {0: (None, "2 read, 1 of them the end"), 1: (None, "4 read, 1 of them the end")}
    assert all(len(r.r.summary) == 5000 for r in got.values())
