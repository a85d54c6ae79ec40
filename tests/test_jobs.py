"""Jobs under a Spark tag: completed, failed and cancelled; streamed answers; progress by real parts."""

import json
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessella.config import Config
from tessella.operators import analyze as A
from tessella.operators import jobs as J
from tessella.operators import route as G
from tessella.providers import FixtureProvider, ModelError, PiecewiseProvider
from tessella.tables import Scratch

DDL = "req_id long, text string"


def test_outcomes_come_from_sparks_own_jobs(spark):
    def fine(job):
        job.say("one")
        job.say("")
        n = spark.range(10).repartition(3).count()
        job.say("two")
        return f"{n} rows"

    def broken(job):
        spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("three is bad"))).otherwise("x")).collect()

    a, b = J.Job(spark, "fine", fine).start().wait(60), J.Job(spark, "broken", broken).start().wait(60)
    assert a.outcome() == ("completed", None) and a.output() == "one\ntwo\n【最终报告】\n10 rows" and a.output() == ""
    assert b.outcome() == ("failed", "three is bad") and b.lines == ["后台精读失败：three is bad"]
    assert a.counts()["succeeded"] >= 1 and a.counts()["failed"] == 0 and a.counts()["tasks"] >= 3 and b.counts()["failed"] == 1
    told = J.log(spark, [a, b]).collect()
    assert [(r.label, r.status, r.seq) for r in told] == [("fine", "completed", 1), ("fine", "completed", 2), ("fine", "completed", 3), ("broken", "failed", 1)]


def test_a_cancelled_job_ends_at_once(spark):
    """Its running stage is ended; a step that it would start later is not begun."""
    steps = []

    def work(job):
        steps.append("stage")
        try:
            spark.range(4).repartition(4).mapInArrow(lambda bs: (time.sleep(600) or b for b in bs), "id long").count()
        finally:
            steps.append("ended")
        steps.append("never")

    job = J.Job(spark, "slow", work).start()
    while not job.counts()["running"]:
        time.sleep(0.05)
    began = time.monotonic()
    job.cancel()
    job.wait(30)
    assert time.monotonic() - began < 20 and steps == ["stage", "ended"]
    assert job.outcome() == ("killed", "已取消") and job.lines[-1] == "已取消：已取消" and job.counts()["failed"] >= 1

    def polite(job):
        while True:
            job.check()
            time.sleep(0.02)

    other = J.Job(spark, "polite", polite).start()
    other.cancel("enough")
    assert other.wait(10).outcome() == ("killed", "enough")


def test_a_job_that_was_done_before_its_cancellation_is_completed(spark):
    job = J.Job(spark, "quick", lambda j: "done").start().wait(10)
    job.cancel("late")
    assert job.outcome() == ("completed", None)


def test_pieces_are_joined():
    p = PiecewiseProvider(FixtureProvider(answer=lambda s, u: json.dumps({"title": "é" * 50})), size=7)
    assert json.loads(A.whole(p, "s", "u", 10)) == {"title": "é" * 50}
    assert A.call_json(p, A._parses, "s", "u", 10)["attempts"] == 1
    with pytest.raises(ModelError, match="no answer within 0.02 s"):
        A.whole(PiecewiseProvider(p, 5, 0.03), "s", "u", 10, 0.02)
    got = A.call_json(PiecewiseProvider(p, 7, most=2), A._parses, "s", "u", 10)
    assert got["answer"] is None and got["error"].count("the stream broke off") == 3


def test_streamed_readings_equal_whole_ones(spark):
    docs = spark.createDataFrame([(1, "One thing. Another. " * 30), (2, "Long part. " * 1500)], DDL)
    whole, pieces = ({r.req_id: (r.r, r.error, r.chapters) for r in A.deep(docs, p).collect()} for p in (FixtureProvider(), PiecewiseProvider(FixtureProvider(), 33)))
    assert whole == pieces


def test_a_cancelled_stage_says_so_in_its_rows(spark):
    docs = spark.createDataFrame([(i, f"Text {i}. More of it.") for i in range(6)], DDL).repartition(3)
    held = {}

    def work(job):
        held["rows"] = A.quick(docs, PiecewiseProvider(FixtureProvider(), 1, 60.0)).collect()
        job.check()
        return ""

    job = J.Job(spark, "reading", work).start()
    while not job.counts()["running"]:
        time.sleep(0.05)
    job.cancel("stop")
    for _ in range(600):
        if "rows" in held or job.error:
            break
        time.sleep(0.05)
    job.wait(30)
    assert job.outcome() == ("killed", "stop")


def test_a_cancelled_stage_gives_every_prompt_a_row(spark, monkeypatch):
    prompts = spark.createDataFrame([(i, "s", f"u{i}", 10) for i in range(4)], "req_id long, system string, user string, budget int")

    class Ended(Exception):
        pass

    def fail(self, df, name="table"):
        raise Ended("[SPARK_JOB_CANCELLED] Job 3 cancelled part of cancelled job tags x")

    monkeypatch.setattr(Scratch, "cut", fail)
    got = A.call_stage(prompts, FixtureProvider(), ["req_id"], Scratch(spark)).collect()
    assert sorted((r.req_id, r.v, r.attempts, r.error) for r in got) == [(i, None, 0, A.CANCELLED) for i in range(4)]
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name="table": (_ for _ in ()).throw(Ended("disk full")))
    with pytest.raises(Ended):
        A.call_stage(prompts, FixtureProvider(), ["req_id"], Scratch(spark))


def test_a_stage_is_observed_and_its_tables_deleted(spark, tmp_path):
    import os

    docs = spark.createDataFrame([(1, "good " * 100 + "bad " * 100 + "good " * 100), (2, "Fine text."), (3, " ")], DDL)
    seen, scratch = Observation("parts"), Scratch(spark, str(tmp_path))
    p = FixtureProvider(answer=lambda s, u: "{}", script={"bad bad": ["!down"]})
    parts = A.sections(docs, p, Config(chunk_chars=300), scratch=scratch, seen=seen)
    n = parts.where("index is not null").count()
    bad = parts.where("error is not null and index is not null").count()
    assert seen.get["finished"] == n == 6 and seen.get["failed"] == bad > 0 and seen.get["attempts"] == n + 2 * bad
    lines = {k: [r.line for r in sorted(rows, key=lambda r: r.seq)] for k, rows in _by(G.section_lines(parts, "req_id").collect()).items()}
    first = min(r["index"] for r in parts.where("error is not null and index is not null").collect())
    assert lines[1][-1] == f"精读第 {first}/5 段…" and len(lines[1]) == 2 * first - 1
    assert lines[2] == ["精读第 1/1 段…", "完成第 1/1 段", "汇总中…"] and 3 not in lines
    assert any(f.startswith("answers-") for f in os.listdir(tmp_path))
    scratch.drop(*scratch.paths.values())
    assert not any(f.startswith("answers-") for f in os.listdir(tmp_path))


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.req_id, []).append(r)
    return out


def test_job_runs_ends_with_more_partitions_than_cores(spark, tmp_path, monkeypatch):
    """The job that waits takes all cores, so the others are over before it begins, however their threads are scheduled."""
    from tessella.plans import reports

    spark.createDataFrame([(i, f"One {i}. Two.") for i in range(48)], "doc_id long, text string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    begun, start = [], J.Job.start

    def watched(self):
        begun.append((self.label, [j.label for j in jobs if not j._over.is_set()]))
        jobs.append(self)
        return start(self)

    jobs = []
    monkeypatch.setattr(J.Job, "start", watched)
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        rows = reports.job_runs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert begun[-1] == ("endless", [])
    assert {(r.label, r.status) for r in rows} == {("chunks", "completed"), ("broken", "failed"), ("endless", "killed")}
    assert {r.line for r in rows} >= {"【最终报告】\n48 chunks", "后台精读失败：cannot read document 47", "已取消：not needed"}
