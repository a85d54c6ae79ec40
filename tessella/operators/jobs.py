"""Background jobs: work under a Spark job tag with its outcome, lines and counts, and the same as tables."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text as T

#: Outcomes, the reason of a cancellation without one, and the beginnings of last lines.
COMPLETED, KILLED, FAILED, CANCELLED = "completed", "killed", "failed", "已取消"
REPORT, CANCEL_LINE, FAIL_LINE = "【最终报告】\n", "已取消：", "后台精读失败："


def outcome(error: Column, cancelled: Column, reason: Column) -> Column:
    """Status and detail of a job: without an error completed, whenever it was cancelled; with one killed if it was cancelled, else failed."""
    why = F.when(F.coalesce(reason, F.lit("")) != "", reason).otherwise(F.lit(CANCELLED))
    status = F.when(error.isNull(), F.lit(COMPLETED)).when(F.coalesce(cancelled, F.lit(False)), F.lit(KILLED)).otherwise(F.lit(FAILED))
    return F.struct(status.alias("status"), F.when(status == KILLED, why).when(status == FAILED, error).alias("detail"))


def last_line(o: Column, report: Column) -> Column:
    """What a job says in the end: its report, why it was cancelled, or why it failed."""
    return F.when(o["status"] == COMPLETED, F.concat(F.lit(REPORT), report)).when(o["status"] == KILLED, F.concat(F.lit(CANCEL_LINE), o["detail"])).otherwise(F.concat(F.lit(FAIL_LINE), o["detail"]))


def resolved_line(label: Column, chars: Column, extract_ms: Column) -> Column:
    """What a job says first if its source was read before it began."""
    parsed = F.when(extract_ms > 0, F.concat(F.lit("，PDF 解析 "), T.number(extract_ms.cast("double")), F.lit("ms"))).otherwise(F.lit(""))
    return F.concat(F.lit("已解析「"), label, F.lit("」（"), chars.cast("string"), F.lit(" 字"), parsed, F.lit("）"))


def drained(log: DataFrame, job: str, seq: str, line: str) -> DataFrame:
    """job, seq, output of every reading (a row without a line): the lines since the reading before it, blank ones left out."""
    own = Window.partitionBy(job).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    x = log.select(job, seq, F.col(line).alias("line")).withColumn("turn", F.coalesce(F.sum(F.col("line").isNull().cast("long")).over(own), F.lit(0)))
    said = F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct(seq, "line"))))
    g = x.groupBy(job, "turn").agg(said.alias("said"), F.max(F.when(F.col("line").isNull(), F.col(seq))).alias(seq)).where(F.col(seq).isNotNull())
    return g.select(job, seq, F.array_join(F.transform("said", lambda s: s["line"]), "\n").alias("output"))


class Cancelled(Exception):
    """Raised by ``check`` of a job that was cancelled."""


class Job:
    """Work in a thread of its own, all of whose Spark jobs carry a tag: cancelling it ends them, and Spark's status store tells what they came to.

    ``work`` gets the job, may ``say`` lines and ``check`` for a cancellation between its steps, and returns the report.
    """

    def __init__(self, spark: SparkSession, label: str, work: Callable[[Job], str]):
        self.spark, self.label, self.work, self.tag = spark, label, work, f"tessella-{uuid.uuid4().hex}"
        self.error: str | None = None
        self.report, self.reason, self.killed, self.lines, self._said = "", "", False, [], 0
        self._over, self._lock = threading.Event(), threading.Lock()

    def start(self) -> Job:
        InheritableThread(target=self._run, daemon=True).start()
        return self

    def _run(self) -> None:
        sc = self.spark.sparkContext
        sc.addJobTag(self.tag)
        try:
            self.report = self.work(self)
        except Exception as e:
            self.error = reason_of(e)
        finally:
            sc.removeJobTag(self.tag)
            o = self.outcome()
            self.say(REPORT + self.report if o[0] == COMPLETED else (CANCEL_LINE if o[0] == KILLED else FAIL_LINE) + (o[1] or ""))
            self._over.set()

    def say(self, line: str) -> None:
        if line:
            with self._lock:
                self.lines.append(line)

    def check(self) -> None:
        if self.killed:
            raise Cancelled(self.reason)

    def cancel(self, reason: str = "") -> None:
        """End the job's running Spark jobs, and any that it starts before it has seen that it is cancelled."""
        self.reason, self.killed = reason or CANCELLED, True

        def end() -> None:
            while not self._over.wait(0.2):
                self.spark.sparkContext.cancelJobsWithTag(self.tag)

        threading.Thread(target=end, daemon=True).start()

    def wait(self, seconds: float | None = None) -> Job:
        if not self._over.wait(seconds):
            raise TimeoutError(f"{self.label} still runs after {seconds} s")
        return self

    def output(self) -> str:
        """The lines since the last call."""
        with self._lock:
            out, self._said = self.lines[self._said :], len(self.lines)
        return "\n".join(out)

    def outcome(self) -> tuple[str, str | None]:
        """Status and detail, by the rules of ``outcome`` on columns."""
        if self.error is None:
            return COMPLETED, None
        return (KILLED, self.reason) if self.killed else (FAILED, self.error)

    def counts(self) -> dict[str, int]:
        """Spark jobs under the tag by how they ended, and their tasks, as far as Spark's status store still holds them."""
        tracker, out = self.spark.sparkContext._jsc.sc().statusTracker(), {"succeeded": 0, "failed": 0, "running": 0, "tasks": 0}
        for i in tracker.getJobIdsForTag(self.tag):
            job = tracker.getJobInfo(i)
            if job.isDefined():
                status = job.get().status().toString().lower()
                out[status] = out.get(status, 0) + 1
                for s in job.get().stageIds():
                    stage = tracker.getStageInfo(s)
                    out["tasks"] += stage.get().numCompletedTasks() if stage.isDefined() else 0
        return out


def reason_of(e: Exception) -> str:
    """What an error says, without Spark's stack: the message that user code raised, if it did."""
    said = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?) SQLSTATE", str(e), re.S)
    return said[1] if said else str(e).split("\n")[0]


def log(spark: SparkSession, jobs: list[Job]) -> DataFrame:
    """label, status, detail, seq and line of every line of some ended jobs, and their Spark jobs that succeeded or failed."""
    rows = []
    for j in jobs:
        status, detail = j.outcome()
        c = j.counts()
        rows += [(j.label, status, detail, i, line, c["succeeded"], c["failed"]) for i, line in enumerate(j.lines, 1)]
    return spark.createDataFrame(rows, "label string, status string, detail string, seq long, line string, succeeded long, failed long")
