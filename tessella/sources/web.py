"""Pages by their links: fetched in lanes per host at a bounded rate, retried as a browser, read as text in the JVM.

Requests are rows, so links are dealt by Spark and never pass through the driver (the partitions of a custom source would be listed there).
All links of a host in one lane go to one task in turn; a host has ``lanes`` of them, each at its share of the host's rate, so a host
with most of the links is split and its rate still holds. Links of many hosts alternate within a task. A link is fetched once
however many requests name it; what was fetched is written before anything reads it.

Cases: a host that is not allowed is refused and not fetched; a failed call is repeated as a browser, and its first error is told if that fails as well; a status outside 200 to 299 and
a page without text are errors; a verification page is fetched once more as a browser, and stays if that gives no better text; a null link is refused.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import html as H
from tessella.providers import Fetcher, FetchError
from tessella.sources import resolve as R
from tessella.tables import Scratch

#: Agents of a call: the service first, a browser if it fails or is answered by a verification page.
SERVICE, BROWSER = "service", "browser"
#: What is said of failures.
FAILED, STATUS, EMPTY = "网页抓取失败：", ("网页返回状态码 ", "，抓取失败"), "网页内容为空或无法解析（可能是临时链接失效、文章已删除，或需要登录）。请换稳定链接，或直接粘贴正文。"
#: Bytes of pages that a task holds before it passes them on.
HELD = 8 << 20
_FETCHED = "url string, status int, kind string, body string, agent string, calls int, failure string"


class Pacer:
    """Waits until ``seconds`` lie between two calls of one host."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.next = seconds, clock, sleep, {}

    def wait(self, host: str) -> None:
        if self.seconds:
            now = self.clock()
            due = max(now, self.next.get(host, now))
            if due > now:
                self.sleep(due - now)
            self.next[host] = due + self.seconds


def call(fetcher: Fetcher, pacer: Pacer, url: str, host: str, agents: tuple[str, ...], recorded: str | None) -> tuple:
    """The first answer of ``agents`` in turn: status, kind, body, agent, calls, failure."""
    failure = None
    for i, agent in enumerate(agents):
        pacer.wait(host)
        try:
            return (*fetcher.fetch(url, agent, recorded), agent, i + 1, None)
        except FetchError as e:
            failure = failure or str(e)
    return None, None, None, None, len(agents), failure


def _stage(links: DataFrame, fetcher: Fetcher, agents: tuple[str, ...], per_second: float, lanes: int, tasks: int) -> DataFrame:
    """One row per link of ``links`` (url, recorded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pacer = Pacer(lanes / per_second if per_second else 0.0)
        schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("kind", pa.string()), ("body", pa.string()), ("agent", pa.string()), ("calls", pa.int32()), ("failure", pa.string())])
        rows, held = [], 0
        for batch in batches:
            for url, host, recorded in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows.append((url, *call(fetcher, pacer, url, host, agents, recorded)))
                held += len(rows[-1][3] or "")
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    own = links.select("url", R.host(F.col("url")).alias("host"), "recorded", F.pmod(F.xxhash64("url"), F.lit(lanes)).alias("lane"))
    # a fixed number of tasks: small pages do not make a slow host's tasks worth merging
    return own.repartition(tasks, "host", "lane").sortWithinPartitions(F.xxhash64(F.lit(1), "url")).select("url", "host", "recorded").mapInArrow(run, _FETCHED)


def fetch_pages(requests: DataFrame, fetcher: Fetcher, allowed: Callable[[Column], Column] = R.allowed, per_second: float = 0.0, lanes: int = 4, tasks: int | None = None, folder: str | None = None) -> DataFrame:
    """Columns of ``requests`` (url and, for a replay, recorded) with status, agent, calls, retried, title, text and error.

    ``per_second`` bounds the calls to a host (0: no bound).
    """
    spark = requests.sparkSession
    scratch = Scratch(spark, folder)
    tasks = tasks or max(spark.sparkContext.defaultParallelism, 4) * 4
    own = requests if "recorded" in requests.columns else requests.withColumn("recorded", F.lit(None).cast("string"))
    good = F.coalesce(allowed(F.col("url")), F.lit(False))
    links = own.where(good).groupBy("url").agg(F.max("recorded").alias("recorded"))
    first = scratch.cut(_stage(links, fetcher, (SERVICE, BROWSER), per_second, lanes, tasks), "pages")
    fine = F.col("failure").isNull() & F.col("status").between(200, 299)
    html = F.col("kind") == "html"
    read = first.select(
        "url", "status", "agent", "calls", "failure", fine.alias("fine"), F.when(fine & html, H.title(F.col("body"))).otherwise(F.lit("")).alias("title"),
        F.when(fine & html, H.body_text(F.col("body"))).when(fine & (F.col("kind") == "text"), F.col("body")).otherwise(F.lit("")).alias("text"),
    )
    read = scratch.cut(read.withColumn("blocked", R.antibot(F.col("text"))), "texts")
    again = _stage(read.where("blocked").select("url").join(links, "url"), fetcher, (BROWSER,), per_second, lanes, tasks)
    better = again.where("failure is null").select("url", H.title(F.col("body")).alias("new_title"), H.body_text(F.col("body")).alias("new_text"))
    better = better.where((T.or_else(F.col("new_text")) != "") & ~F.col("new_text").rlike(R.ANTIBOT)).withColumn("taken", F.lit(True))
    both = read.join(scratch.cut(better, "retried"), "url", "left")
    title = F.when(F.col("taken") & (F.col("new_title") != ""), F.col("new_title")).otherwise(F.col("title"))
    text = F.coalesce("new_text", "text")
    blank = T.or_else(F.col("text")) == ""
    error = (
        F.when(F.col("failure").isNotNull(), F.concat(F.lit(FAILED), "failure"))
        .when(~F.col("fine"), F.concat(F.lit(STATUS[0]), F.col("status").cast("string"), F.lit(STATUS[1])))
        .when(blank, F.lit(EMPTY))
    )
    done = both.select(
        "url", "status", F.when(F.col("taken"), F.lit(BROWSER)).otherwise(F.col("agent")).alias("agent"), (F.col("calls") + F.col("blocked").cast("int")).alias("calls"),
        "blocked", F.when(error.isNull(), title).alias("title"), F.when(error.isNull(), R.with_title(title, text)).alias("text"), error.alias("error"),
    ).withColumnRenamed("blocked", "retried")
    keep = [c for c in requests.columns if c != "recorded"]
    fetched = requests.where(good).select(*keep).join(done, "url").select(*keep, *done.columns[1:])
    refused = requests.where(~good).select(*keep, F.lit("host not allowed").alias("error"))
    return scratch.done(fetched.unionByName(refused, allowMissingColumns=True), "fetched")
