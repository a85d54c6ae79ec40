"""The cache as a stream: reads answered as of their own time, state per link, timers.

Rows of a link wait until the watermark has passed them and are then taken in the order of their time, so the answers are
those of ``operators.state.cache_over_time`` (without sweeps, which would need the state of all links) however rows arrive within the
watermark's delay. Later rows than that are dropped by the watermark. A record that nobody reads is forgotten by a timer. State lives in the
checkpoint: a restarted query goes on where it stopped.

Links are dealt over BUCKETS keys by their hash. A key costs calls between the engine and Python at every step; a bucket pays them once for all its links,
its rows cross in frames with one text per row, and wait as texts of up to CHUNK rows. A bucket is one task's work at a time, and the rows of it that become
ready together are in that task's memory.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessella.config import Config
from tessella.tables import delete, shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = ("url", "at_us", "seq", "kind", "req_id", "text", "ignore_ttl")
_OUT = "req_id string, url string, at_us long, outcome string, fetched_us long, text string"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
WRITE, READ = 0, 1
#: Rows of a frame, and of a text that waits.
CHUNK = 10_000
#: Keys of the state; a checkpoint holds for the number that it began with.
BUCKETS = 4096


class LinkCache(StatefulProcessor):
    """The links of one bucket: the record of each, and the rows that wait for the watermark."""

    def __init__(self, ttl_us: int, durable: bool, forget_us: int | None):
        self.ttl_us, self.durable, self.forget_us = ttl_us, durable, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "url string", "at_us long, text string, gone boolean")
        self.waiting = handle.getListState("waiting", "first_us long, rows string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = []
        for new in rows:
            first.append(int(new["at_us"].min()))
            self.waiting.appendValue((first[-1], f"[{','.join(new['row'])}]"))
        # one timer for the first of them: it takes all that the watermark has passed, and sets the next one
        self.handle.registerTimer(_timer(min(first)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        ready = self._ready(now)
        known = self.records.exists()
        out: list[tuple] = []
        for url, rows in groupby(ready, lambda r: r[0]):
            had = self.records.getValue((url,)) if known else None
            had = had and tuple(had)
            record = self._answer(rows, had, out)
            if record != had:
                self.records.updateValue((url,), record)
        if self.forget_us is not None and (known or ready):
            due = [(_timer(r[0] + self.ttl_us + self.forget_us), url) for (url,), r in list(self.records.iterator())]
            for _, url in (x for x in due if x[0] <= now):
                self.records.removeKey((url,))
            if left := [at for at, _ in due if at > now]:
                self.handle.registerTimer(min(left))
        return (pd.DataFrame(out[lo : lo + CHUNK], columns=_COLUMNS, dtype=object) for lo in range(0, len(out), CHUNK))

    def _ready(self, now: int) -> list[tuple]:
        """The rows that the watermark has passed, by link and in order; the others go on waiting, with a timer for the first."""
        ready, later, whole = [], [], []
        for first, text in self.waiting.get() if self.waiting.exists() else ():
            if _timer(first) > now:
                whole.append((first, text))
                continue
            for row in json.loads(text):
                (ready if _timer(row["at_us"]) <= now else later).append(tuple(map(row.get, _EVENT)))
        if ready:
            for lo in range(0, len(later), CHUNK):
                part = later[lo : lo + CHUNK]
                whole.append((min(r[1] for r in part), json.dumps([dict(zip(_EVENT, r)) for r in part])))
            self.waiting.clear()
            if whole:
                self.waiting.put(whole)
                self.handle.registerTimer(_timer(min(first for first, _ in whole)))
        return sorted(ready, key=lambda r: r[:4])

    def _answer(self, rows: Iterator[tuple], record: tuple | None, out: list[tuple]) -> tuple | None:
        """One link's rows in order, their answers added to ``out``: its record after them."""
        for url, at, _, kind, req_id, text, ignore in rows:
            if kind == WRITE:
                record = (at, text, False)
                continue
            stale = record is not None and at - record[0] >= self.ttl_us
            if record is None or record[1] is None:
                answer = ("none", None, None)
            elif record[2]:
                answer = ("gone", None, None)
            elif stale and not ignore:
                answer = ("expired", record[0], None) if self.durable else ("stale", None, None)
                record = (record[0], record[1], self.durable)
            else:
                answer = ("hit", record[0], record[1])
            out.append((req_id, url, at, *answer))
        return record

    def close(self) -> None:
        pass


def _timer(us: int) -> int:
    """The first millisecond at or after a time: a timer never fires before the watermark has passed all of it."""
    return -(-us // 1000)


def answered(events: DataFrame, delay: str, ttl_hours: float = Config.cache_ttl_hours, durable: bool = True, forget_hours: float | None = None) -> DataFrame:
    """A stream of req_id, url, at, outcome, fetched_at and text for the reads among ``events``.

    ``events`` is a stream of (url, at, seq, kind, req_id, text, ignore_ttl), kind being WRITE or READ; rows without url or time are dropped. ``delay`` is how
    late a row may come. ``forget_hours`` after a record's expiry its state goes (None: never).
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at: Column = F.col("at").cast("timestamp")
    at_us = F.unix_micros(at).alias("at_us")
    row = F.struct("url", at_us, F.col("seq").cast("long").alias("seq"), F.col("kind").cast("int").alias("kind"), F.col("req_id").cast("string").alias("req_id"), "text", F.coalesce("ignore_ttl", F.lit(False)).alias("ignore_ttl"))
    x = events.where("url is not null and at is not null").select(F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).alias("bucket"), at.alias("at"), at_us, F.to_json(row).alias("row"))
    hour = 3_600_000_000
    processor = LinkCache(int(ttl_hours * hour), durable, None if forget_hours is None else int(forget_hours * hour))
    out = x.withWatermark("at", delay).groupBy("bucket").transformWithStateInPandas(processor, _OUT, "append", "eventTime")
    return out.select("req_id", "url", F.timestamp_micros("at_us").alias("at"), "outcome", F.timestamp_micros("fetched_us").alias("fetched_at"), "text")


def ended(stream: DataFrame) -> DataFrame:
    """Run a stream over what its source holds now, and read back what it gave. Its checkpoint is deleted."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    delete(spark, f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
