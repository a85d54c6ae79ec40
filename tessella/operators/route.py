"""Where a request runs, what its job is called, and what it reports on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.config import BATCH_ITEMS, Config
from tessella.functions import text as T


def route(requests: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds route and reason from estimate, batch_size, depth, source_kind, chars (of the text or extrapolated) and has_jobs."""
    jobs = F.coalesce("has_jobs", F.lit(True))
    long = F.col("chars") > config.background_min_chars
    reason = (
        F.when(F.coalesce("estimate", F.lit(False)), "estimate").when(F.coalesce("batch_size", F.lit(0)) >= 2, "batch").when(F.col("depth") == "quick", "quick")
        .when(long & (F.col("source_kind") == "pdf"), "long pdf").when(long, "long").otherwise("short")
    )
    x = requests.withColumn("reason", reason)
    return x.withColumn("route", F.when(jobs & F.col("reason").isin("batch", "long pdf", "long"), "background").otherwise("foreground"))


def job_label(source: Column, parts: Column, minutes: Column, product: str = "精读") -> Column:
    """Fixed format: what is read, in how many parts, and the expected minutes if they are known."""
    budget = F.when(minutes.isNotNull(), F.concat(F.lit(" · 预算≈"), T.number(minutes), F.lit("分钟"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{product}「"), source, F.lit("」· "), parts.cast("string"), F.lit(" 段"), budget)


def job_parts(depth: Column, chunks: Column | None, chars: Column, config: Config = Config()) -> Column:
    """One for quick, else the chunks of the text, or their expected number from its length."""
    n = F.ceil(chars.cast("double") / config.chunk_chars) if chunks is None else chunks
    return F.when(depth == "quick", F.lit(1).cast("long")).otherwise(F.greatest(F.lit(1), F.least(n, F.lit(config.max_parts))).cast("long"))


def progress_lines(jobs: DataFrame, key: str) -> DataFrame:
    """Lines of each job of ``parts`` parts in order: start and end of every part, then the summary of several."""
    i, n = F.col("i").cast("string"), F.col("parts").cast("string")
    x = jobs.where("parts > 0").select(key, "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts").cast("long"))).alias("i"))
    both = F.array(F.struct((F.col("i") * 2 - 1).alias("seq"), F.concat(F.lit("精读第 "), i, F.lit("/"), n, F.lit(" 段…")).alias("line")), F.struct((F.col("i") * 2).alias("seq"), F.concat(F.lit("完成第 "), i, F.lit("/"), n, F.lit(" 段")).alias("line")))
    each = x.select(key, F.explode(both).alias("l")).select(key, "l.*")
    end = jobs.where("parts > 0").select(key, (F.col("parts") * 2 + 1).cast("long").alias("seq"), F.lit("汇总中…").alias("line"))
    return each.union(end)


def section_lines(parts: DataFrame, key: str) -> DataFrame:
    """Lines of readings by their parts (key, index, total, error): each part's beginning and end, in order, and the summing up once all are there.

    A reading stops at its first part that failed: that one has begun and not ended, and nothing follows.
    """
    x = parts.where("index is not null")
    bad = x.where("error is not null").groupBy(key).agg(F.min("index").alias("bad"))
    y = x.join(bad, key, "left").where(F.col("bad").isNull() | (F.col("index") <= F.col("bad")))
    i, n = F.col("index").cast("string"), F.col("total").cast("string")
    begun = F.struct((F.col("index") * 2 - 1).cast("long").alias("seq"), F.concat(F.lit("精读第 "), i, F.lit("/"), n, F.lit(" 段…")).alias("line"))
    ended = F.when(~F.coalesce(F.col("index") == F.col("bad"), F.lit(False)), F.struct((F.col("index") * 2).cast("long").alias("seq"), F.concat(F.lit("完成第 "), i, F.lit("/"), n, F.lit(" 段")).alias("line")))
    last = F.when((F.col("index") == F.col("total")) & F.col("bad").isNull(), F.struct((F.col("index") * 2 + 1).cast("long").alias("seq"), F.lit("汇总中…").alias("line")))
    return y.select(key, F.explode(F.array_compact(F.array(begun, ended, last))).alias("l")).select(key, "l.*")


def pdf_progress(jobs: DataFrame, key: str, step: int = 5) -> DataFrame:
    """Lines while a PDF of ``pages`` pages is read: the first, then whenever ``step`` per cent more are done, and the last.

    A page reports if its percentage is ``step`` above the last one reported: a fold over pages, bounded by 100 / step lines.
    """
    pages = F.col("pages").cast("int")
    pct = lambda i: F.floor(i.cast("double") / F.greatest(F.lit(1), pages) * 100 + 0.5).cast("int")
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<page: int, pct: int>>").alias("out"))

    def one(s: Column, i: Column) -> Column:
        say = (i >= pages) | (pct(i) >= s["last"] + step)
        return F.when(say, F.struct(pct(i).alias("last"), F.concat(s["out"], F.array(F.struct(i.alias("page"), pct(i).alias("pct")))).alias("out"))).otherwise(s)

    said = F.aggregate(F.sequence(F.lit(1), pages), start, one)["out"]
    x = jobs.where("pages > 0").select(key, "pages", F.explode(said).alias("l")).select(key, "pages", "l.*")
    line = F.concat(F.lit("解析 PDF 中… "), F.col("pct").cast("string"), F.lit("%（"), F.col("page").cast("string"), F.lit("/"), F.col("pages").cast("string"), F.lit(" 页）"))
    return x.select(key, "page", line.alias("line"))


def batch_label(items: Column) -> Column:
    return F.concat(items.cast("string"), F.lit(" 篇文档"))


def batch_items(items: Column) -> Column:
    """The documents of a batch that are read."""
    return F.slice(items, 1, BATCH_ITEMS)
