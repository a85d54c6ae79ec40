"""Keyed state as tables: a document cache with expiry and a cap, speed calibration, and a list of recent reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.config import CACHE_ENTRIES, HISTORY_ENTRIES, HISTORY_SHOWN, Config
from tessella.functions import text as T
from tessella.tables import Scratch, carried, in_order

#: Weights of the moving average, bounds of a latency, and what replaces one that is not positive.
OLD, NEW, LATENCY_LOW, LATENCY_HIGH, LATENCY_DEFAULT = 0.8, 0.2, 50.0, 5000.0, 800.0
#: Kinds of a recent read; any other drops the record.
HISTORY_KINDS = ("article", "book", "map", "feynman", "batch")
#: The latest calls of a part that a moving average folds one by one; what lies before them in it is one weighted sum.
EXACT = 128


def stale(fetched_at: Column, now: Column, ttl_hours: float = Config.cache_ttl_hours) -> Column:
    """True for a time that cannot be read, and from exactly ``ttl_hours`` on."""
    at = F.try_to_timestamp(fetched_at)
    age = F.unix_micros(now) - F.unix_micros(at)
    return at.isNull() | (age >= F.lit(int(ttl_hours * 3_600_000_000)))


def cache_read(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = Config.cache_ttl_hours, ignore_ttl: bool = False) -> DataFrame:
    """Requests (url) with text and fetched_at of a usable record, else nulls. Records without url, text or time are misses."""
    good = cache.where("url is not null and text is not null and fetched_at is not null")
    if not ignore_ttl:
        good = good.where(~stale(F.col("fetched_at"), now, ttl_hours))
    return requests.join(good.select("url", "text", "fetched_at"), "url", "left")


def cache_write(cache: DataFrame, writes: DataFrame, now: Column, ttl_hours: float = Config.cache_ttl_hours, most: int = CACHE_ENTRIES) -> DataFrame:
    """The cache after ``writes`` (url, text, fetched_at, seq): last writer wins, stale records go, then the oldest beyond ``most``.

    The last write of a url is a grouped maximum (combined before the shuffle); the cap is a top-k, never a full sort.
    """
    all_ = cache.select("url", "text", "fetched_at", F.lit(-1).cast("long").alias("seq")).unionByName(writes.select("url", "text", "fetched_at", F.col("seq").cast("long")))
    last = all_.groupBy("url").agg(F.max(F.struct("seq", "text", "fetched_at")).alias("m")).select("url", "m.text", "m.fetched_at")
    return last.where(~stale(F.col("fetched_at"), now, ttl_hours)).orderBy(F.desc("fetched_at"), F.desc("url")).limit(most)


def cache_over_time(writes: DataFrame, reads: DataFrame, ttl_hours: float = Config.cache_ttl_hours, durable: bool = True, sweep: bool = True, folder: str | None = None) -> DataFrame:
    """Every read (req_id, url, at, seq, ignore_ttl) against the cache as it was at its own time: outcome, text, fetched_at.

    ``writes`` are (url, text, at, seq); of one time, rows go by seq, writes first. Outcomes: hit; expired, for the read that finds a stale record and
    deletes it; gone, if a record was deleted before (by an earlier read of it or, with ``sweep``, by any write, which takes all stale ones along); none, without a
    record. A read that ignores the expiry gets a stale record unless it is gone, and never deletes. Without ``durable`` (the
    store is down, records are kept in memory) nothing is ever deleted. A record without a text is none. The cap on records is that of ``cache_write``.

    An as-of join without pairs: the latest write of a link and the latest read that may have deleted its record are running values along (url, at),
    the latest write at all one along time, all carried from part to part; texts are joined to hits only.
    """
    scratch = Scratch(writes.sparkSession, folder)
    kind = F.lit(0).alias("kind")
    none = F.lit(None)
    w = writes.select("url", "at", F.col("seq").cast("long").alias("seq"), kind, none.cast(dict(reads.dtypes)["req_id"]).alias("req_id"), F.lit(False).alias("ignore_ttl"), F.col("text").isNotNull().alias("real"))
    r = reads.select("url", "at", F.col("seq").cast("long").alias("seq"), F.lit(1).alias("kind"), "req_id", F.coalesce("ignore_ttl", F.lit(False)).alias("ignore_ttl"), none.cast("boolean").alias("real"))
    x = w.unionByName(r).where("at is not null")
    write = F.col("kind") == 0
    sweep = durable and sweep
    if sweep:
        time = ["at", "seq", "kind", "url"]
        x = carried(in_order(x, time, scratch, "time"), [], time, {"swept": F.when(write, F.col("at"))}, {"swept": "max"}).drop("_part")
    order = ["url", "at", "seq", "kind"]
    values = {"record": F.when(write, F.struct(F.col("at").alias("at"), F.col("seq").alias("seq"), F.col("real").alias("real"))), "looked": F.when(~write & ~F.col("ignore_ttl"), F.col("at"))}
    x = carried(in_order(x, order, scratch, "links"), ["url"], order, values, {"record": "last", "looked": "last"}, inclusive=False)
    ttl = F.lit(int(ttl_hours * 3_600_000_000))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    due = micros("record.at") + ttl
    stale_now = micros("at") >= due
    looked = F.coalesce(micros("looked") >= due, F.lit(False)) if durable else F.lit(False)
    gone = looked | F.coalesce(micros("swept") >= due, F.lit(False)) if sweep else looked
    outcome = (
        F.when(~F.coalesce("record.real", F.lit(False)), "none").when(gone, "gone")
        .when(stale_now & ~F.col("ignore_ttl"), "expired" if durable else "stale").otherwise("hit")
    )
    told = scratch.cut(x.where(~write).select("req_id", "url", "at", outcome.alias("outcome"), F.col("record.at").alias("fetched_at"), F.col("record.seq").alias("w_seq")), "told")
    texts = writes.select(F.col("url").alias("w_url"), F.col("at").alias("w_at"), F.col("seq").cast("long").alias("seq"), "text")
    hits = told.where("outcome = 'hit'").join(texts, (F.col("url") == F.col("w_url")) & (F.col("fetched_at") == F.col("w_at")) & (F.col("w_seq") == F.col("seq")))
    columns = ["req_id", "url", "at", "outcome", "fetched_at"]
    return scratch.done(hits.select(*columns, "text").unionByName(told.where("outcome <> 'hit'").select("req_id", "url", "at", "outcome", F.when(F.col("outcome") == "expired", F.col("fetched_at")).alias("fetched_at")), allowMissingColumns=True), "reads")


def cache_policy(requests: DataFrame, cache: DataFrame, now: Column, ttl_hours: float = Config.cache_ttl_hours, enabled: bool = True) -> DataFrame:
    """Status of each request (req_id, url, refresh, fetched: text or null, error): hit, miss, fallback, disabled or null if it fails.

    A refresh never reads; a failed fetch falls back to any record, however old. ``write``: whether the text is stored.
    """
    c = cache.where("url is not null and text is not null and fetched_at is not null").select("url", F.col("text").alias("c_text"), F.col("fetched_at").alias("c_at"))
    x = requests.join(c, "url", "left")
    have = F.col("c_text").isNotNull() & F.lit(enabled)
    hit = have & ~F.coalesce("refresh", F.lit(False)) & ~stale(F.col("c_at"), now, ttl_hours)
    status = F.when(hit, "hit").when(F.col("fetched").isNotNull(), F.lit("miss" if enabled else "disabled")).when(have, "fallback")
    from tessella.sources.resolve import antibot

    return x.select(
        "req_id", "url", status.alias("cache"), F.when(hit, F.col("c_text")).otherwise(F.coalesce("fetched", F.when(have, F.col("c_text")))).alias("text"),
        F.when(hit | (F.col("fetched").isNull() & have), F.col("c_at")).alias("fetched_at"),
        F.when(~hit & F.col("fetched").isNull() & have, F.concat(F.lit("抓取失败（"), F.coalesce("error", F.lit("")), F.lit("），已回退缓存全文"))).alias("note"),
        F.coalesce(~hit & F.col("fetched").isNotNull() & F.lit(enabled) & ~antibot(F.col("fetched")), F.lit(False)).alias("write"),
    )


def ewma(calls: DataFrame, key: str, seq: str, rate: str, latency: str) -> DataFrame:
    """Moving averages of rate and latency per key over all calls in the order of ``seq`` (ties: by value), and their number.

    The first value stands as it is; rates that are not positive and finite do not count. A run of n calls maps an average a to
    a * OLD ** n + s, and such maps compose, so runs fold apart: rows are dealt by sampled ranges of (key, seq), every part gives a
    weighted sum of its earlier calls and a list of its EXACT latest, and a key's parts are folded in order. No window or list holds a whole
    key. Sums of the earlier calls are added in any order: what they give is within 1e-12 of itself, times OLD ** EXACT (4e-13) of
    the calls that follow, so results have the same bits as a plain fold unless earlier calls are a million times larger.
    """
    r, ms = F.col(rate), F.col(latency)
    inf = F.lit(float("inf"))
    ok = calls.where(r.isNotNull() & ~F.isnan(r) & (r > 0) & (r < inf))
    good = ms.isNotNull() & ~F.isnan(ms) & (ms > 0) & (ms < inf)
    x = ok.select(F.col(key).alias("k"), F.col(seq).alias("q"), r.cast("double").alias("r"), F.when(good, F.least(F.lit(LATENCY_HIGH), F.greatest(F.lit(LATENCY_LOW), ms.cast("double")))).otherwise(F.lit(LATENCY_DEFAULT)).alias("l"))
    order = ["q", "r", "l"]
    x = x.repartitionByRange("k", *order).withColumn("part", F.spark_partition_id())
    x = x.withColumn("back", F.row_number().over(Window.partitionBy("k", "part").orderBy(*[F.desc(c) for c in order])))
    early = F.col("back") > EXACT
    weight = F.pow(F.lit(OLD), F.col("back") - F.lit(EXACT + 1))
    value = lambda c: F.struct(*[c[f] for f in ("r", "l")])
    parts = x.groupBy("k", "part").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.when(early, F.col(c) * F.lit(NEW) * weight)).alias(f"s_{c}") for c in ("r", "l")], F.max_by(F.struct("r", "l"), "back").alias("first"),
        F.array_sort(F.collect_list(F.when(~early, F.struct((-F.col("back")).alias("place"), "r", "l")))).alias("late"),
    )
    n_early = F.greatest(F.col("n") - F.lit(EXACT), F.lit(0))
    by_key = parts.select("k", "n", F.struct("part", n_early.alias("early"), F.pow(F.lit(OLD), n_early).alias("m"), "s_r", "s_l", "first", F.transform("late", value).alias("late")).alias("p"))
    by_key = by_key.groupBy("k").agg(F.sum("n").alias("calls"), F.array_sort(F.collect_list("p")).alias("parts"))

    def average(f: str) -> Column:
        step = lambda a, v: F.when(a.isNull(), v[f]).otherwise(a * F.lit(OLD) + v[f] * F.lit(NEW))

        def part(a: Column, p: Column) -> Column:
            # the very first call counts whole, not by NEW
            begun = F.when(a.isNull(), p[f"s_{f}"] + p["first"][f] * F.lit(OLD) * p["m"] / F.lit(OLD)).otherwise(a * p["m"] + p[f"s_{f}"])
            return F.aggregate(p["late"], F.when(p["early"] > 0, begun).otherwise(a), step)

        return F.aggregate("parts", F.lit(None).cast("double"), part)

    return by_key.select(F.col("k").alias(key), "calls", average("r").alias("rate"), average("l").alias("latency"))


def load_calibration(raw: Column) -> Column:
    """A stored calibration (JSON) as a struct, null unless its rate is a positive number; other fields fall back one by one."""
    v = F.try_parse_json(raw)

    def num(name: str) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double"))

    at = F.try_variant_get(v, "$.updatedAt", "variant")
    latency = num("latencyMs")
    return F.when(
        num("rateTokPerSec") > 0,
        F.struct(num("rateTokPerSec").alias("rate"), F.when(latency > 0, latency).alias("latency"), F.coalesce(num("calls"), F.lit(0.0)).alias("calls"), F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, "$.updatedAt", "string")).alias("updated_at")),
    )


def client_calibration(raw: Column, rate: float = 30.0, latency: float = 800.0) -> Column:
    v = F.try_parse_json(raw)

    def num(name: str, fallback: float) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        d = F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double"))
        return F.when(d > 0, d).otherwise(F.lit(fallback))

    return F.struct(num("rate", rate).alias("rate"), num("latency", latency).alias("latency"))


def history_upsert(records: DataFrame, order: str = "seq", most: int = HISTORY_ENTRIES) -> DataFrame:
    """The list after all ``records`` (source, kind, title, ...): one per id ``source|kind|title``, the latest first, at most ``most``."""
    own = F.concat_ws("|", F.coalesce("source", F.lit("")), "kind", "title")
    x = records.withColumn("id", own)
    keep = [c for c in x.columns if c not in ("id", order)]
    last = x.groupBy("id").agg(F.max(F.struct(order, *keep)).alias("m")).select("id", "m.*")
    return last.orderBy(F.desc(order)).limit(most)


def history_read(raw: DataFrame, key: str) -> DataFrame:
    """Stored lists (JSON arrays) as rows: entries without id, title or a known kind go; wrong numbers become 0, wrong texts ''."""
    x = raw.select(key, F.posexplode(F.try_variant_get(F.try_parse_json("raw"), "$", "array<variant>")).alias("pos", "v"))
    v = F.col("v")

    def s(name: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))

    def n(name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
        return F.coalesce(F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{name}", "double")), F.lit(0.0)).cast("long")

    blank = lambda c: F.coalesce(c, F.lit(""))
    y = x.select(key, "pos", s("id").alias("id"), s("title").alias("title"), s("kind").alias("kind"), *[blank(s(c)).alias(c) for c in ("depth", "source")], n("chars").alias("chars"), n("time").alias("time"), *[blank(s(c)).alias(c) for c in ("summary", "thesis")])
    return y.where(F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("kind").isin(*HISTORY_KINDS))


def history_recent(history: DataFrame, order: str = "seq", shown: int = HISTORY_SHOWN) -> DataFrame:
    return history.orderBy(F.desc(order)).limit(shown)
