"""Written tables that cut lineage, and connected components over a shared folder.

Everything is written below ``spark.checkpoint.dir``, which all executors share.
A folder of our own is set only where the session names none (tests, laptops).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one where none is configured and driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps never recompute it, whatever executor is lost."""
    return _write(df, name)[0]


class Scratch:
    """Tables of one operator in the shared folder; all but the last are deleted once that is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        out, path = _write(df, name)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            del self.paths[path]
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def done(self, df: DataFrame, name: str = "result") -> DataFrame:
        """``df`` as a written table, everything else deleted."""
        out = cut(df, name)
        self.drop(*self.paths.values())
        return out


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (a missing one becomes null), so other columns of any name never clash."""
    have = {c.lower() for c in docs.columns}
    return docs.select(*[docs[n] if n.lower() in have else F.lit(None).cast("string").alias(n) for n in names])


def spare_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``docs`` has them."""
    have, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


def row_key() -> list[Column]:
    """Two longs that name a row by its id (a hash of it, if it is no number) and its text; nulls included. Repeated rows share a key."""
    other = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(1), "doc_id"))
    return [F.coalesce(F.col("doc_id").try_cast("long"), other, F.lit(-(2**63))).alias("k1"), F.xxhash64("doc_id", "text").alias("k2")]


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Alternating large and small stars; every round is one grouped minimum (combined before the shuffle)
    and one join, and is written to the shared folder. A hot node is one row of the minimum table; the join's
    large side can be split by adaptive execution. The number of rounds grows with the logarithm of the longest path.
    """
    own = Scratch(edges.sparkSession)
    e = own.cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e1 = own.cut(large.where("a != b").distinct(), "cc")
        low = e1.groupBy("a").agg(F.min("b").alias("low"))
        small = e1.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select("x.a", "x.b")
        e, old = own.cut(small.where("a != b").distinct(), "cc"), e
        own.drop(e1, old)
        # settled once every node has one edge, and no centre of a star hangs on another one
        if not e.groupBy("a").count().where("count > 1").limit(1).count() and not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    out = scratch.cut(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct()), "components")
    own.drop(e)
    return out
