"""Tables written to the session's shared folder: what lies behind them is never computed again, whatever executor is lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
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


def write(df: DataFrame, name: str, folder: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by hash over four tasks a core, however few files hold them: for work that is paid per row, of which a small file can mean much.

    The number is given, as otherwise adaptive execution would merge partitions of so few bytes again.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


class Scratch:
    """Tables of one operator; all but the last are deleted once that is written."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.paths = spark, folder, {}

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        out, path = write(df, name, self.folder)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            del self.paths[path]
            delete(self.spark, path)

    def done(self, df: DataFrame, name: str = "result") -> DataFrame:
        """``df`` as a written table, everything else deleted."""
        out = write(df, name, self.folder)[0]
        self.drop(*self.paths.values())
        return out


def in_order(df: DataFrame, order: list[str], scratch: Scratch, name: str = "ordered") -> DataFrame:
    """``df`` as a written table with ``_part``: parts follow one another in ``order``, so running values can be built part by part.

    Rows are dealt by sampled ranges: a key with most of the rows lies in many parts, as long as its rows differ in ``order``.
    """
    return scratch.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def carried(ordered: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], folds: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Running folds along ``order`` within ``keys`` of a table of ``in_order``, without a window over a whole key.

    ``values`` name what is folded and ``folds`` say how: last (the latest that is not null), max, min or sum. Every part folds its own rows first; totals of
    parts are at most one row per key and part. With ``inclusive`` a row sees itself, otherwise what lies before it.
    """

    def over(f: str, c: str, w) -> Column:
        return F.last(c, True).over(w) if f == "last" else {"max": F.max, "min": F.min, "sum": F.sum}[f](c).over(w)

    names = {v: f"_{v}" for v in values}
    x = ordered.withColumns({names[v]: c for v, c in values.items()})
    end = Window.partitionBy(*keys, "_part").orderBy(*order)
    inside = end.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = []
    for v, f in folds.items():
        if f == "last":
            # the latest of a part is a grouped maximum of places; orders end in a column that tells rows apart
            ends.append(F.max_by(names[v], F.when(F.col(names[v]).isNotNull(), F.struct(*order))).alias(names[v]))
        else:
            ends.append({"max": F.max, "min": F.min, "sum": F.sum}[f](names[v]).alias(names[v]))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys, "_part").agg(*ends)
    earlier = totals.select(*keys, "_part", *[over(f, names[v], before).alias(f"{names[v]}_earlier") for v, f in folds.items()])
    here = x.withColumns({v: over(f, names[v], inside) for v, f in folds.items()})
    joined = here.join(earlier, [*keys, "_part"], "left")

    def both(v: str, f: str) -> Column:
        a, b = F.col(v), F.col(f"{names[v]}_earlier")
        return {"last": F.coalesce(a, b), "max": F.greatest(a, b), "min": F.least(a, b), "sum": F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}[f]

    return joined.withColumns({v: both(v, f) for v, f in folds.items()}).drop(*names.values(), *[f"{n}_earlier" for n in names.values()])
