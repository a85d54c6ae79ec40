"""Exact top-k search by inner product with a pivot table.

Vectors become integers; one more component sqrt(M - |x|^2), M being the largest squared norm (0 for a query), makes the order by inner
product the order by distance: d(q, x)^2 = M + |q|^2 - 2 <q, x>. A table holds every row's distances to PIVOTS pivots; by the triangle
inequality the largest |d(q, p) - d(x, p)| is a lower bound of d(q, x). Rows lie in blocks of about BLOCK, by nearest pivot; a
block's least and largest distance to each pivot bound all its rows at once. Queries visit their own block first, then others in the order
of bounds in rounds of growing width, and stop for good once the next bound exceeds the distance of their k-th best row. Within
a block the same holds for rows: the FIRST with the least bounds are evaluated, then whichever the new k-th best still allows. Bounds are
floats with a margin far above their rounding; scores are exact integers, so results are exact whatever is pruned.

Pivots are spread by farthest-first choice over a sample of at most SAMPLE rows (first by a hash of the id): they change the speed, never
the result. A block is one row of a written table; only queries (about a twentieth of a block at a time) and found rows move. On vectors without any structure bounds
exclude little and the work is that of all queries against all rows, in blocks.

Cases: null vectors and those with null, non-finite or overlarge (beyond 2**22 after scaling) components take no part, nor do rows whose vec_id is null or no integer; shorter
vectors count as ended with zeros; a repeated row (id and vector) counts once; different vectors of one id are different candidates, and as queries
share one list; a query never gets rows of its own id; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table
gives an empty result; columns other than vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import vectors as V
from tessella.llm.store import Scratch, own_columns

SCALE, K, EVERY = 64, 20, 20
PIVOTS, SAMPLE, BLOCK, FIRST = 64, 2048, 2048, 64
#: Blocks of a round are WIDER times those before; summaries of GROUP blocks are compared at once.
WIDER, GROUP = 8, 1024
PACK = "block long, ids binary, x binary, d binary, lo binary, hi binary"
FOUND = "block long, q int, query_id long, norm2 long, vec_id long, score long"


class Space:
    """Pivots and the sizes that all tasks need: dim, largest squared norm, and the number of pivots that make cells."""

    def __init__(self, sample: np.ndarray, most: int, cells: int):
        self.dim, self.most = sample.shape[1], most
        self.margin = 1e-6 * max(1.0, most) ** 0.5
        x = np.hstack([sample, self.lift(sample)[:, None]])
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < PIVOTS and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        self.pivots, self.cells = x[chosen], min(cells, len(chosen))
        self.kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - (x * x).sum(1), 0).astype(np.float64))

    def distances(self, x: np.ndarray, lifted: np.ndarray) -> np.ndarray:
        own = np.hstack([x, lifted[:, None]])
        d2 = (own * own).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (own @ self.pivots.T)
        return np.sqrt(np.maximum(d2, 0))

    def cell(self, d: np.ndarray) -> np.ndarray:
        return d[:, : self.cells].argmin(1)

    def reach(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which a row of that score lies (infinite for none), with the margin."""
        return np.sqrt(np.maximum(self.most + norm2 - 2 * score, 0)) + self.margin


def survey(kept: DataFrame) -> tuple[Space, int] | None:
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * SCALE).cast("double") * F.floor(x.cast("double") * SCALE).cast("double"))
    rows, dim, most = kept.agg(F.count(F.lit(1)), F.max(F.size("embedding")), F.max(size)).first()
    if not rows:
        return None
    some = kept.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id", "embedding").limit(SAMPLE).collect()
    sample = V.matrix(pa.array([r.embedding for r in some], pa.list_(pa.float64())), SCALE, max(1, dim))
    return Space(sample, int(most), -(-rows // BLOCK)), rows


def placed(kept: DataFrame, space: Space, only_cells: bool = False) -> DataFrame:
    """vec_id, integers, and distances to the pivots of every row, and its cell; rows repeated within a batch are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (r for b in batches for r in V.runs(b)):
            x = V.matrix(batch.column(1), SCALE, space.dim)
            d = space.distances(x, space.lift(x))
            if only_cells:
                cell, count = np.unique(space.cell(d), return_counts=True)
                yield pa.record_batch([pa.array(cell), pa.array(count)], names=["cell", "count"])
                continue
            ids = batch.column(0).to_numpy()
            at = _distinct(ids, x)
            yield pa.record_batch([pa.array(ids[at]), *[_rows(a[at]) for a in (x.astype(np.int32), d.astype(np.float32))], pa.array(space.cell(d[at]))], names=["vec_id", "x", "d", "cell"])

    return kept.mapInArrow(run, "cell long, count long" if only_cells else "vec_id long, x binary, d binary, cell long")


def _distinct(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positions of one of each repeated row."""
    if len(np.unique(ids)) == len(ids):
        return np.arange(len(ids))
    return np.sort(np.unique(np.hstack([ids[:, None], x]), axis=0, return_index=True)[1])


def _rows(a: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    data, step = a.tobytes(), a.shape[1] * a.itemsize
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((np.arange(len(a) + 1) * step).astype(np.int32).tobytes()), pa.py_buffer(data)])


def blocks(kept: DataFrame, space: Space) -> tuple[DataFrame, int]:
    """One row per block: its ids, integers, distances, and their range for each pivot. The driver gets a count per cell."""
    counts = dict(placed(kept, space, only_cells=True).groupBy("cell").agg(F.sum("count")).collect())
    slots = np.array([-(-counts.get(c, 0) // BLOCK) for c in range(space.cells)])
    before = np.concatenate([[0], np.cumsum(slots)])
    n_of, base = (F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell").cast("int") + 1) for values in (np.maximum(slots, 1), before[:-1]))
    dim, pivots = space.dim, len(space.pivots)

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x, d = (np.frombuffer(b"".join(table.column(c).to_pylist()), t).reshape(len(ids), n) for c, t, n in (("x", np.int32, dim), ("d", np.float32, pivots)))
        at = _distinct(ids, x)
        ids, x, d = ids[at], x[at], d[at]
        return pa.table({"block": table.column("block")[:1], **{c: pa.array([a.tobytes()], pa.binary()) for c, a in (("ids", ids), ("x", x), ("d", d), ("lo", d.min(0)), ("hi", d.max(0)))}})

    rows = placed(kept, space).select((base + F.pmod(F.xxhash64("vec_id", F.lit(5)), n_of)).cast("long").alias("block"), "vec_id", "x", "d")
    return rows.groupBy("block").applyInArrow(pack, PACK), int(before[-1])


class Pack:
    """Rows of a block, or the queries among them."""

    def __init__(self, space: Space, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["x"], np.int32).reshape(len(self.ids), space.dim)
        self.d = np.frombuffer(row["d"], np.float32).reshape(len(self.ids), -1)

    def queries(self, space: Space) -> Pack:
        """Its rows with an id divisible by EVERY, with distances of queries (last component 0)."""
        out = object.__new__(Pack)
        at = np.flatnonzero(self.ids % EVERY == 0)
        out.ids, out.x = self.ids[at], self.x[at]
        out.d = space.distances(out.x.astype(np.int64), np.zeros(len(at))).astype(np.float32)
        return out


def search(space: Space, asked: Pack, block: Pack, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Query positions, row positions and scores: each query's k best rows of the block that may be among its k best of all.

    ``floor`` is the score of the k-th best row found elsewhere (-inf for none).
    """
    norm2 = (asked.x.astype(np.int64) ** 2).sum(1)
    lo, hi = block.d.min(0), block.d.max(0)
    near = np.flatnonzero(np.maximum(lo - asked.d, asked.d - hi).max(1) <= space.reach(norm2, floor))
    x = block.x.astype(space.kind)
    found = []
    for part in (near[i : i + 256] for i in range(0, len(near), 256)):
        q, n, best = asked.x[part].astype(space.kind), norm2[part], floor[part]
        bound = np.zeros((len(part), len(x)), np.float32)
        gap = np.empty_like(bound)
        for p in range(block.d.shape[1]):
            np.subtract.outer(asked.d[part, p], block.d[:, p], out=gap)
            np.maximum(bound, np.abs(gap, out=gap), out=bound)
        bound[asked.ids[part][:, None] == block.ids] = np.inf
        m = min(FIRST, len(x))
        first = np.argpartition(bound, m - 1, axis=1)[:, :m]
        score = np.where(np.isfinite(np.take_along_axis(bound, first, 1)), np.einsum("qd,qmd->qm", q, x[first]).astype(np.float64), -np.inf)
        if m >= k:
            best = np.maximum(best, np.partition(score, m - k, axis=1)[:, m - k])
        alive = bound <= np.where(np.isinf(best), np.finfo(np.float32).max, space.reach(n, best))[:, None]
        some = np.flatnonzero(alive.any(0))
        score = q @ x[some].T
        i, j = np.nonzero(alive[:, some] & (score >= best[:, None]))
        s, j = score[i, j].astype(np.int64), some[j]
        order = np.lexsort((block.ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((part[i[rank < k]], j[rank < k], s[rank < k]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


def _found(space: Space, name: int, asked: Pack, block: Pack, floor: np.ndarray, k: int) -> pa.RecordBatch:
    i, j, s = search(space, asked, block, floor, k)
    norm2 = (asked.x[i].astype(np.int64) ** 2).sum(1)
    return pa.record_batch([pa.array(np.full(len(i), name)), pa.array(i.astype(np.int32)), pa.array(asked.ids[i]), pa.array(norm2), pa.array(block.ids[j]), pa.array(s)], names=["block", "q", "query_id", "norm2", "vec_id", "score"])


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (dict(zip(b.schema.names, (b.column(c)[i].as_py() for c in range(b.num_columns)))) for b in batches for i in range(b.num_rows))


def top(embeddings: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows of every query (a row whose id is divisible by EVERY)."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    kept = own_columns(embeddings, "vec_id", "embedding").select(F.col("vec_id").try_cast("long").alias("vec_id"), "embedding").where(V.usable("embedding", SCALE)).where("vec_id is not null")
    known = survey(kept)
    if known is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space, _ = known
    packed, n_blocks = blocks(kept, space)
    packed = scratch.cut(packed, "blocks")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            block = Pack(space, row)
            asked = block.queries(space)
            yield _found(space, row["block"], asked, block, np.full(len(asked.ids), -np.inf), k)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            asked = Pack(space, row).queries(space)
            if len(asked.ids):
                d = asked.d
                yield pa.record_batch([pa.array([row["block"]]), *[pa.array([a.tobytes()], pa.binary()) for a in (asked.ids, asked.x, d, d.min(0), d.max(0))], pa.array([len(asked.ids)])], names=["asker", "q_ids", "q_x", "q_d", "q_lo", "q_hi", "q_n"])

    asked = scratch.cut(packed.select("block", "ids", "x", "d").mapInArrow(asking, "asker long, q_ids binary, q_x binary, q_d binary, q_lo binary, q_hi binary, q_n long"), "queries")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scratch.cut(packed.select("block", "ids", "x", "d").mapInArrow(own, FOUND).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k), "best")

    def floors(best: DataFrame) -> DataFrame:
        """Per asking block: queries with k rows, their k-th score, and the distance beyond which none of the block's queries needs to look."""
        kth = best.groupBy("block", "q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"), F.max("norm2").alias("norm2")).where(F.col("n") >= k)
        far = F.sqrt(F.max(F.greatest(F.lit(space.most) + F.col("norm2") - 2 * F.col("score"), F.lit(0)).cast("double"))) + space.margin
        held = kth.groupBy("block").agg(F.collect_list("q").alias("held"), F.collect_list("score").alias("floor"), F.count(F.lit(1)).alias("n"), far.alias("far"))
        some = asked.select("asker", "q_n").join(held, F.col("asker") == F.col("block"), "left")
        return some.select("asker", "held", "floor", F.when(F.col("n") == F.col("q_n"), F.col("far")).otherwise(float("inf")).alias("far"))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Asking blocks against summaries of a group of blocks: pairs that distances to pivots do not exclude, with their bound."""
        for row in _dicts(batches):
            lo, hi = (np.frombuffer(b"".join(row[c]), np.float32).reshape(len(row["names"]), -1) for c in ("lo", "hi"))
            q_lo, q_hi = (np.frombuffer(row[c], np.float32) for c in ("q_lo", "q_hi"))
            bound = np.maximum(np.maximum(lo - q_hi, q_lo - hi).max(1), 0).astype(np.float64)
            names = np.array(row["names"], np.int64)
            at = np.flatnonzero((bound <= row["far"]) & (names != row["asker"]))
            yield pa.record_batch([pa.array(np.full(len(at), row["asker"])), pa.array(names[at]), pa.array(bound[at])], names=["asker", "block", "bound"])

    groups = packed.select("block", "lo", "hi").groupBy(F.floor(F.col("block") / GROUP).alias("g")).agg(F.sort_array(F.collect_list(F.struct("block", "lo", "hi"))).alias("s"))
    groups = groups.select("g", F.col("s.block").alias("names"), F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    each = asked.select("asker", "q_lo", "q_hi").join(floors(best).select("asker", "far"), "asker").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_blocks - 1) // GROUP).cast("long"))))
    pairs = each.join(groups, "g").select("asker", "q_lo", "q_hi", "far", "names", "lo", "hi").mapInArrow(bounds, "asker long, block long, bound double")
    pairs = scratch.cut(pairs.withColumn("place", F.row_number().over(Window.partitionBy("asker").orderBy("bound", "block"))), "pairs")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(batches):
            queries = Pack(space, {"ids": row["q_ids"], "x": row["q_x"], "d": row["q_d"]})
            floor = np.full(len(queries.ids), -np.inf)
            floor[np.array(row["held"] or [], np.int64)] = row["floor"] or []
            yield _found(space, row["asker"], queries, Pack(space, row), floor, k)

    done, last = 0, pairs.agg(F.max("place")).first()[0] or 0
    while done < last:
        upto = (done + 1) * WIDER - 1
        some = pairs.where((F.col("place") > done) & (F.col("place") <= upto)).join(floors(best), "asker").where(F.col("bound") <= F.col("far")).drop("place", "bound", "far")
        more = some.join(asked.select("asker", "q_ids", "q_x", "q_d"), "asker").join(packed.select("block", "ids", "x", "d"), "block").mapInArrow(visit, FOUND)
        better = best.drop("rank").unionByName(more).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        best, old = scratch.cut(better, "best"), best
        scratch.drop(old)
        done = upto
    return scratch.done(best.select("query_id", "rank", "vec_id", "score"), "top")


def result(embeddings: DataFrame) -> DataFrame:
    return top(embeddings)
